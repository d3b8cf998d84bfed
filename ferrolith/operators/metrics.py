"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.operators.ranking import average_ranks
from ferrolith.schemas import MEASURED


def confusion(rows: DataFrame, truth: str, predicted: str, classes: int) -> DataFrame:
    """truth, predicted, n for rows whose truth is a class."""
    return rows.filter(F.col(truth).between(0, classes - 1)).groupBy(F.col(truth).cast("int").alias("truth"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def class_iou(matrix: DataFrame, classes: int) -> DataFrame:
    """cls, iou from a confusion table; null where a class has no union."""
    arms = matrix.select(F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("cls"), "truth", "predicted", "n")
    sums = arms.groupBy("cls").agg(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("inter"), F.sum("n").alias("union"))
    spine = matrix.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    return spine.join(sums, "cls", "left").select("cls", F.try_divide(F.col("inter").cast("double"), F.col("union")).alias("iou"))


def mean_iou(ious: DataFrame) -> DataFrame:
    return ious.agg(F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"))


def accuracy(truth: Column, predicted: Column) -> Column:
    return F.coalesce(F.avg((truth == predicted).cast("double")), F.lit(0.0))


def spearman(rows: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """by, spearman: the correlation of average ranks, from distinct pairs of values; null if either side is constant."""
    pairs = rows.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    counted = pairs.groupBy(*by, truth, predicted).agg(F.count("*").alias("n"))
    ranked = counted.join(average_ranks(pairs, by, truth, "rank_y"), [*by, truth]).join(average_ranks(pairs, by, predicted, "rank_p"), [*by, predicted])
    middle = pairs.groupBy(*by).agg(((F.count("*") + 1) / 2).alias("middle"))  # the mean of all average ranks
    y, p, n = F.col("rank_y") - F.col("middle"), F.col("rank_p") - F.col("middle"), F.col("n")
    sums = ranked.join(middle, by).groupBy(*by).agg(F.sum(n * y * p).alias("yp"), F.sum(n * y * y).alias("yy"), F.sum(n * p * p).alias("pp"))
    return sums.select(*by, F.try_divide("yp", F.sqrt(F.col("yy") * F.col("pp"))).alias("spearman"))


def regression_metrics(rows: DataFrame, by: list[str], truth: str = "y", predicted: str = "p") -> DataFrame:
    """by, n, mae, rmse, r2, spearman. r2 is null for constant truth, Spearman's rho too. `by` isn't null."""
    error = F.col(truth) - F.col(predicted)
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.nullif(F.var_pop(truth) * F.count(truth), F.lit(0.0)))).alias("r2"),
    )
    return sums.join(spearman(rows, by, truth, predicted), by, "left")


def measured_metrics(rows: DataFrame, by: list[str], source: Column, truth: str = "y", predicted: str = "p") -> DataFrame:
    """The same for two subsets: all rows, and those whose property source is measured."""
    subsets = F.array_compact(F.array(F.lit("all"), F.when(source == MEASURED, F.lit("measured"))))
    return regression_metrics(rows.withColumn("subset", F.explode(subsets)), [*by, "subset"], truth, predicted)


def class_means(rows: DataFrame, pixels: str, classes: str) -> DataFrame:
    """cls, mean_intensity, share: of the pixels of each class over all images, their mean value and share."""
    each = rows.select(F.explode(F.arrays_zip(F.col(pixels).alias("x"), F.col(classes).alias("cls"))).alias("at")).groupBy("at.cls").agg(F.avg("at.x").alias("mean_intensity"), F.count("*").alias("n"))
    return each.crossJoin(each.agg(F.sum("n").alias("total"))).select("cls", "mean_intensity", (F.col("n") / F.col("total")).alias("share"))  # total: one row


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """bin, n over [low, high], the last bin closed."""
    width = (high - low) / bins
    index = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
    return rows.filter(value.between(low, high)).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
