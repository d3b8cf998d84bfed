"""Splits of groups, so that no group stands on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def check_fractions(val: float, test: float) -> None:
    if min(val, test) < 0 or val + test >= 1:
        raise ValueError("fractions must not be negative and must leave a training part")


def hashed_group_split(records: DataFrame, group: str, val: float, test: float, seed: int = 0) -> DataFrame:
    """records with split: groups in the order of md5(seed:group); test first, then val, the rest train. Sizes round half to even.

    Only distinct groups are ranked; each group's place counts how many hashes are smaller, bucket by bucket, so that no task sees all groups.
    """
    check_fractions(val, test)
    groups = records.select(group).distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))))
    bucketed = groups.withColumn("bucket", F.substring("h", 1, 3))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = bucketed.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))  # 4096 rows at most
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("h", group)) + F.col("before")
    ranked = bucketed.join(F.broadcast(offsets), "bucket").withColumn("place", place)
    n_test, n_val = F.bround(F.col("total") * test, 0), F.bround(F.col("total") * val, 0)
    split = F.when(F.col("place") <= n_test, "test").when(F.col("place") <= n_test + n_val, "val").otherwise("train")
    return records.join(ranked.select(group, split.alias("split")), group, "left")


def permuted_group_split(records: DataFrame, group: str, val: float, test: float, seed: int, most_groups: int = 100_000) -> DataFrame:
    """The same with NumPy's seeded permutation of the sorted groups, on the driver; for up to most_groups groups."""
    import numpy as np

    check_fractions(val, test)
    groups = [r[0] for r in records.select(group).distinct().orderBy(group).limit(most_groups + 1).collect()]
    if len(groups) > most_groups:
        raise ValueError(f"more than {most_groups} groups; use hashed_group_split")
    order = np.random.default_rng(seed).permutation(len(groups))
    n_test, n_val = round(len(groups) * test), round(len(groups) * val)
    if n_test + n_val >= len(groups):
        raise ValueError("no group is left to train on")
    names = ["test" if i < n_test else "val" if i < n_test + n_val else "train" for i in range(len(groups))]
    spark: SparkSession = records.sparkSession
    table = spark.createDataFrame([(groups[g], names[i]) for i, g in enumerate(order)], f"{group} {dict(records.dtypes)[group]}, split string")
    return records.join(F.broadcast(table), group, "left")  # at most most_groups rows


def held_out_split(records: DataFrame, column: str, values: list) -> DataFrame:
    """records with split: test where the column has one of the values, else train."""
    return records.withColumn("split", F.when(F.col(column).isin(*values), "test").otherwise("train"))


def straddling_groups(records: DataFrame, group: str) -> DataFrame:
    """Groups that stand in more than one split; none if the split is sound."""
    return records.groupBy(group).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")
