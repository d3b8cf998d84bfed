"""Leave-one-out evaluation, baselines and centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions.vectors import dot, doubles, squared_distance


def leave_block_out_mean(rows: DataFrame, block: str, value: str) -> DataFrame:
    """rows with p: the mean of all other blocks. Sums by block, then one total. Rows without a block are a block of their own."""
    sums = rows.groupBy(block).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    total = sums.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    means = sums.crossJoin(total).select(block, F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")).alias("p"))  # total: one row
    return rows.join(means, block)


def leave_block_out_grade_mean(rows: DataFrame, block: str, grade: str, value: str) -> DataFrame:
    """rows with p: the mean of the same grade in other blocks, else of all other blocks."""
    cells = rows.groupBy(grade, block).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy(grade)
    own = cells.select(grade, block, F.try_divide(F.sum("s").over(w) - F.col("s"), F.nullif(F.sum("n").over(w) - F.col("n"), F.lit(0))).alias("own"))
    return leave_block_out_mean(rows, block, value).join(own, [grade, block]).withColumn("p", F.coalesce("own", "p")).drop("own")


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """label, centroid: element-wise means."""
    each = rows.select(label, F.posexplode(doubles(F.col(vector))).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("m"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def class_distances(rows: DataFrame, key: str, vector: str, means: DataFrame, label: str) -> DataFrame:
    """rows with distances: (rounded distance, label) to each class mean. means: one row for each class."""
    table = means.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("cls"), "centroid"))).alias("means"))
    near = F.transform("means", lambda m: F.struct(F.round(F.sqrt(squared_distance(F.col("__v"), m["centroid"])), 9).alias("d"), m["cls"].alias("cls")))
    wide = rows.withColumn("__v", doubles(F.col(vector)))  # below the join, so that it is made once for all classes
    return wide.crossJoin(F.broadcast(table)).withColumn("distances", near).drop("means", "__v")  # one row: a vector for each class


def nearest_mean(distances: Column) -> Column:
    """The class at the least distance; the smaller label of equals."""
    return F.array_min(distances)["cls"]


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, population scale, weights and intercept of a standardised ridge with a free intercept."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale == 0, 1.0, scale)
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return mean, scale, w, float(y.mean())


def fit_ridge(rows: DataFrame, features: list[str], target: str, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The same over a table, from its moments: one aggregation, whose width squared numbers are all that the driver sees."""
    k = len(features)
    x, y = [F.col(f).cast("double") for f in features], F.col(target).cast("double")
    m = rows.filter(F.col(target).isNotNull()).agg(F.count("*"), F.array(*[F.avg(c) for c in (*x, y)]), F.array(*[F.covar_pop(a, b) for a in x for b in x]), F.array(*[F.covar_pop(a, y) for a in x])).first()
    n, mean, xx, xy = m[0], np.array(m[1]), np.array(m[2]).reshape(k, k), np.array(m[3])
    scale = np.sqrt(np.maximum(np.diag(xx), 0))
    scale = np.where(scale <= 1e-12 * np.maximum(np.abs(mean[:k]), 1e-300), 1.0, scale)
    w = np.linalg.solve(n * xx / np.outer(scale, scale) + alpha * np.eye(k), n * xy / scale)
    return mean[:k], scale, w, float(mean[k])


def leave_one_out_ridge(rows: DataFrame, group: str, key: str, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """group, key, y, p: each row's prediction by a ridge fitted on its group's other rows; groups under three rows go.

    A fit needs moments alone. They are summed by group; each row takes itself out of its group's and solves for itself, so
    that a large group is no one task's work.
    """
    k, kinds = len(features), dict(rows.dtypes)
    x, y = [F.col(f).cast("double") for f in features], F.col(target).cast("double")
    moments = rows.groupBy(group).agg(
        F.count("*").alias("__n"), F.array(*[F.avg(c) for c in x], F.avg(y)).alias("__mean"),
        F.array(*[F.covar_pop(a, b) for a in x for b in x]).alias("__xx"), F.array(*[F.covar_pop(a, y) for a in x]).alias("__xy"),
    ).filter("__n >= 3")
    joined = rows.select(group, key, F.array(*x).alias("__x"), y.alias("y")).join(moments, group)

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["__n"].to_numpy(float)[:, None]
            mean, xs, ys = np.vstack(batch["__mean"]), np.vstack(batch["__x"]), batch.y.to_numpy(float)[:, None]
            d, e, take = xs - mean[:, :k], ys - mean[:, k:], n / (n - 1)
            xx = n[:, :, None] * np.vstack(batch["__xx"]).reshape(-1, k, k) - take[:, :, None] * d[:, :, None] * d[:, None, :]
            xy = n * np.vstack(batch["__xy"]) - take * d * e
            var = np.diagonal(xx, axis1=1, axis2=2) / (n - 1)
            whole = np.diagonal(np.vstack(batch["__xx"]).reshape(-1, k, k), axis1=1, axis2=2)
            scale = np.where(var > 1e-12 * np.maximum(whole, 1e-300), np.sqrt(np.maximum(var, 0)), 1.0)
            w = np.linalg.solve(xx / (scale[:, :, None] * scale[:, None, :]) + alpha * np.eye(k), (xy / scale)[:, :, None])[:, :, 0]
            p = ((d + d / (n - 1)) / scale * w).sum(1) + (mean[:, k:] - e / (n - 1))[:, 0]
            yield pd.DataFrame({group: batch[group], key: batch[key], "y": ys[:, 0], "p": p})

    return joined.mapInPandas(solved, f"{group} {kinds[group]}, {key} {kinds[key]}, y double, p double")


def principal_plane(rows: DataFrame, key: str, vector: str, parts: int = 2) -> DataFrame:
    """key and pc1, pc2, ...: the rows in the directions of largest variance. A direction's sign makes its largest component positive.

    Sums of products of a vector's components are aggregated; only their table, of the vector's width squared, reaches the driver.
    """
    wide = rows.select(key, doubles(F.col(vector)).alias("v"))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.hstack([np.vstack(batch.v), np.ones((len(batch), 1))])
            yield pd.DataFrame({"i": np.arange(x.shape[1] ** 2), "x": (x.T @ x).ravel()})

    each = wide.select("v").mapInPandas(moments, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    m = np.array([r.x for r in each]).reshape(int(len(each) ** 0.5), -1)
    mean = m[-1, :-1] / m[-1, -1]
    values, directions = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
    out = []
    for i, d in enumerate(directions[:, np.argsort(-values, kind="stable")[:parts]].T, 1):
        d = d * np.sign(d[np.abs(d).argmax()])
        weights = F.array(*[F.lit(float(w)) for w in d])
        out.append((dot(F.col("v"), weights) - F.lit(float(mean @ d))).alias(f"pc{i}"))
    return wide.select(key, *out)


def pca_ridge_folds(rows: DataFrame, key: str, block: str, vector: str, target: str, parts: int = 8, alpha: float = 10.0) -> DataFrame:
    """key, y, p: for each block a PCA (at most `parts` directions) and a ridge fitted on all other blocks.

    A fold needs sums alone: moments of the vectors and targets are summed by block; each block's fold takes them out of the total (the one
    thing that the driver sees) and is solved where the block's moments are. Rows are then scored by expressions.
    """
    with_y = rows.filter(F.col(target).isNotNull()).select(key, block, doubles(F.col(vector)).alias("v"), F.col(target).cast("double").alias("y"))
    kinds = dict(rows.dtypes)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby(block):
                x = np.hstack([np.vstack(part.v), part.y.to_numpy()[:, None], np.ones((len(part), 1))])
                yield pd.DataFrame({block: [name], "m": [(x.T @ x).ravel()]})

    summed = with_y.select(block, "v", "y").mapInPandas(moments, f"{block} {kinds[block]}, m array<double>")
    each = summed.select(block, F.posexplode("m").alias("i", "x")).groupBy(block, "i").agg(F.sum("x").alias("x"))
    held = each.groupBy(block).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))  # the width squared numbers a block
    total = np.array([r.x for r in each.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for own in batch.m:
                m = (total - own).reshape(int(len(total) ** 0.5), -1)
                n, mean, y_mean = m[-1, -1], m[-1, :-2] / max(m[-1, -1], 1), m[-1, -2] / max(m[-1, -1], 1)
                cov = m[:-2, :-2] - n * np.outer(mean, mean)
                cross = m[:-2, -2] - n * mean * y_mean
                _, directions = np.linalg.eigh(cov)
                d = directions[:, ::-1][:, : min(parts, len(mean))]
                scale = np.sqrt(np.maximum(np.diag(d.T @ cov @ d) / max(n, 1), 1e-30))
                w = np.linalg.solve((d.T @ cov @ d) / np.outer(scale, scale) + alpha * np.eye(d.shape[1]), d.T @ cross / scale)
                coefficients = d @ (w / scale)
                found.append((coefficients.tolist(), float(y_mean - mean @ coefficients)))
            yield pd.DataFrame({block: batch[block], "weights": [w for w, _ in found], "intercept": [b for _, b in found]})

    table = held.mapInPandas(fitted, f"{block} {kinds[block]}, weights array<double>, intercept double")
    score = F.aggregate(F.zip_with("v", "weights", lambda a, c: a * c), F.lit(0.0), lambda a, x: a + x) + F.col("intercept")
    return with_y.join(table, block).select(key, "y", score.alias("p"))


#: Rows that a task of the trees' fit holds in memory, about 180 bytes each.
TREE_ROWS = 250_000


def dealt_rows(rows: DataFrame, key: str) -> DataFrame:
    """rows in partitions of about TREE_ROWS, the same ones in the same order on every run; a table of up to so many stays as it is.

    MLlib samples its split candidates by partition, so a small table's trees depend on how it is read alone.
    """
    n = rows.count()
    return rows.repartition(-(-n // TREE_ROWS), key).sortWithinPartitions(key) if n > TREE_ROWS else rows


def fit_tree_head(rows: DataFrame, key: str, features: list[str], target: str, seed: int = 0):
    """Gradient-boosted trees over a feature table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    stages = [VectorAssembler(inputCols=features, outputCol="features_vector"), GBTRegressor(featuresCol="features_vector", labelCol=target, predictionCol="p", maxIter=20, maxDepth=3, stepSize=0.1, seed=seed)]
    return Pipeline(stages=stages).fit(dealt_rows(rows.select(key, *features, target), key))


def better_model(scores: DataFrame, name: str, error: str, order: str) -> DataFrame:
    """The name with the smallest error; the earlier of equals."""
    return scores.agg(F.min_by(name, F.struct(error, order)).alias(name), F.min(error).alias(error))
