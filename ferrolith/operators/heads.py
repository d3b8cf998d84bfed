"""Property heads: a scaled ridge and boosted trees, compared by leave-one-out error; the better one is fitted on all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.operators import boosting, evaluation, metrics
from ferrolith.operators.boosting import EQUAL_GAIN
from ferrolith.operators.prediction import HeadRegistry
from ferrolith.operators.records import feature_names, training_table
from ferrolith.operators.weak_labels import first_value_by_group, in_scope
from ferrolith.sinks import load_head, save_head

# The ridge penalty, and the trees' number, shrinkage and depth.
RIDGE, TREES, SHRINKAGE, DEPTH = 1.0, 100, 0.1, 3
LEAST_ROWS = 3
#: Up to so many rows, a task fits the trees of one left-out row from a copy of the table; larger tables go through histograms.
MOST_TREE_ROWS = 2000


def split_at(x: np.ndarray, r: np.ndarray) -> tuple[float, int, float]:
    """(gain, feature, threshold) of the split that lowers the squared error most; the first feature and threshold of equals."""
    best = (0.0, -1, 0.0)
    n = len(r)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, sums = x[order, j], np.cumsum(r[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        left = at + 1
        apart = sums[at] / left - (sums[-1] - sums[at]) / (n - left)
        gain = left * (n - left) / n * apart * apart
        k = int(gain.argmax())
        if gain[k] > best[0] * (1 + EQUAL_GAIN):
            best = (float(gain[k]), j, float(v[at[k]] / 2 + v[at[k] + 1] / 2))
    return best


def grow(x: np.ndarray, r: np.ndarray, depth: int) -> list | float:
    """A tree: a leaf's mean, or [feature, threshold, lower part, upper part]."""
    gain, j, threshold = split_at(x, r) if depth and len(r) > 1 else (0.0, -1, 0.0)
    if gain <= 0:
        return float(r.mean())
    low = x[:, j] <= threshold
    return [j, threshold, grow(x[low], r[low], depth - 1), grow(x[~low], r[~low], depth - 1)]


def follow(tree: list | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(x), tree)
    j, threshold, lower, upper = tree
    low = x[:, j] <= threshold
    out = np.empty(len(x))
    out[low], out[~low] = follow(lower, x[low]), follow(upper, x[~low])
    return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> dict:
    start, trees = float(y.mean()), []
    left = y - start
    for _ in range(TREES):
        tree = grow(x, left, DEPTH)
        trees.append(tree)
        left = left - SHRINKAGE * follow(tree, x)
    return {"kind": "trees", "start": start, "rate": SHRINKAGE, "trees": trees}


def tree_values(head: dict, x: np.ndarray) -> np.ndarray:
    return head["start"] + head["rate"] * sum(follow(t, x) for t in head["trees"])


def leave_one_out_trees(table: DataFrame, key: str, features: list[str], target: str) -> DataFrame:
    """key, y, p: each row's prediction by trees fitted on all others, whose fits are dealt out over tasks or waves (see boosting)."""
    rows = table.select(key, *features, target).orderBy(key).limit(MOST_TREE_ROWS + 1).toPandas()
    if len(rows) > MOST_TREE_ROWS:
        return boosting.leave_folds_out(table, key, key, features, target, TREES, SHRINKAGE, DEPTH)
    x, y, keys = rows[features].to_numpy(float), rows[target].to_numpy(float), rows[key].tolist()

    def folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch.id:
                keep = np.arange(len(y)) != i
                yield pd.DataFrame({key: [keys[i]], "y": [y[i]], "p": tree_values(fit_trees(x[keep], y[keep]), x[i : i + 1])})

    spark = table.sparkSession
    ids = spark.range(0, len(y), 1, max(1, min(len(y), 4 * spark.sparkContext.defaultParallelism)))
    return ids.mapInPandas(folds, f"{key} {dict(table.dtypes)[key]}, y double, p double")


def scores(table: DataFrame, key: str, features: list[str], target: str) -> DataFrame:
    """model, n, mae, rmse, r2, spearman by leave-one-out of the linear head and of the trees."""
    whole = table.withColumn("__all", F.lit(0))
    linear = evaluation.leave_one_out_ridge(whole, "__all", key, features, target, RIDGE).select(F.lit("linear").alias("model"), "y", "p")
    trees = leave_one_out_trees(table, key, features, target).select(F.lit("trees").alias("model"), "y", "p")
    return metrics.regression_metrics(linear.unionByName(trees), ["model"])


def fit_head(table: DataFrame, key: str, features: list[str], target: str) -> dict:
    """The head with the lower leave-one-out error (the linear one of equals), fitted on all rows. Rows without a target are left out."""
    table = table.filter(F.col(target).isNotNull())
    n = table.count()
    if n < LEAST_ROWS:
        raise ValueError(f"leave-one-out needs {LEAST_ROWS} rows at least, not {n}")
    found = {r.model: r.asDict() for r in scores(table, key, features, target).collect()}
    best = min(("linear", "trees"), key=lambda m: found[m]["mae"])
    if best == "linear":
        mean, scale, w, b = evaluation.fit_ridge(table, features, target, RIDGE)
        head = {"kind": "linear", "mean": mean.tolist(), "scale": scale.tolist(), "weights": w.tolist(), "intercept": b}
    elif n > MOST_TREE_ROWS:
        head = boosting.fit(table, features, target, TREES, SHRINKAGE, DEPTH)
    else:
        rows = table.select(*features, target).toPandas()  # MOST_TREE_ROWS at most
        head = fit_trees(rows[features].to_numpy(float), rows[target].to_numpy(float))
    return head | {"features": features, "n": n, "scores": found}


def head_value(head: dict, features: Column) -> Column:
    """The head's value for a map of features; a missing feature counts as 0."""
    values = [F.coalesce(features[name], F.lit(0.0)) for name in head["features"]]
    if head["kind"] == "linear":
        parts = zip(values, head["mean"], head["scale"], head["weights"])
        return sum(((v - m) / s * w for v, m, s, w in parts), F.lit(head["intercept"]))

    width = len(values)

    @F.pandas_udf("double")
    def grown(x: pd.Series) -> pd.Series:
        return pd.Series(tree_values(head, np.vstack(x.to_list()) if len(x) else np.zeros((0, width))))

    return grown(F.array(*values))


def fit_property_head(registry: HeadRegistry, root: str, scope: str, property_name: str, features: DataFrame | None, records: DataFrame) -> dict | None:
    """Fit and save the head of (scope, property); None where values are too few.

    features: one row for each group with group_id, family, adapter and features. A group's value is the first that its records have.
    """
    if registry.find(scope, property_name) is None:
        raise KeyError(f"no head for {scope}, {property_name}; there are {registry.registered()}")
    if features is None:
        raise FileNotFoundError("no feature table; extract features first")
    own = features.filter(in_scope(F.col("family"), F.col("adapter"), scope))
    table = training_table(own, first_value_by_group(records, property_name))
    try:
        head = fit_head(table, "group_id", [c for c in feature_names(features) if c != "value"], "value")
    except ValueError as problem:
        print(f"no head for {scope}, {property_name}: {problem}")
        return None
    save_head(head, root, scope, property_name)
    return head


def predict_property(root: str, scope: str, property_name: str, features: DataFrame) -> DataFrame:
    """record_id, value, reason: a saved head's value for each row's features (a map), or why there is none."""
    head = load_head(root, scope, property_name)
    if head is None:
        return features.select("record_id", F.lit(None).cast("double").alias("value"), F.lit(f"no fitted head for {scope}, {property_name}").alias("reason"))
    return features.select("record_id", head_value(head, F.col("features")).alias("value"), F.lit(None).cast("string").alias("reason"))
