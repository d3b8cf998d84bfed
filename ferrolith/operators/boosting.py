"""Boosted regression trees fitted over a distributed table, for many left-out folds at once.

Features are cut into bins, each distinct value its own as long as there are few, quantiles otherwise. A tree's level is one
aggregation: tasks sum counts and residuals by (fold, node, feature, bin) over their rows, Spark merges these histograms and
finds each feature's best cut by running sums, and the driver sees one candidate for each (fold, node, feature). Rows keep one
residual for each fold of a wave; a wave holds as many folds as its histograms have room for, so neither rows nor folds are bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.session import materialize

#: Bins of a feature with more distinct values than this are quantiles.
BINS = 256
#: Cells of a task's histograms; folds are fitted in waves of as many as fit.
CELLS = 2**21
#: Gains that differ by a smaller share count as equal: two features that part the same rows differ by rounding alone.
EQUAL_GAIN = 1e-9
#: Residuals are written anew after so many trees; in between, tasks follow the trees since then.
REFRESH = 10


@dataclass(frozen=True)
class Bins:
    """Of a feature, each bin's least and largest value, in order."""

    least: np.ndarray
    largest: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.largest, x), len(self.largest) - 1)


def make_bins(state: DataFrame, width: int, most: int = BINS) -> list[Bins]:
    """The bins of each of the features in the array x."""
    found = []
    for i in range(width):
        values = state.select(F.get("x", F.lit(i)).alias("v"))
        some = values.distinct().limit(most + 1).collect()  # most + 1 values
        if len(some) <= most:
            own = np.sort(np.array([r.v for r in some], float))
            found.append(Bins(own, own))
            continue
        edges = values.agg(F.percentile_approx("v", [(k + 1) / most for k in range(most)], 100 * most), F.max("v")).first()
        largest = np.unique(np.array([*edges[0], edges[1]], float))
        at = F.pandas_udf(lambda v, largest=largest: pd.Series(np.searchsorted(largest, v.to_numpy())), "long")
        least = {r.b: r.v for r in values.groupBy(at("v").alias("b")).agg(F.min("v").alias("v")).collect()}  # a row for each bin
        kept = sorted(least)
        found.append(Bins(np.array([least[b] for b in kept]), largest[kept]))
    return found


class Growing:
    """A tree as a heap: the children of node k are 2 k + 1 and 2 k + 2. feature is -1 at leaves."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature, self.threshold, self.value = np.full(size, -1), np.zeros(size), np.zeros(size)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        node = np.zeros(len(x), int)
        for _ in range(len(self.feature).bit_length() - 1):
            f = self.feature[node]
            high = x[np.arange(len(x)), np.maximum(f, 0)] > self.threshold[node]
            node = np.where(f >= 0, 2 * node + 1 + high, node)
        return node

    def nested(self, node: int = 0) -> list | float:
        """A leaf's mean, or [feature, threshold, lower part, upper part]."""
        if self.feature[node] < 0:
            return float(self.value[node])
        return [int(self.feature[node]), float(self.threshold[node]), self.nested(2 * node + 1), self.nested(2 * node + 2)]


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.vstack(batch.x.to_numpy()).astype(float)


def _histograms(bins: list[Bins], fresh: list[list[Growing]], growing: list[Growing], level: int, rate: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    folds, width, first, nodes, most = len(growing), len(bins), 2**level - 1, 2**level, max(len(b.largest) for b in bins)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = (np.zeros((folds, nodes, width, most)) for _ in range(2))
        for batch in batches:
            x, own, residuals = _matrix(batch), batch.own.to_numpy(), np.vstack(batch.residuals.to_numpy())
            binned = [b.of(x[:, j]) for j, b in enumerate(bins)]
            for f in range(folds):
                left = residuals[:, f] - rate * sum((tree[f].value[tree[f].place(x)] for tree in fresh), np.zeros(len(x)))
                node = growing[f].place(x) - first
                there = (own != f) & (node >= 0)
                for j in range(width):
                    at = node[there] * most + binned[j][there]
                    counts[f, :, j] += np.bincount(at, minlength=nodes * most).reshape(nodes, most)
                    sums[f, :, j] += np.bincount(at, left[there], nodes * most).reshape(nodes, most)
        f, node, j, b = np.nonzero(counts)
        if len(f):
            yield pd.DataFrame({"fold": f, "node": node + first, "feature": j, "bin": b, "n": counts[f, node, j, b], "s": sums[f, node, j, b]})

    return summed


def _candidates(histograms: DataFrame) -> DataFrame:
    """Of each (fold, node, feature) the cut that lowers the squared error most, the first of equals, with sums on both sides."""
    merged = histograms.groupBy("fold", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    all_ = Window.partitionBy("fold", "node", "feature")
    w = all_.orderBy("bin")
    run = merged.select("fold", "node", "feature", "bin", F.lead("bin").over(w).alias("next"), F.sum("n").over(w).alias("ln"), F.sum("s").over(w).alias("ls"), F.sum("n").over(all_).alias("tn"), F.sum("s").over(all_).alias("ts"))
    apart = F.col("ls") / F.col("ln") - (F.col("ts") - F.col("ls")) / (F.col("tn") - F.col("ln"))
    gain = F.when(F.col("next").isNotNull(), F.col("ln") * (F.col("tn") - F.col("ln")) / F.col("tn") * apart * apart).otherwise(0.0)
    best = F.max_by(F.struct("gain", "bin", "next", "ln", "ls", "tn", "ts"), F.struct("gain", -F.col("bin")))
    return run.withColumn("gain", gain).groupBy("fold", "node", "feature").agg(best.alias("c")).select("fold", "node", "feature", "c.*")


def _grow(growing: list[Growing], found: list, bins: list[Bins]) -> bool:
    """Split the nodes of one level, the first feature of equals; True if any was split."""
    best: dict[tuple[int, int], tuple] = {}
    for r in sorted(found, key=lambda r: r.feature):
        growing[r.fold].value[r.node] = r.ts / r.tn
        if r.gain > best.get((r.fold, r.node), (0.0,))[0] * (1 + EQUAL_GAIN):
            best[r.fold, r.node] = (r.gain, r)
    for (fold, node), (_, r) in best.items():
        tree, own = growing[fold], bins[r.feature]
        tree.feature[node], tree.threshold[node] = r.feature, own.largest[r.bin] / 2 + own.least[r.next] / 2
        tree.value[2 * node + 1], tree.value[2 * node + 2] = r.ls / r.ln, (r.ts - r.ls) / (r.tn - r.ln)
    return bool(best)


def _fit_wave(state: DataFrame, bins: list[Bins], starts: np.ndarray, trees: int, rate: float, depth: int) -> list[list]:
    """Of each fold its trees, nested. state: x, own (the number of the fold that leaves the row out, or -1) and y."""
    folds = len(starts)
    held = state.select("x", "own", F.array(*[F.col("y") - float(s) for s in starts]).alias("residuals"))
    forest: list[list[Growing]] = []
    fresh: list[list[Growing]] = []
    for _ in range(trees):
        growing = [Growing(depth) for _ in range(folds)]
        for level in range(depth):
            cells = held.mapInPandas(_histograms(bins, fresh, growing, level, rate), "fold int, node int, feature int, bin int, n double, s double")
            # A candidate for each (fold, node, feature).
            if not _grow(growing, _candidates(cells).collect(), bins):
                break
        forest.append(growing)
        fresh.append(growing)
        if len(fresh) == REFRESH and len(forest) < trees:
            held, fresh = materialize(held.mapInPandas(_updated(fresh, rate), "x array<double>, own int, residuals array<double>"), "boosting"), []
    return [[grown[f].nested() for grown in forest] for f in range(folds)]


def _updated(fresh: list[list[Growing]], rate: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def updated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, left = _matrix(batch), np.vstack(batch.residuals.to_numpy()).copy()
            for tree in fresh:
                for f, own in enumerate(tree):
                    left[:, f] -= rate * own.value[own.place(x)]
            yield pd.DataFrame({"x": batch.x, "own": batch.own, "residuals": list(left)})

    return updated


def _state(table: DataFrame, features: list[str], target: str, *more) -> DataFrame:
    x = F.array(*[F.col(f).cast("double") for f in features])
    return materialize(table.filter(F.col(target).isNotNull()).select(x.alias("x"), F.col(target).cast("double").alias("y"), *more), "boosting")


def fit(table: DataFrame, features: list[str], target: str, trees: int, rate: float, depth: int) -> dict:
    """One forest over all rows that have a target: start, rate and trees (nested [feature, threshold, lower, upper] or a mean)."""
    state = _state(table, features, target)
    start = state.agg(F.avg("y")).first()[0]
    if start is None:
        raise ValueError("trees need rows with a target")
    grown = _fit_wave(state.withColumn("own", F.lit(-1)), make_bins(state, len(features)), np.array([start]), trees, rate, depth)
    return {"kind": "trees", "start": start, "rate": rate, "trees": grown[0]}


def leave_folds_out(table: DataFrame, key: str, fold: str, features: list[str], target: str, trees: int, rate: float, depth: int) -> DataFrame:
    """key, y, p: each row's prediction by trees fitted on the rows of all other folds; with fold = key, leave-one-out.

    Rows without a target are left out, and so are all rows of a fold outside which there are none; a null fold is one of its own.
    Features must not be null. Equal gains go to the first feature and cut; sums are floating, so near-equal ones may go to either.
    """
    from ferrolith.operators.heads import tree_values

    spark, kinds = table.sparkSession, dict(table.dtypes)
    name = F.coalesce(F.col(fold).cast("string"), F.lit("\u0000"))
    state = _state(table, features, target, F.col(key).alias("key"), name.alias("fold"))
    bins = make_bins(state, len(features))
    sums = materialize(state.groupBy("fold").agg(F.sum("y").alias("s"), F.count("*").alias("n")), "boosting-folds")
    total, rows, folds = sums.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    room = max(1, CELLS // (2 ** (depth - 1) * len(features) * max(1, *(len(b.largest) for b in bins), 1)))
    waves = -(-folds // room)
    out = None
    for wave in range(waves):
        mine = F.pmod(F.xxhash64("fold"), F.lit(waves)) == wave
        held = [r for r in sums.filter(mine).orderBy("fold").collect() if r.n < rows]  # about `room` folds
        if not held:
            continue
        numbers = spark.createDataFrame([(r.fold, i) for i, r in enumerate(held)], "fold string, own int")
        dealt = state.join(F.broadcast(numbers), "fold", "left").withColumn("own", F.coalesce("own", F.lit(-1)))
        starts = [(total - r.s) / (rows - r.n) for r in held]
        forests = _fit_wave(dealt, bins, np.array(starts), trees, rate, depth)

        def predicted(batches: Iterator[pd.DataFrame], forests=forests, starts=starts) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x, p = _matrix(batch), np.empty(len(batch))
                for f in np.unique(batch.own):
                    own = batch.own.to_numpy() == f
                    p[own] = tree_values({"start": starts[f], "rate": rate, "trees": forests[f]}, x[own])
                yield pd.DataFrame({key: batch.key, "y": batch.y, "p": p})

        found = materialize(dealt.filter("own >= 0").mapInPandas(predicted, f"{key} {kinds[key]}, y double, p double"), "boosting-wave")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"{key} {kinds[key]}, y double, p double")
