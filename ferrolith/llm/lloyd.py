"""Plain Lloyd clustering of integer vectors.

Centroids are few and are broadcast. Each task takes integer squared differences to every centroid in NumPy and the lowest
index among the nearest; its sums by cluster are integers too, and are merged by a grouping. So results are exact and the
same in any partitioning. What reaches the driver are `clusters` rows of sums in each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.common import give_back, materialize, take_worker

#: Quantised components end at this size, so that a squared distance of up to 64 of them is a long.
MOST_COMPONENT = 2**27
#: Rows that a task compares with a centroid at once.
BLOCK_ROWS = 4096


def quantized(vectors: DataFrame, dims: int = 64, scale: int = 256, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, v (array of ints): floor(scale * x) of every vector with exactly dims components, none null, NaN or infinite.

    Other vectors are left out. Components beyond MOST_COMPONENT end there. Null and repeated ids stay, row by row.
    """
    x = F.col(column).cast("array<double>")
    whole = (F.size(x) == dims) & F.forall(x, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    least, most = F.lit(float(-MOST_COMPONENT)), F.lit(float(MOST_COMPONENT))
    return vectors.filter(whole).select(F.col(key).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(F.greatest(least, F.least(most, c * scale))).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, clusters: int, seed: int = 2) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of `seed:vec_id`, in that order; null ids come last, equal hashes go by components."""
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [list(r.v) for r in hashed.orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()]  # clusters rows


def _nearest(block, centroids):
    """The nearest centroid's number, the smaller among equals, and the squared distance, of each row of a block of integers."""
    import numpy as np

    distance = np.empty((len(centroids), len(block)), np.int64)
    for k, centroid in enumerate(centroids):
        difference = block - centroid
        np.einsum("ij,ij->i", difference, difference, out=distance[k])
    cluster = distance.argmin(axis=0)
    return cluster, distance[cluster, np.arange(len(block))]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, object]]:
    """Parts of the frames with their vectors as a matrix of int64."""
    import numpy as np

    for frame in frames:
        for i in range(0, len(frame), BLOCK_ROWS):
            part = frame.iloc[i : i + BLOCK_ROWS]
            yield part, np.stack(part["v"].to_numpy()).astype(np.int64)


def _sums(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        take_worker("lloyd")
        centroids = shared.value
        totals, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, block in _blocks(frames):
            cluster, _ = _nearest(block, centroids)
            counts += np.bincount(cluster, minlength=len(centroids))
            for k in np.unique(cluster):
                totals[k] += block[cluster == k].sum(axis=0)
        there = np.flatnonzero(counts)
        if len(there):
            yield pd.DataFrame({"cluster": there, "n": counts[there], "sums": list(totals[there])})
        give_back()

    return summed


def _assigned(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def assigned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_worker("lloyd")
        for part, block in _blocks(frames):
            cluster, distance = _nearest(block, shared.value)
            yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": cluster, "distance": distance})
        give_back()

    return assigned


def next_centroids(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every centroid that has vectors becomes their componentwise floor(sum / count), in whole numbers."""
    import numpy as np

    shared = rows.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))
    parts = rows.select("v").mapInPandas(_sums(shared), "cluster int, n bigint, sums array<bigint>")
    total = lambda i: F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)"))
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[total(i) for i in range(len(centroids[0]))]).alias("sums"))
    found = list(centroids)
    for r in merged.collect():  # a row for each cluster
        found[r.cluster] = [int(s) // r.n for s in r.sums]
    shared.unpersist()
    return found


def lloyd(vectors: DataFrame, clusters: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of each kept vector after all rounds; the final centroids).

    Every row is a vector of its own, repeated and null ids too. With fewer vectors than clusters each of them is a first centroid;
    an empty table, or one without a whole vector, gives no rows and no centroids. Columns other than vec_id and embedding are not read.
    """
    import numpy as np

    rows = materialize(quantized(vectors, dims, scale), "lloyd-vectors")
    centroids = first_centroids(rows, clusters, seed)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids)
    shared = rows.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))
    return rows.mapInPandas(_assigned(shared), "vec_id bigint, cluster int, distance bigint"), centroids


def cluster_report(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """assigned with cluster_inertia, inertia (distance summed over the cluster and over all) and centroid_sha256. Sums beyond a long are null."""
    rows = materialize(assigned, "lloyd-assigned")
    sums = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row for each cluster
    long = lambda x: x if x < 2**63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = [(k, long(sums.get(k, 0)), long(sum(sums.values())), digest(c)) for k, c in enumerate(centroids)]
    known = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each cluster
