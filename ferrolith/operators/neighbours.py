"""The exact nearest neighbour of another block, by pivots: tiles of the gallery that the triangle inequality rules out are not compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ferrolith.functions.vectors import doubles, norm
from ferrolith.session import materialize

#: Numbers of vectors that a tile holds at most on average; a task holds one tile of the gallery and one group of queries of that size.
TILE_NUMBERS = 2_000_000
#: Most pivots, and numbers in one matrix of bounds or similarities.
MOST_PIVOTS, MATRIX = 512, 1_000_000
#: Rows that are handed on together.
HANDED = 5_000
#: Similarities are compared to nine digits. Angles near 0 are known to 2e-8 only; bounds give way by more than both.
DIGITS, SLACK = 9, 1e-6


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    found = x @ pivots.T
    return np.arccos(np.clip(found, -1, 1, out=found), out=found)


class Tiles:
    """What is known of all tiles: a tile's pivot, its least and largest angle to it, its size, and its one block, or none if it holds several."""

    def __init__(self, rows: list, pivots: np.ndarray):
        self.pivots, self.ids = pivots, np.array([r.tile for r in rows], np.int64)
        self.cell, self.low, self.high, self.n = (np.array([r[c] for r in rows], k) for c, k in (("cell", np.int64), ("low", float), ("high", float), ("n", np.int64)))
        self.blocks = np.array([r.first if r.first == r.last else None for r in rows], object)

    def most_similar(self, x: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """(len(x), tiles): no row of another block in the tile can be more similar; -inf where the tile has none."""
        away = _angles(x, self.pivots)[:, self.cell]
        least = np.clip(np.maximum(away - self.high, self.low - away), 0, np.pi)
        bound = np.cos(least)
        bound[blocks[:, None] == self.blocks[None, :]] = -np.inf
        return bound


def _chunks(batch: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    step = max(1, MATRIX // max(1, width))
    for i in range(0, len(batch), step):
        yield batch.iloc[i : i + step]


def unit_rows(rows: DataFrame, key: str, block: str, vector: str) -> DataFrame:
    """key, block, v: the rows that have a key and a direction, as vectors of length 1; block as text, empty for none."""
    v = doubles(F.col(vector))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    name = F.coalesce(F.concat(F.lit("="), F.col(block).cast("string")), F.lit(""))
    plain = rows.filter(F.col(key).isNotNull() & finite).select(F.col(key).alias("key"), name.alias("block"), v.alias("v")).withColumn("length", norm(F.col("v"))).filter("length > 0")
    return plain.select("key", "block", F.transform("v", lambda x: x / F.col("length")).alias("v"))


def tiled_gallery(unit: DataFrame, wanted: int) -> tuple[DataFrame, Tiles]:
    """(key, block, v, tile) written to the shared folder, and what is known of the tiles.

    Pivots are up to MOST_PIVOTS rows with the least hashes: a fixed number. Rows are dealt by `wanted` ranges of (nearest pivot, angle), so
    that a cell with most rows is many tiles, each a ring about its pivot; equal rows are told apart by their keys' hashes.
    """
    chosen = unit.orderBy(F.xxhash64("key"), "key").limit(min(MOST_PIVOTS, wanted)).select("v").collect()  # a bounded number of vectors
    pivots = np.array([r.v for r in chosen]).reshape(len(chosen), -1)
    kind = dict(unit.dtypes)["key"]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _chunks(batch, len(pivots)):
                angles = _angles(np.vstack(part.v), pivots)
                cell = angles.argmin(1)
                yield part.assign(cell=cell, angle=angles[np.arange(len(part)), cell])

    schema = f"key {kind}, block string, v array<double>, cell int, angle double"
    dealt = unit.mapInPandas(placed, schema).repartitionByRange(wanted, "cell", "angle", F.xxhash64("key"))
    gallery = materialize(dealt.withColumn("tile", F.spark_partition_id().cast("bigint") * MOST_PIVOTS + F.col("cell")), "gallery")
    # Tiles: at most one a range and one more a pivot.
    known = gallery.groupBy("tile").agg(F.first("cell").alias("cell"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"), F.min("block").alias("first"), F.max("block").alias("last")).orderBy("tile").collect()
    return gallery, Tiles(known, pivots)


def _vectors(rows: pa.Table) -> np.ndarray:
    """v as a matrix; vectors of one chunk aren't copied."""
    parts = [c.flatten().to_numpy() for c in rows["v"].chunks]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).reshape(len(rows), -1)


def _compare(asked: DataFrame, gallery: DataFrame, kind: str, most: int) -> DataFrame:
    """key, neighbour, similarity: of each asked row (key, block, v, tile) the best of its tile. A tile that many rows ask for is copied to several tasks."""
    demand = asked.groupBy("tile").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = asked.join(demand, "tile").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    renamed = gallery.select(*[F.col(c).alias(c) for c in ("key", "block", "v", "tile")])  # asked may be the same table
    copies = renamed.join(demand, "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    arrow_kind = to_arrow_type(asked.schema["key"].dataType)
    schema = pa.schema([("key", arrow_kind), ("neighbour", arrow_kind), ("similarity", pa.float64())])

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        found = [pa.table({c: pa.array([], schema.field(c).type) for c in schema.names})]
        if len(x) and len(y):
            y = y.take(pc.sort_indices(y, sort_keys=[("key", "ascending")]))
            blocks, right = pc.unique(y["block"]), _vectors(y).T
            right_codes = pc.index_in(y["block"], blocks).to_numpy()
            step = max(1, MATRIX // len(y))
            for i in range(0, len(x), step):
                part = x.slice(i, step)
                codes = pc.fill_null(pc.index_in(part["block"], blocks), -1).to_numpy()
                similar = _vectors(part) @ right
                np.round(similar, DIGITS, out=similar)
                similar[codes[:, None] == right_codes[None, :]] = -np.inf
                top = similar.argmax(1)
                value = similar[np.arange(len(part)), top]
                at = np.flatnonzero(np.isfinite(value))
                found.append(pa.table([part["key"].take(at), y["key"].take(top[at]), value[at]], schema.names).cast(schema))
        return pa.concat_tables(found)

    on = ["tile", "part"]
    return dealt.select("key", "block", "v", *on).groupBy(*on).cogroup(copies.select("key", "block", "v", *on).groupBy(*on)).applyInArrow(best, f"key {kind}, neighbour {kind}, similarity double")


def _best(found: DataFrame) -> DataFrame:
    top = F.min_by(F.struct("neighbour", "similarity"), F.struct(-F.col("similarity"), F.col("neighbour")))
    return found.groupBy("key").agg(top.alias("best")).select("key", "best.*")


def nearest_neighbour(rows: DataFrame, key: str, block: str, vector: str, counted: dict | None = None, tile_numbers: int | None = None) -> DataFrame:
    """key, neighbour, similarity: the most similar row (cosine, to nine digits) of another block, the smaller key among equals.

    Each row is compared first with the tile that may hold its most similar row; what it finds there rules out every tile whose bound is
    below it, and the row goes to the remaining tiles alone. How many those are is up to the data: where all rows are about as far from
    each other, as in high dimensions without clusters, few tiles go. counted, if given, gets the pairs compared and all pairs.

    Keys are unique. Rows without a key, or whose vector is null, has null or non-finite components or no length, are neither asked for
    nor found. Rows without a block are a block of their own; a row without a row of another block is left out.
    """
    unit, kind = unit_rows(rows, key, block, vector), dict(rows.dtypes)[key]
    n, width = unit.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    most = max(1, (tile_numbers or TILE_NUMBERS) // width)
    if n <= most:  # one tile holds all: nothing to rule out
        if counted is not None:
            counted.update(compared=n * n, all=n * n)
        one = unit.withColumn("tile", F.lit(0).cast("bigint"))
        return _best(_compare(one, one, kind, most)).select(F.col("key").alias(key), "neighbour", "similarity")
    gallery, tiles = tiled_gallery(unit, -(-n // most))
    asked = f"key {kind}, block string, v array<double>, tile bigint"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _chunks(batch, len(tiles.ids)):
                bound = tiles.most_similar(np.vstack(part.v), part.block.to_numpy(object))
                some = bound.max(1) > -np.inf
                yield part[some].assign(tile=tiles.ids[bound.argmax(1)[some]])

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _chunks(batch, len(tiles.ids)):
                bound = tiles.most_similar(np.vstack(part.v), part.block.to_numpy(object))
                open_ = (bound >= part.similarity.fillna(-2.0).to_numpy()[:, None] - SLACK) & (tiles.ids[None, :] != part.tile.to_numpy()[:, None])
                at, tile = np.nonzero(open_)
                for i in range(0, len(at), HANDED):
                    yield part.iloc[at[i : i + HANDED]][["key", "block", "v"]].assign(tile=tiles.ids[tile[i : i + HANDED]])

    begun = gallery.select("key", "block", "v").mapInPandas(first, asked)
    found = materialize(_compare(begun, gallery, kind, most), "first-neighbours")
    rest = begun.join(found.select("key", "similarity"), "key", "left").mapInPandas(others, asked)
    rest = materialize(rest, "open-tiles") if counted is not None else rest
    if counted is not None:
        size = {int(i): int(k) for i, k in zip(tiles.ids, tiles.n)}
        per_tile = begun.select("tile").unionAll(rest.select("tile")).groupBy("tile").count().collect()  # a row for each tile
        counted.update(compared=sum(size[r.tile] * r["count"] for r in per_tile), all=n * n)
    top = _best(found.unionByName(_compare(rest, gallery, kind, most)))
    return top.select(F.col("key").alias(key), "neighbour", "similarity")
