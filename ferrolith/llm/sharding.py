"""Sharding by a hierarchical weighted hash tree (DataFrame operations only).

A tree has regions, racks and shards. A row descends it: at each level every child draws -ln(u) / weight with u hashed
from the row's key and the child's identity, and the smallest draw wins; a child wins in proportion to its weight, and a
change of weight moves rows only into or out of the subtree whose weight changed. A new shard comes as a region of its
own, so that growth moves rows into the new shard alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.llm.common import materialize, text_or_empty

#: Buckets that number a shard's rows: slots are counted within a bucket, after the rows of the buckets before it.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Node:
    """A subtree; leaves carry the shard's number. name decides the draws, so a renamed node is a new node."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = ()

    @property
    def total(self) -> float:
        return self.weight if self.shard is not None else sum(c.total for c in self.children)


def tree_of(shards: int, racks: int = 2, per_rack: int = 2, base: int = 8, weights: dict[int, float] | None = None) -> Node:
    """base shards (fewer if shards is less) fill regions of racks x per_rack; each shard from base on is a region of its own.

    Growth from base or more shards by one moves rows only into the new shard.
    """
    if shards < 1:
        raise ValueError("a tree needs at least one shard")
    leaf = lambda i: Node(f"shard-{i}", (weights or {}).get(i, 1.0), i)
    regular, regions = min(shards, base), []
    for start in range(0, regular, racks * per_rack):
        ids = range(start, min(start + racks * per_rack, regular))
        inside = [Node(f"rack-{ids[k]}", children=tuple(leaf(i) for i in ids[k : k + per_rack])) for k in range(0, len(ids), per_rack)]
        regions.append(Node(f"region-{start}", children=tuple(inside)))
    regions += [Node(f"region-{i}", children=(Node(f"rack-{i}", children=(leaf(i),)),)) for i in range(regular, shards)]
    return Node("root", children=tuple(regions))


def draw(key: Column, node: Node) -> Column:
    """An exponential draw with the node's weight as its rate; u has 53 bits and is never 0 or 1."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(u) / F.lit(float(node.total))


def descend(key: Column, node: Node) -> Column:
    """The shard at the end of the row's way down from node."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.total > 0]
    if not live:
        raise ValueError(f"{node.name} has no child of positive weight")
    if len(live) == 1:
        return descend(key, live[0])
    best = reduce(lambda a, b: F.least(a, b), [F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)])["i"]
    way = F.when(best == 0, descend(key, live[0]))
    for i, c in enumerate(live[1:], 1):
        way = way.when(best == i, descend(key, c))
    return way


def assign(docs: DataFrame, tree: Node, grown: Node | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1; null texts have no bytes. A null doc_id is a key like any other. Rows that
    repeat a doc_id share its shard and get slots of their own. Slots run from 0 without gaps within a shard, in no
    promised order. An empty table gives an empty result; columns other than doc_id and text are not read.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.encode(text_or_empty(), "UTF-8")
    placed = docs.select(
        F.col("doc_id"),
        (F.octet_length(text_or_empty()) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        descend(key, tree).cast("int").alias("shard"),
        (descend(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        # A row's place in its task deals out rows that repeat an id; the table below makes it lasting.
        F.pmod(F.xxhash64(key, F.lit("slot"), F.monotonically_increasing_id()), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"),
    )
    placed = materialize(placed, "placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # at most shards x SLOT_BUCKETS
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("first_slot"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    return placed.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (within - 1 + F.col("first_slot")).cast("bigint").alias("slot"), "grown_shard"
    )
