"""Connected components of a table of links, by rounds of large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.session import materialize


def star_step(links: DataFrame, large: bool) -> DataFrame:
    """Every node's larger (large) or smaller neighbours, and the node itself, linked to the least of them all. links: a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))  # one row a node: a hub's side of the join is split by AQE
    joined = both.join(least, "a")
    found = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return found.filter("a <> b").distinct()


#: Links of one group that a task joins by itself; those of larger groups go through rounds over the whole cluster.
MOST_LINKS = 200_000


def least_nodes(group: np.ndarray, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, node, root: for each node of links within groups the least node that it is joined with. All groups are joined at once."""
    groups, nodes = np.concatenate((group, group)), np.concatenate((one, other))
    by = np.lexsort((nodes, groups))
    new = np.concatenate(([True], (groups[by][1:] != groups[by][:-1]) | (nodes[by][1:] != nodes[by][:-1])))[: len(by)]
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(new) - 1
    a, b = place[: len(one)], place[len(one) :]
    label = np.arange(int(new.sum()))
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    first = by[new]
    return groups[first], nodes[first], nodes[first][label]


def grouped_components(links: DataFrame) -> DataFrame:
    """name, node, root: for each node in links (name: string, one, other: bigint) the least node that it is connected with in its group, the name.

    Groups of up to MOST_LINKS links are joined whole, many in one task and without rounds; larger ones by components. Links with a null go.
    """
    links = materialize(links.select("name", F.col("one").cast("bigint"), F.col("other").cast("bigint")).dropna(), "grouped-links")
    large = materialize(links.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_LINKS).select("name"), "large-groups")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list = []
        for batch in batches:
            kept.append(batch)
            if batch.name.iloc[0] == batch.name.iloc[-1] and len(kept) < 20:  # the group may go on
                continue
            rows = pd.concat(kept)
            last = rows.name.iloc[-1]
            yield from solved(rows[rows.name != last])
            kept = [rows[rows.name == last]]
        if kept:
            yield from solved(pd.concat(kept))

    def solved(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(rows):
            codes, names = pd.factorize(rows.name)
            group, node, root = least_nodes(codes, rows.one.to_numpy(), rows.other.to_numpy())
            yield pd.DataFrame({"name": names.to_numpy()[group], "node": node, "root": root})

    some = links.join(large, "name", "left_anti") if large.limit(1).count() else links
    found = some.repartition("name").sortWithinPartitions("name").mapInPandas(joined, "name string, node bigint, root bigint")
    if some is links:
        return found
    ends = lambda end: F.struct("name", F.col(end).alias("node"))
    rest = components(links.join(large, "name", "left_semi").select(ends("one").alias("a"), ends("other").alias("b")))
    return found.unionByName(rest.select("node.name", "node.node", F.col("root.node").alias("root")))


def components(links: DataFrame) -> DataFrame:
    """node, root: for each node in links (a, b), the least node that it is connected with. Nodes are of one orderable type; links with a null go.

    A round writes the new links to the shared folder; rounds end when the links stay as they are.
    """
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    links, mark = materialize(ordered, "links"), None
    while True:
        now = tuple(links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("b", "a").cast("decimal(20,0)")), F.lit(0))).first())
        if now == mark or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark, links = now, materialize(star_step(star_step(links, True), False), "links")
