"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.common import join_groups, remove_path, scratch_path, write_table


def _stars(links: DataFrame, large: bool, scope: str) -> DataFrame:
    """One step: every node's larger (large) or smaller neighbours and itself are linked to the smallest of them all."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = write_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), f"{scope}/least-{large}")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_groups(both, least, ["a"], total, "n", "inner")  # a star's centre may hold most links
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return write_table(out.filter("a <> b").distinct(), f"{scope}/links-{large}")


def components(links: DataFrame) -> DataFrame:
    """node, root: for each node in links (a, b), the smallest node that it is connected with. Nodes are not null.

    Rounds go on until the links stay as they are; their number grows with the logarithm of the longest path, squared at worst. Each
    round's tables are removed after the next one.
    """
    spark, folder = links.sparkSession, scratch_path(links.sparkSession, "components")
    links = write_table(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/round-0/links")
    mark, round_ = None, 0
    while True:
        round_ += 1
        scope = f"{folder}/round-{round_}"
        links = _stars(_stars(links, True, scope), False, scope)
        remove_path(spark, f"{folder}/round-{round_ - 1}")
        now = tuple(links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if now == mark:
            break
        mark = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
