"""Order statistics and ranks without a global sort: counts by range, then a look into one range alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of one counting pass, and the values that are sorted on the driver once a range holds no more.
RANGES, MOST_VALUES = 4096, 50_000


def order_statistic(rows: DataFrame, value: Column | str, place: int):
    """The value at a place counted from 0 in ascending order; nulls are left out. Equal values need no order.

    Each pass counts by ranges of values and goes on inside the range that holds the place, until few enough values are left
    or all in it are equal. The driver sees counts, and at last MOST_VALUES numbers at most.
    """
    rows = rows.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).filter("v IS NOT NULL")
    edge = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).first()
    if not 0 <= place < edge.n:
        raise IndexError(f"no value at place {place} of {edge.n}")
    low, high, n = edge.low, edge.high, edge.n
    while low < high:
        inside = rows.filter(F.col("v").between(low, high))
        if n <= MOST_VALUES:
            return sorted(r.v for r in inside.collect())[place]
        share = (F.col("v") / 2 - low / 2) / F.lit(high / 2 - low / 2)
        counted = inside.groupBy(F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).alias("range")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in counted.orderBy("range").collect():
            if place < r.n:
                low, high, n = r.low, r.high, r.n
                break
            place -= r.n
    return low


def nth_row(rows: DataFrame, value: str, key: str, place: int) -> DataFrame:
    """The row at a place in the order of (value, key), both numbers; one row. Keys are distinct."""
    at = order_statistic(rows, value, place)
    ties = rows.filter(F.col(value) == F.lit(at))
    before = rows.filter(F.col(value) < F.lit(at)).count()
    return ties.filter(F.col(key) == F.lit(order_statistic(ties, key, place - before)).cast(dict(rows.dtypes)[key]))


def head_middle_tail(rows: DataFrame, value: str, key: str, head: int = 2, tail: int = 3) -> DataFrame:
    """The first `head` rows, the one in the middle and the last `tail` by (value, key), with part and place; rows may stand in several parts."""
    n = rows.count()
    if not n:
        return rows.withColumns({"part": F.lit(None).cast("string"), "place": F.lit(None).cast("int")})
    placed = lambda part, name, order: part.withColumn("part", F.lit(name)).withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)  # noqa: E731  over a few rows
    first = placed(rows.orderBy(value, key).limit(head), "head", [value, key])
    middle = placed(nth_row(rows, value, key, n // 2), "middle", [value])
    last = placed(rows.orderBy(F.desc(value), F.desc(key)).limit(tail), "tail", [value, key])
    return first.unionByName(middle).unionByName(last)


def average_ranks(rows: DataFrame, by: list[str], value: str, rank: str, parts: int = 256) -> DataFrame:
    """by, value and rank of each distinct value, ties sharing their mean place. Null values have no rank.

    Values are counted first; each group's distinct values are cut at approximate quantiles, and places are counted within a
    part after the rows of the parts before it: no task sorts a whole group.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000)).alias("cuts"))
    dealt = counts.join(cuts, by).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    sizes = dealt.groupBy(*by, "part").agg(F.sum("n").alias("size"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # `parts` rows a group
    within = F.sum("n").over(Window.partitionBy(*by, "part").orderBy(value))
    placed = dealt.join(sizes.select(*by, "part", ahead.alias("ahead")), [*by, "part"])
    return placed.select(*by, value, (F.col("ahead") + within - (F.col("n") - 1) / 2).alias(rank))
