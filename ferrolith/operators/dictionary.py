"""A dictionary of distinct strings: each is resolved once against the alias tables, and the small result is joined back.

Columns of labels and codes repeat a few distinct strings over many rows. Their distinct values are cut into runs of tokens
that meet the alias phrases by equality; the result is written as a table, so that what is built on it has columns in its plan
in place of an expression over all aliases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.text import bind, canonical_tokens
from ferrolith.operators.aliases import alias_phrases
from ferrolith.session import materialize


def string_dictionary(rows: DataFrame, columns: list[str], tables: dict[str, dict[str, str]]) -> DataFrame:
    """raw, bearers (an array: how many rows have the string in each column), and for each table by its name a struct of node_id and ambiguous.

    A row for each distinct string that holds a phrase or stands in several rows; null and blank strings have none. The phrase with
    most tokens wins; several of that length with different targets make the string ambiguous, without a node. One shuffle of
    strings, combined in each task before; all later steps keep its partitioning.
    """
    spark = rows.sparkSession
    phrases = [(name, list(p), len(p), node) for name, aliases in tables.items() for p, node in alias_phrases(aliases).items()]
    known = spark.createDataFrame(phrases, "table string, phrase array<string>, length int, node_id string")
    longest = max((length for _, _, length, _ in phrases), default=1)
    fields = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("raw")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    counts = fields.filter("raw IS NOT NULL AND raw <> ''").groupBy("raw").agg(*[F.count_if(F.col("i") == i).alias(f"n{i}") for i in range(len(columns))])
    cut = counts.select("raw", F.array(*[f"n{i}" for i in range(len(columns))]).alias("bearers"), canonical_tokens(F.col("raw")).alias("tokens"))
    each = cut.select("raw", "bearers", F.explode_outer(F.array_distinct(_runs(F.col("tokens"), longest))).alias("phrase"))
    met = each.join(F.broadcast(known), "phrase", "left")  # fixed tables of aliases
    found = met.groupBy("raw").agg(F.first("bearers").alias("bearers"), *[F.collect_set(F.when(F.col("table") == name, F.struct("length", "node_id"))).alias(name) for name in tables])
    known_or_repeated = reduce(lambda a, b: a | b, [F.size(name) > 0 for name in tables], F.array_max("bearers") > 1)
    return materialize(found.filter(known_or_repeated).select("raw", "bearers", *[_longest(F.col(name)).alias(name) for name in tables]), "strings")


def _longest(found: Column) -> Column:
    """node_id and ambiguous from the phrases found, each with its length."""
    nodes = bind(F.array_max(F.transform(found, lambda x: x["length"])), lambda n: F.array_distinct(F.transform(F.filter(found, lambda x: x["length"] == n), lambda x: x["node_id"])))
    return bind(nodes, lambda ns: F.struct(F.when(F.size(ns) == 1, F.get(ns, F.lit(0))).alias("node_id"), (F.size(ns) > 1).alias("ambiguous")))


def _runs(tokens: Column, longest: int) -> Column:
    """All runs of one to `longest` neighbouring tokens."""
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - k + 1, F.lit(1))), lambda i: F.slice(tokens, i, k))
    return F.concat(*[F.when(F.size(tokens) >= k, of(k)).otherwise(F.array().cast("array<array<string>>")) for k in range(1, longest + 1)])


def resolve_fields(rows: DataFrame, columns: list[str], tables: dict[str, dict[str, str]], bearers: str | None = None) -> DataFrame:
    """rows with, for each table by its name, a struct of node_id and ambiguous over all columns together.

    Fields must not be ambiguous nor name different nodes: else the row is ambiguous and has no node. rows keeps all its columns, but
    for those with the names of tables. bearers: a column to add, how many rows have this row's strings in each column (0 where null or blank).
    """
    words = string_dictionary(rows, columns, tables)
    found, met, counts = rows, {name: [] for name in tables}, []
    for i, column in enumerate(columns):
        at = f"__dictionary_{i}"  # beside the caller's columns for a while
        found = found.join(words.select(F.struct("*").alias(at)), F.col(column) == F.col(f"{at}.raw"), "left")
        for name in tables:
            met[name].append(F.col(f"{at}.{name}"))
        counts.append(F.when(F.coalesce(F.col(column), F.lit("")) == "", F.lit(0)).otherwise(F.coalesce(F.get(F.col(f"{at}.bearers"), F.lit(i)), F.lit(1))))
    added = {}
    for name, parts in met.items():
        clash = reduce(lambda a, b: a | b, [F.coalesce(p["ambiguous"], F.lit(False)) for p in parts])
        nodes = F.array_distinct(F.array_compact(F.array(*[p["node_id"] for p in parts])))
        several = clash | (F.size(nodes) > 1)
        added[name] = F.struct(F.when(~several, F.get(nodes, F.lit(0))).alias("node_id"), several.alias("ambiguous"))
    if bearers:
        added[bearers] = F.array(*counts)
    return found.select(*[F.col(f"`{c}`") for c in rows.columns if c not in added], *[c.alias(name) for name, c in added.items()])
