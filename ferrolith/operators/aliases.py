"""From messy source strings to vocabulary ids, as joins with small alias tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrolith.functions.text import THERMAL_STEP, bind, canonical_tokens, count_temperatures, padded, tokens_of

# Spellings of grades and of conditions as sources write them, and exact thermal routes.
GRADE_ALIASES = {
    "AC": "grade/ferrous/uhcs_ac",
    "AC1": "grade/ferrous/uhcs_ac1",
    "AISI 1018": "grade/ferrous/aisi_1018",
    "1018": "grade/ferrous/aisi_1018",
    "AISI 1045": "grade/ferrous/aisi_1045",
    "1045": "grade/ferrous/aisi_1045",
    "0.45C": "grade/ferrous/medium_carbon",
    "AISI 1080": "grade/ferrous/aisi_1080",
    "1080": "grade/ferrous/aisi_1080",
    "0.80C": "grade/ferrous/high_carbon",
    "AISI 4140": "grade/ferrous/aisi_4140",
    "4140": "grade/ferrous/aisi_4140",
    "low carbon steel": "grade/ferrous/low_carbon",
    "mild steel": "grade/ferrous/low_carbon",
    "medium carbon steel": "grade/ferrous/medium_carbon",
    "high carbon steel": "grade/ferrous/high_carbon",
    "ultrahigh carbon steel": "grade/ferrous/ultrahigh_carbon",
    "AA 6061": "grade/aluminum/aa_6061",
    "6061": "grade/aluminum/aa_6061",
    "AA 7075": "grade/aluminum/aa_7075",
    "7075": "grade/aluminum/aa_7075",
}
CONDITION_ALIASES = {
    "as cast": "condition/as_cast",
    "hot rolled": "condition/hot_rolled",
    "cold drawn": "condition/cold_drawn",
    "annealed": "condition/anneal",
    "full anneal": "condition/anneal/full",
    "spheroidized": "condition/anneal/spheroidize",
    "spheroidized anneal": "condition/anneal/spheroidize",
    "subcritical anneal": "condition/anneal/subcritical",
    "process anneal": "condition/anneal/subcritical",
    "normalized": "condition/austenitize/air_cool",
    "air cooled": "condition/austenitize/air_cool",
    "AR": "condition/austenitize/air_cool",
    "WQ": "condition/austenitize/water_quench",
    "water quenched": "condition/austenitize/water_quench",
    "OQ": "condition/austenitize/oil_quench",
    "oil quenched": "condition/austenitize/oil_quench",
    "FC": "condition/austenitize/furnace_cool",
    "furnace cooled": "condition/austenitize/furnace_cool",
    "Q": "condition/austenitize/unspecified_quench",
    "quenched": "condition/austenitize/unspecified_quench",
    "quenched & tempered": "condition/quench_temper",
    "hardened & tempered": "condition/quench_temper",
}
WATER_QUENCH = "condition/austenitize/water_quench"
# Fixed values: (Celsius, minutes) -> leaf below WATER_QUENCH.
EXACT_ROUTES = {
    (700, 5): "t700c_5m", (750, 5): "t750c_5m", (800, 5): "t800c_5m", (800, 90): "t800c_90m", (800, 180): "t800c_3h", (800, 480): "t800c_8h",
    (800, 1440): "t800c_24h", (800, 5100): "t800c_85h", (900, 90): "t900c_90m", (970, 180): "t970c_3h", (970, 480): "t970c_8h",
    (970, 1440): "t970c_24h", (970, 2880): "t970c_48h", (1000, 5): "t1000c_5m",
}


class AliasTableError(ValueError):
    """An alias without tokens, or one spelling with two targets."""


def alias_phrases(aliases: dict[str, str]) -> dict[tuple[str, ...], str]:
    """canonical tokens -> node id of a fixed table."""
    found: dict[tuple[str, ...], str] = {}
    for alias, node in sorted(aliases.items()):
        phrase = tuple(tokens_of(alias))
        if not phrase or found.setdefault(phrase, node) != node:
            raise AliasTableError(f"alias {alias!r} is empty or has several targets")
    return found


def alias_frame(spark: SparkSession, aliases: dict[str, str]) -> DataFrame:
    """phrase (canonical tokens), node_id: one row for each distinct phrase."""
    return spark.createDataFrame([(list(p), n) for p, n in alias_phrases(aliases).items()], "phrase array<string>, node_id string")


def check_alias_targets(aliases: dict[str, str], vocabulary, axis: str) -> None:
    vocabulary.require(aliases.values(), axis)


def match_aliases(rows: DataFrame, key: str, tokens: Column, aliases: DataFrame, longest: int = 8) -> DataFrame:
    """key, node_id, ambiguous for rows that contain a phrase of the table.

    The phrase with most tokens wins; phrases of that length with different targets make the row ambiguous, without a node. Every
    run of up to `longest` tokens is looked up by equality, so that the work grows with the rows alone.
    """
    n = F.size("tokens")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.slice("tokens", i, k))).otherwise(F.array().cast("array<array<string>>"))))
    each = rows.select(key, tokens.alias("tokens")).select(key, F.explode(F.array_distinct(grams)).alias("phrase"))
    hits = each.join(F.broadcast(aliases), "phrase").withColumn("length", F.size("phrase"))  # aliases: a fixed table
    best = hits.groupBy(key, "length").agg(F.collect_set("node_id").alias("nodes")).groupBy(key).agg(F.max_by("nodes", "length").alias("nodes"))
    several = F.size("nodes") > 1
    return best.select(key, F.when(~several, F.get("nodes", F.lit(0))).alias("node_id"), several.alias("ambiguous"))


def normalize_strings(rows: DataFrame, key: str, column: str, spark: SparkSession, aliases: dict[str, str]) -> DataFrame:
    """Every row's key with node_id (null: no phrase, ambiguous, or null input) and ambiguous."""
    found = match_aliases(rows.filter(F.col(column).isNotNull()), key, canonical_tokens(F.col(column)), alias_frame(spark, aliases))
    return rows.select(key).join(found, key, "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def match_column(raw: Column, aliases: dict[str, str]) -> tuple[Column, Column]:
    """(node_id, ambiguous) as an expression over a fixed alias table, for use inside other projections.

    The table is a literal; the tokens and the nodes found are bound once, so that the expression stays small where it is used. For
    several fields or tables, `dictionary.string_dictionary` resolves each distinct string once instead.
    """
    table = F.array(*[F.struct(F.lit(" " + " ".join(p) + " ").alias("phrase"), F.lit(len(p)).alias("length"), F.lit(n).alias("node_id")) for p, n in alias_phrases(aliases).items()])
    hits = bind(padded(canonical_tokens(raw)), lambda text: F.filter(table, lambda a: F.contains(text, a["phrase"])))

    def longest(found: Column) -> Column:
        top = F.array_max(F.transform(found, lambda a: a["length"]))
        return bind(top, lambda n: F.array_distinct(F.transform(F.filter(found, lambda a: a["length"] == n), lambda a: a["node_id"])))

    result = bind(bind(hits, longest), lambda nodes: F.struct(F.when(F.size(nodes) == 1, F.get(nodes, F.lit(0))).alias("node"), F.coalesce(F.size(nodes) > 1, F.lit(False)).alias("clash")))
    return result["node"], F.coalesce(result["clash"], F.lit(False))


def agree(raws: list[Column], aliases: dict[str, str]) -> tuple[Column, Column]:
    """One node from several fields: fields must not be ambiguous nor disagree."""
    pairs = [match_column(r, aliases) for r in raws]
    nodes = F.array_distinct(F.array_compact(F.array(*[n for n, _ in pairs])))
    clash = reduce(lambda a, b: a | b, [a for _, a in pairs]) | (F.size(nodes) > 1)
    return F.when(~clash & (F.size(nodes) == 1), F.get(nodes, F.lit(0))), clash


def structured_condition(route: Column, temperature: Column, temperature_unit: Column, hold: Column, hold_unit: Column) -> Column:
    """The exact leaf for a route, temperature in C and hold in M or H; else null. The route must equal an alias as a whole."""
    unit = F.upper(F.trim(hold_unit))
    minutes = F.when(unit == "M", hold).when(unit == "H", hold * 60)
    tokens = canonical_tokens(route)
    routes = [F.array(*[F.lit(t) for t in p]) for p, n in alias_phrases(CONDITION_ALIASES).items() if n == WATER_QUENCH]
    whole = bind(tokens, lambda t: reduce(lambda a, b: a | b, [t == r for r in routes]))
    leaf = F.lit(None).cast("string")
    for (celsius, held), name in EXACT_ROUTES.items():
        leaf = F.when((temperature == float(celsius)) & (minutes == float(held)), F.lit(f"{WATER_QUENCH}/{name}")).otherwise(leaf)
    return F.when(whole & (F.upper(F.trim(temperature_unit)) == "C"), leaf)


def is_close(a: Column, b: Column, rel: float = 1e-9) -> Column:
    return F.abs(a - b) <= rel * F.greatest(F.abs(a), F.abs(b))


def exact_condition(label: Column, cool: Column, temperature: Column, temperature_unit: Column, hold: Column, hold_unit: Column) -> Column:
    """A water-quench leaf if the label's one thermal step agrees with the structured columns; else null."""
    step = lambda g: F.regexp_extract(label, THERMAL_STEP, g)
    factor = lambda u: F.when(F.upper(F.trim(u)) == "H", 60.0).otherwise(1.0)
    single = (F.size(F.regexp_extract_all(label, F.lit(THERMAL_STEP), 1)) == 1) & (count_temperatures(label) == 1)
    agrees = is_close(temperature, step(1).try_cast("double")) & is_close(hold * factor(hold_unit), step(2).try_cast("double") * factor(step(3)))
    known = temperature.isNotNull() & hold.isNotNull() & hold_unit.isNotNull()
    return F.when((F.upper(F.trim(cool)) == "WQ") & known & single & agrees, structured_condition(cool, temperature, temperature_unit, hold, hold_unit))


def resolve_exploded(rows: DataFrame, key: str, fields: list[str], spark: SparkSession, aliases: dict[str, str]) -> DataFrame:
    """key, node_id, ambiguous over all fields, as joins: for tables where expressions over the alias table would be large."""
    long = rows.select(key, F.explode(F.array(*[F.col(f) for f in fields])).alias("raw")).filter("raw IS NOT NULL")
    long = long.withColumn("part", F.row_number().over(Window.partitionBy(key).orderBy("raw"))).withColumn("part_key", F.struct(key, "part"))
    found = match_aliases(long, "part_key", canonical_tokens(F.col("raw")), alias_frame(spark, aliases))
    merged = found.groupBy(F.col(f"part_key.{key}").alias(key)).agg(F.collect_set("node_id").alias("nodes"), F.bool_or("ambiguous").alias("one"))
    clash = F.col("one") | (F.size("nodes") > 1)
    return merged.select(key, F.when(~clash, F.get("nodes", F.lit(0))).alias("node_id"), clash.alias("ambiguous"))
