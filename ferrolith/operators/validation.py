"""Row validation: rules become a table of violations; loaders stop at the first one by row and rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.session import materialize

# Units, levels and domains.
PROPERTY_UNITS = {"hardness_hv": "HV"}
CONFIDENCE_LEVELS = ("low", "medium", "high")
SCATTER_KINDS = ("sd", "half_range", "tolerance_band", "unreported")
MANIFEST_SCATTER_KINDS = ("sd", "half_range", "tolerance_band", "reported_plus_minus_unspecified", "unreported")
MATCH_RELATIONS = ("same_study_batch_condition", "same_study_plate_condition_location")
POSITIVE_COLUMNS = ("source_page", "property_table_page", "scale_bar_um", "property_value", "hardness_load_kgf", "hardness_dwell_s")
REQUIRED_TEXT = ("record_id", "image_path", "source_id", "source_citation", "specimen_id", "alloy_grade", "condition", "image_sha256")
SIGNATURE_COLUMNS = ("alloy_grade", "condition", "sampling_location", "property_name", "property_value", "property_unit", "hardness_load_kgf", "hardness_dwell_s", "property_scatter", "scatter_kind", "n_measurements", "property_source", "match_relation")


class ValidationError(ValueError):
    """A row breaks a rule."""


@dataclass(frozen=True)
class Rule:
    """broken is true for rows that violate it; null counts as kept."""

    name: str
    message: str
    broken: Column


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def number(c: Column) -> Column:
    """A finite number, or null."""
    n = F.trim(c).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def bad_number(c: Column) -> Column:
    """Text that is not a finite number."""
    return ~blank(c) & number(c).isNull()


def lookup_rules() -> list[Rule]:
    """The property lookup's rules in order of precedence."""
    c = F.col
    confidence, kind = F.lower(F.trim(c("join_confidence"))), F.coalesce(F.nullif(F.lower(F.trim(c("scatter_kind"))), F.lit("")), F.lit("unreported"))
    name, value, scatter, n = F.trim(c("property_name")), number(c("value")), number(c("scatter")), number(c("n_measurements"))
    units = F.create_map(*[F.lit(x) for kv in PROPERTY_UNITS.items() for x in kv])
    return [
        Rule("alloy_grade", "alloy_grade is required", blank(c("alloy_grade"))),
        Rule("condition", "condition is required", blank(c("condition"))),
        Rule("property_name", "unknown property_name", ~F.coalesce(name.isin(*PROPERTY_UNITS), F.lit(False))),
        Rule("unit", "unit differs from the property's", ~F.coalesce(F.trim(c("unit")) == units[name], F.lit(False))),
        Rule("join_confidence", "join_confidence is no level", ~F.coalesce(confidence.isin(*CONFIDENCE_LEVELS), F.lit(False))),
        Rule("scatter_kind", "scatter_kind is unknown", ~kind.isin(*SCATTER_KINDS)),
        Rule("source_citation", "source_citation is empty", blank(c("source_citation"))),
        Rule("value", "value must be a finite number", blank(c("value")) | bad_number(c("value"))),
        Rule("value_positive", "hardness_hv must be positive", (name == "hardness_hv") & (value <= 0)),
        Rule("scatter", "scatter must be a finite number", bad_number(c("scatter"))),
        Rule("scatter_negative", "scatter must not be negative", scatter < 0),
        Rule("scatter_reported", "scatter_kind must be unreported exactly when scatter is blank", blank(c("scatter")) != (kind == "unreported")),
        Rule("n_measurements", "n_measurements must be a positive integer", bad_number(c("n_measurements")) | (n != F.floor(n)) | (n < 1)),
        Rule("evidence", "high confidence requires scatter or n_measurements", (confidence == "high") & blank(c("scatter")) & blank(c("n_measurements"))),
    ]


def manifest_rules() -> list[Rule]:
    """The literature manifest's rules on single rows."""
    c = F.col
    choice = lambda col, domain: Rule(col, f"{col} must be one of {', '.join(domain)}", ~F.coalesce(c(col).isin(*domain), F.lit(False)))
    rules = [Rule(f"{col}_text", f"{col} is required", blank(c(col))) for col in REQUIRED_TEXT]
    rules += [choice(col, d) for col, d in (("match_relation", MATCH_RELATIONS), ("match_confidence", CONFIDENCE_LEVELS), ("scatter_kind", MANIFEST_SCATTER_KINDS), ("property_source", ("distant",)), ("property_name", ("hardness_hv",)), ("property_unit", ("HV",)), ("modality", ("SEM",)))]
    rules += [choice(col, ("true", "false")) for col in ("exact_physical_specimen_confirmed", "source_annotations_present")]
    rules.append(Rule("exact_specimen", "an exact physical specimen must not be claimed", c("exact_physical_specimen_confirmed") == "true"))
    rules += [Rule(f"{col}_positive", f"{col} must be a positive number", F.coalesce(number(c(col)) <= 0, F.lit(True))) for col in POSITIVE_COLUMNS]
    n = number(c("n_measurements"))
    rules.append(Rule("n_measurements", "n_measurements must be a positive integer", bad_number(c("n_measurements")) | (n != F.floor(n)) | (n <= 0)))
    rules.append(Rule("property_scatter", "property_scatter must be a number, not negative", bad_number(c("property_scatter")) | (number(c("property_scatter")) < 0)))
    rules.append(Rule("scatter_reported", "scatter_kind must be unreported exactly when property_scatter is blank", blank(c("property_scatter")) != (c("scatter_kind") == "unreported")))
    rules.append(Rule("image_path_inside", "image_path leaves the data folder", c("image_path").startswith("/") | c("image_path").rlike(r"(^|/)\.\.(/|$)")))
    rules.append(Rule("image_sha256", "image_sha256 must be 64 hex digits", ~F.lower(c("image_sha256")).rlike("^[0-9a-f]{64}$")))
    return rules


def violations(rows: DataFrame, rules: list[Rule], row: str = "row") -> DataFrame:
    """row, rule_ord, rule, message of everything broken: one pass, no join."""
    each = F.array_compact(F.array(*[F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(i).alias("rule_ord"), F.lit(r.name).alias("rule"), F.lit(r.message).alias("message"))) for i, r in enumerate(rules)]))
    return rows.select(row, F.explode(each).alias("v")).select(row, "v.*")


def duplicates(rows: DataFrame, keys: list[str], row: str = "row") -> DataFrame:
    """Rows that repeat a key, with the first row of it."""
    w = Window.partitionBy(*keys).orderBy(row)
    return rows.withColumn("first_row", F.first(row).over(w)).filter(F.col(row) != F.col("first_row")).select(row, "first_row", *keys)


def with_previous(rows: DataFrame, keys: list[str], row: str, value: Column) -> DataFrame:
    """keys, row, value and before: the value of the key's previous row by `row`, null at its first. value is a struct.

    Rows are dealt by ranges of (keys, row), so that a key with most rows is many tasks' work. A row's predecessor is found within
    its range; a range's first row of a key takes it from the key's last row in an earlier range, of which there is one for each range.
    """
    chosen = rows.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), F.col(row).alias("row"), value.alias("value"))
    dealt = materialize(chosen.repartitionByRange("key", "row").withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("key", "part").orderBy("row")
    near = dealt.withColumns({"lagged": F.lag("value").over(inside), "place": F.row_number().over(inside)})
    lasts = dealt.groupBy("key", "part").agg(F.max_by("value", "row").alias("last"))
    carried = lasts.select("key", "part", F.lag("last").over(Window.partitionBy("key").orderBy("part")).alias("carried")).filter("carried IS NOT NULL")
    # near lies by (key, part) already; of carried there are as many rows as ranges and keys.
    found = near.join(carried, ["key", "part"], "left").withColumn("before", F.when(F.col("place") == 1, F.col("carried")).otherwise(F.col("lagged")))
    return found.select(*[F.col(f"key.k{i}").alias(k) for i, k in enumerate(keys)], F.col("row").alias(row), "value", "before")


def dependency_violations(rows: DataFrame, keys: list[str], columns: list[str], row: str = "row") -> DataFrame:
    """Rows whose columns differ from the previous row of the same key. Null keys are a key as well."""
    found = with_previous(rows, keys, row, F.struct(*columns))
    return found.filter(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("value"))).select(row, *keys)


def hash_violations(manifest: DataFrame, files: DataFrame, row: str = "row") -> DataFrame:
    """Manifest rows whose file is missing or has another SHA-256. files: image_path, content."""
    digests = files.select("image_path", F.sha2("content", 256).alias("found"))
    joined = manifest.join(digests, "image_path", "left")
    return joined.filter(F.col("found").isNull() | (F.col("found") != F.lower("image_sha256"))).select(row, "image_path", F.lower("image_sha256").alias("expected"), "found")


def require_columns(df: DataFrame, columns, where: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValidationError(f"{where}: missing columns {missing}")


def raise_first(found: DataFrame, where: str, row: str = "row") -> None:
    for v in found.orderBy(row, "rule_ord").limit(1).collect():
        raise ValidationError(f"{where} row {v[row]}: {v['message']}")


def odd_sources() -> Column:
    """Have property sources no property, or an unknown source?"""
    orphans = F.array_except(F.map_keys("property_sources"), F.map_keys("properties"))
    odd = F.filter(F.map_values("property_sources"), lambda s: ~s.isin("measured", "distant"))
    return (F.size(orphans) > 0) | (F.size(odd) > 0)
