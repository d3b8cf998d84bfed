"""Cited property values joined to records by (grade, condition)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.operators.validation import CONFIDENCE_LEVELS
from ferrolith.schemas import DISTANT, MEASURED


def confidence_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE_LEVELS]), F.lower(F.trim(c)))


def lookup_index(entries: DataFrame, min_confidence: str = "low") -> DataFrame:
    """alloy_grade, condition, add: the entries at or above the floor as a map by property."""
    if min_confidence not in CONFIDENCE_LEVELS:
        raise ValueError(f"min_confidence must be one of {CONFIDENCE_LEVELS}, not {min_confidence!r}")
    strong = entries.filter(confidence_rank(F.col("join_confidence")) >= CONFIDENCE_LEVELS.index(min_confidence) + 1)
    return strong.groupBy("alloy_grade", "condition").agg(F.map_from_entries(F.collect_list(F.struct("property_name", F.col("value").cast("double")))).alias("add"))


def join_properties(records: DataFrame, entries: DataFrame, min_confidence: str = "low") -> DataFrame:
    """records with the lookup's values added where the whole key matches; values that a record has are never replaced."""
    joined = records.join(lookup_index(entries, min_confidence), ["alloy_grade", "condition"], "left")
    new = F.map_filter(F.coalesce("add", F.create_map().cast("map<string,double>")), lambda k, v: ~F.map_contains_key("properties", k))
    sources = F.transform_values(F.col("__new"), lambda k, v: F.lit(DISTANT))
    kept = F.map_filter("property_sources", lambda k, v: ~F.map_contains_key(F.col("__new"), k))
    return joined.withColumn("__new", new).withColumns({"properties": F.map_concat("properties", F.col("__new")), "property_sources": F.map_concat(kept, sources)}).select(*records.columns)


def measured_properties(properties: Column, sources: Column) -> Column:
    """The entries whose source is measured; without a source they count as measured."""
    return F.map_filter(properties, lambda k, v: F.coalesce(sources[k], F.lit(MEASURED)) == MEASURED)


def first_value_by_group(records: DataFrame, property_name: str) -> DataFrame:
    """group_id, value: the first record that has the property, by adapter and record order."""
    valued = records.select("group_id", "adapter_ord", "record_ord", F.col("properties")[property_name].alias("value")).filter("value IS NOT NULL")
    return valued.groupBy("group_id").agg(F.min_by("value", F.struct("adapter_ord", "record_ord")).alias("value"))


def last_value_by_label(labels: DataFrame, label: str, value: str, order: str) -> DataFrame:
    """The last of repeated labels wins."""
    return labels.groupBy(label).agg(F.max_by(value, order).alias(value))


def merge_features(left: Column, right: Column) -> Column:
    """Two maps as one; the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def feature(features: Column, name: str) -> Column:
    return F.coalesce(features[name], F.lit(0.0))


def in_scope(family: Column, adapter: Column, scope: str) -> Column:
    """family or family/adapter."""
    head, _, tail = scope.partition("/")
    return (family == head) & (F.lit(True) if not tail else adapter == tail)
