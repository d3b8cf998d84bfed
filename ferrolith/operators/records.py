"""Filters, classes and checks over canonical records and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The columns of a feature table that are no features.
META_COLUMNS = ("record_id", "group_id", "family", "adapter")
UNRESOLVED_GRADE = "grade-unresolved"


def with_masks(records: DataFrame) -> DataFrame:
    return records.filter("mask_path IS NOT NULL")


def with_labels(records: DataFrame, listing: DataFrame) -> DataFrame:
    """Records with a label whose image is in the listing (column path)."""
    there = listing.select(F.col("path").alias("image_path")).distinct()
    return records.filter(F.size("taxonomy_labels") > 0).join(there, "image_path", "left_semi")


def label_set(labels: Column) -> Column:
    """The labels in order; null for none."""
    return F.when(F.size(labels) > 0, F.array_sort(labels))


def class_table(rows: DataFrame, label: str) -> DataFrame:
    """label, cls: the distinct labels that aren't null, numbered in order from 0. One row a class."""
    return rows.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("cls", F.row_number().over(Window.orderBy(label)) - 1)


def encode_classes(rows: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """rows with cls; rows whose label is null or no class are left out."""
    return rows.join(classes, label)


def mask_nodes(records: DataFrame) -> list[str]:
    """The one list of class nodes that all masks share."""
    found = with_masks(records).select("mask_class_nodes").distinct().limit(2).collect()
    if not found:
        raise FileNotFoundError("no record has a mask")
    if len(found) > 1:
        raise ValueError("masks with different class nodes; train one segmenter for each")
    return list(found[0].mask_class_nodes)


def grade_or_unresolved(grade: Column) -> Column:
    return F.coalesce(F.nullif(grade, F.lit("")), F.lit(UNRESOLVED_GRADE))


def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in META_COLUMNS]


def training_table(features: DataFrame, values: DataFrame) -> DataFrame:
    """features by group with the value of their group; groups without one are left out. values: group_id, value."""
    return features.join(values.filter("value IS NOT NULL"), "group_id")


def run_counters(records: DataFrame, family: str, listing: DataFrame) -> DataFrame:
    """One row: used, skipped_family (of another family), skipped_missing (of this one, without an image in the listing)."""
    own = F.col("family").eqNullSafe(F.lit(family))
    there = listing.select(F.col("path").alias("image_path")).distinct().withColumn("there", F.lit(True))
    met = records.select("image_path", "family").join(there, "image_path", "left")
    missing = own & F.col("there").isNull()
    return met.agg(F.count_if(own & ~missing).alias("used"), F.count_if(~own).alias("skipped_family"), F.count_if(missing).alias("skipped_missing"))


def most_values_in_group(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row, most_values: the largest number of different values that a group has; 1 where every group has one."""
    counts = rows.select(group, value).filter(F.col(value).isNotNull()).distinct().groupBy(group).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_values"))


def intersection_or_first(first: DataFrame, second: DataFrame) -> DataFrame:
    """The distinct rows of both; if there are none, those of the first."""
    both = first.intersect(second)
    none = both.limit(1).agg((F.count("*") == 0).alias("none"))  # one row
    return both.unionByName(first.distinct().crossJoin(F.broadcast(none)).filter("none").drop("none"))


def best_epochs(scores: DataFrame, run: str, epoch: str, metric: str) -> DataFrame:
    """run, epoch, metric: the epoch with the best metric of each run, the first of equals. NaN and null are no metric."""
    kept = scores.filter(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    return kept.groupBy(run).agg(F.max_by(epoch, F.struct(F.col(metric), -F.col(epoch))).alias(epoch), F.max(metric).alias(metric))
