"""Records of a sample and image database: joins with measured labels, masks, and the exact conditions of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.text import literal_map, stem_of
from ferrolith.operators.aliases import GRADE_ALIASES, exact_condition, match_column
from ferrolith.operators.audit import split_groups
from ferrolith.operators.weak_labels import last_value_by_label
from ferrolith.schemas import MEASURED, canonical, physical_scale

# Nodes of the primary constituents, and of the classes of benchmark masks in order.
PRIMARY_NODES = {
    "martensite": ("ferrous/martensite",),
    "network": ("ferrous/network",),
    "pearlite": ("ferrous/pearlite",),
    "pearlite+spheroidite": ("ferrous/pearlite", "ferrous/spheroidite"),
    "pearlite+widmanstatten": ("ferrous/pearlite", "ferrous/widmanstatten"),
    "spheroidite": ("ferrous/spheroidite",),
    "spheroidite+widmanstatten": ("ferrous/spheroidite", "ferrous/widmanstatten"),
}
MASK_NODES = ("ferrous/matrix", "ferrous/network", "ferrous/spheroidite", "ferrous/widmanstatten")


def metadata_records(meta: DataFrame, measured: DataFrame, masks: DataFrame, adapter_ord: int = 0, name: str = "uhcs") -> DataFrame:
    """Canonical records of the images in meta (images with sample columns)."""
    nodes = literal_map({k: "|".join(v) for k, v in PRIMARY_NODES.items()})
    labels = last_value_by_label(measured, "sample_label", "hardness_hv", "row")
    groups = split_groups(meta, name)
    joined = meta.withColumn("stem", stem_of(F.col("path"))).join(groups, meta["sample_key"] == groups["sample_key"], "left").drop(groups["sample_key"])
    joined = joined.join(labels, "sample_label", "left").join(masks.select("stem", F.col("path").alias("mask_path")), "stem", "left")
    value = F.when(F.col("hardness_hv").isNotNull(), F.create_map(F.lit("hardness_hv"), "hardness_hv"))
    source = F.when(F.col("hardness_hv").isNotNull(), F.create_map(F.lit("hardness_hv"), F.lit(MEASURED)))
    grade, _ = match_column(F.col("sample_label"), GRADE_ALIASES)
    condition = exact_condition(F.col("sample_label"), F.col("cool_method"), F.col("anneal_temperature"), F.col("anneal_temp_unit"), F.col("anneal_time"), F.col("anneal_time_unit"))
    return canonical(joined.select(
        F.concat(F.lit(f"{name}-"), F.col("micrograph_id").cast("string")).alias("record_id"), F.col("path").alias("image_path"), physical_scale(F.col("micron_bar"), F.col("micron_bar_px")).alias("scale_um_per_px"),
        F.coalesce("detector", F.lit("SE")).alias("modality"), F.coalesce("group_id", F.concat(F.lit(f"{name}-orphan-"), F.col("micrograph_id").cast("string"))).alias("group_id"),
        F.split(nodes[F.col("primary_microconstituent")], r"\|").alias("taxonomy_labels"), "mask_path",
        F.when(F.col("mask_path").isNotNull(), F.array(*[F.lit(n) for n in MASK_NODES])).alias("mask_class_nodes"), value.alias("properties"), source.alias("property_sources"),
        grade.alias("alloy_grade"), condition.alias("condition"), F.lit(name).alias("adapter"), F.lit("ferrous").alias("family"), F.lit(adapter_ord).alias("adapter_ord"), F.col("micrograph_id").cast("bigint").alias("record_ord"),
    ))
