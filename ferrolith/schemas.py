"""The canonical record and the columns of the tables that feed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD_SCHEMA = (
    "record_id string NOT NULL, image_path string NOT NULL, scale_um_per_px double, modality string NOT NULL, group_id string NOT NULL, "
    "taxonomy_labels array<string>, mask_path string, mask_class_nodes array<string>, properties map<string,double> NOT NULL, "
    "property_sources map<string,string> NOT NULL, alloy_grade string, condition string, adapter string, family string, adapter_ord int, record_ord long"
)
MEASURED, DISTANT = "measured", "distant"

# The columns of the property lookup and of the literature manifest.
LOOKUP_COLUMNS = ("alloy_grade", "condition", "property_name", "value", "unit", "scatter", "scatter_kind", "n_measurements", "join_confidence", "source_citation", "source_url", "note")
MANIFEST_COLUMNS = (
    "record_id", "image_path", "source_id", "source_citation", "source_doi", "source_url", "source_pdf_url", "license", "license_url", "source_page",
    "source_figure", "source_panel", "property_table", "property_table_page", "source_value_locator", "specimen_id", "match_relation", "match_confidence",
    "exact_physical_specimen_confirmed", "modality", "source_annotations_present", "scale_bar_um", "alloy_grade", "condition", "sampling_location",
    "property_name", "property_value", "property_unit", "hardness_load_kgf", "hardness_dwell_s", "property_scatter", "scatter_kind", "n_measurements",
    "property_source", "image_sha256", "note",
)


def group_or_record(group_id: Column, record_id: Column) -> Column:
    """An empty or null group is the record itself."""
    return F.coalesce(F.nullif(group_id, F.lit("")), record_id)


def join_key(grade: Column, condition: Column) -> Column:
    """Both halves, or null."""
    return F.when(grade.isNotNull() & condition.isNotNull(), F.struct(grade.alias("alloy_grade"), condition.alias("condition")))


def evaluation_block(condition: Column, group_id: Column) -> Column:
    return F.coalesce(condition, group_id)


def physical_scale(bar: Column, bar_px: Column) -> Column:
    """Micrometres a pixel; null if either is null or the bar has no pixels."""
    return F.try_divide(bar.cast("double"), F.nullif(bar_px.cast("double"), F.lit(0.0)))


def canonical(df: DataFrame) -> DataFrame:
    """df with every column of the record schema, missing ones null or empty, in the schema's order."""
    have, out = set(df.columns), []
    for part in RECORD_SCHEMA.replace("map<string,", "map<string;").split(", "):
        name, kind = part.replace(" NOT NULL", "").replace(";", ",").split(" ", 1)
        value = F.col(name) if name in have else F.lit(None)
        if name in ("properties", "property_sources"):
            value = F.coalesce(value.cast(kind), F.create_map().cast(kind))
        if name == "group_id":
            value = group_or_record(value.cast("string"), F.col("record_id").cast("string"))
        out.append(value.cast(kind).alias(name))
    return df.select(*out)
