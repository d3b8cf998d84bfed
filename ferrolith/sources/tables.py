"""CSV tables with strict headers, image folders and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.functions.text import sorted_labels, stem_of
from ferrolith.operators import validation as V
from ferrolith.operators.masks import class_channel
from ferrolith.operators.vocabulary import CONDITION_AXIS, GRADE_AXIS, Vocabulary
from ferrolith.session import hadoop_path, is_folder, path_exists
from ferrolith.schemas import DISTANT, LOOKUP_COLUMNS, MANIFEST_COLUMNS, canonical

# Image suffixes, and folders of masks in the order they are looked for.
IMAGE_SUFFIXES = ("tif", "tiff", "png", "jpg", "jpeg", "bmp")
MASK_FOLDERS = ("labels", "annotations", "masks", "ground_truth", "gt")


def read_strings(spark: SparkSession, path: str, columns, where: str | None = None) -> DataFrame:
    """A CSV with a header, all columns text and blanks empty, plus `row`: the line number from 2."""
    raw = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("nullValue", "\u0000").option("emptyValue", "").option("multiLine", True).csv(str(path))
    V.require_columns(raw, columns, where or str(path))
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]
    placed = raw.select(*texts, F.monotonically_increasing_id().alias("__at"), F.col("_metadata.file_path").alias("__file"))
    # A file is read as one piece, so that the running id has no gaps within it.
    first = placed.groupBy("__file").agg(F.min("__at").alias("__first"))
    return placed.join(first, "__file").select(*columns, (F.col("__at") - F.col("__first") + 2).alias("row"))


def empty(spark: SparkSession, columns) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns) + ", row bigint")


def load_property_lookup(spark: SparkSession, path: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The cited property table, typed and checked; no rows if the file is absent."""
    if not path_exists(spark, path):
        raw = empty(spark, LOOKUP_COLUMNS)
    else:
        raw = read_strings(spark, path, LOOKUP_COLUMNS)
        V.raise_first(V.violations(raw, V.lookup_rules()), str(path))
        for d in V.duplicates(raw, ["alloy_grade", "condition", "property_name"]).orderBy("row").limit(1).collect():
            raise V.ValidationError(f"{path}: rows {d.first_row} and {d.row} have one key")
        if vocabulary is not None:
            for column, axis in (("alloy_grade", GRADE_AXIS), ("condition", CONDITION_AXIS)):
                vocabulary.require([r[0] for r in raw.select(column).distinct().collect()], axis)  # ids of a vocabulary of a few nodes
    return raw.withColumns({
        "value": V.number(F.col("value")), "scatter": V.number(F.col("scatter")), "n_measurements": V.number(F.col("n_measurements")).cast("int"),
        "join_confidence": F.lower(F.trim("join_confidence")), "scatter_kind": F.coalesce(F.nullif(F.lower(F.trim("scatter_kind")), F.lit("")), F.lit("unreported")),
    })


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The literature manifest, checked row by row, for repeats and for panels of a specimen that disagree; files are checked by hash."""
    if not path_exists(spark, path):
        return empty(spark, MANIFEST_COLUMNS)
    raw = read_strings(spark, path, MANIFEST_COLUMNS)
    for key in ("record_id", "image_path"):
        for d in V.duplicates(raw, [key]).orderBy("row").limit(1).collect():
            raise V.ValidationError(f"{path}: duplicate {key} {d[key]!r}")
    V.raise_first(V.violations(raw, V.manifest_rules()), str(path))
    for d in V.dependency_violations(raw, ["source_id", "specimen_id"], list(V.SIGNATURE_COLUMNS)).orderBy("row").limit(1).collect():
        raise V.ValidationError(f"{path} row {d.row}: panels of one specimen disagree")
    return raw


def manifest_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """image_path, content of the files below root."""
    at, system = hadoop_path(spark, root)
    prefix = system.makeQualified(at).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root))
    return files.select(F.replace(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(prefix + "/"), F.lit("")).alias("image_path"), "content")


def manifest_records(manifest: DataFrame, adapter_ord: int = 0) -> DataFrame:
    """Canonical records: without scale and labels, with the cited value as a distant property."""
    return canonical(manifest.select(
        "record_id", "image_path", F.col("modality"), F.concat_ws("-", F.lit("literature"), "source_id", "specimen_id").alias("group_id"),
        F.create_map("property_name", F.col("property_value").cast("double")).alias("properties"), F.create_map("property_name", F.lit(DISTANT)).alias("property_sources"),
        "alloy_grade", "condition", F.lit("literature").alias("adapter"), F.lit("ferrous").alias("family"), F.lit(adapter_ord).alias("adapter_ord"), F.col("row").alias("record_ord"),
    ))


def load_measured_labels(spark: SparkSession, path: str) -> DataFrame:
    """sample_label, hardness_hv, source_note; rows whose value is no number go; no rows if the file is absent."""
    columns = ("sample_label", "hardness_hv", "source_note")
    raw = read_strings(spark, path, columns) if path_exists(spark, path) else empty(spark, columns)
    value = F.col("hardness_hv").try_cast("double")
    return raw.withColumn("hardness_hv", F.when(~F.isnan(value), value)).filter("hardness_hv IS NOT NULL")


def image_folder(spark: SparkSession, path: str, name: str, family: str, adapter_ord: int = 0) -> DataFrame:
    """Records of a labels.csv: path, taxonomy_labels, and if there group_id and scale_um_per_px. Ids count from 0."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path}: labels of the image folder {name} are missing")
    header = spark.read.option("header", True).csv(str(path)).columns
    extra = [c for c in ("group_id", "scale_um_per_px") if c in header]
    raw = read_strings(spark, path, ["path", "taxonomy_labels", *extra])
    index = F.col("row") - 2
    group = F.when(F.col("group_id") != "", F.concat(F.lit(f"{name}-"), "group_id")) if "group_id" in extra else F.lit(None).cast("string")
    scale = F.col("scale_um_per_px").try_cast("double") if "scale_um_per_px" in extra else F.lit(None).cast("double")
    return canonical(raw.select(
        F.concat(F.lit(f"{name}-"), index.cast("string")).alias("record_id"), F.col("path").alias("image_path"), scale.alias("scale_um_per_px"), F.lit("SEM").alias("modality"),
        F.coalesce(group, F.lit("")).alias("group_id"), sorted_labels(F.col("taxonomy_labels")).alias("taxonomy_labels"), F.lit(name).alias("adapter"), F.lit(family).alias("family"), F.lit(adapter_ord).alias("adapter_ord"), index.alias("record_ord"),
    ))


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """path, stem of all image files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(IMAGE_SUFFIXES) + "}").load(str(root))
    return found.select("path", stem_of(F.col("path")).alias("stem"))


def benchmark_masks(spark: SparkSession, root: str) -> DataFrame:
    """path, stem of the masks in the first mask folder that exists; none if root is absent, an error if it has no mask folder."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], "path string, stem string")
    for folder in MASK_FOLDERS:
        if is_folder(spark, f"{root}/{folder}"):
            return list_images(spark, f"{root}/{folder}")
    raise FileNotFoundError(f"{root}: no mask folder among {', '.join(MASK_FOLDERS)}")


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """origin, h, w, channels, data (rows of BGR or grey bytes)."""
    return spark.read.format("image").option("dropInvalid", False).load(path).select("image.origin", F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("channels"), "image.data")


def mask_pixels(spark: SparkSession, path: str) -> DataFrame:
    """origin, h, w, px: the class numbers of mask images, from their first channel."""
    return read_pixels(spark, path).select("origin", "h", "w", class_channel(F.col("data"), F.col("channels")).alias("px"))


def attach_paths(rows: DataFrame, listing: DataFrame, raw: str, root: str) -> DataFrame:
    """rows with found: the listed path at raw below root if there is one, else one with the same base name, or null."""
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    plain = listing.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    whole = plain.select(F.col("path").alias("__whole"), F.col("path").alias("__exact")).distinct()
    names = plain.groupBy(base(F.col("path")).alias("__base")).agg(F.min("path").alias("__named"))
    placed = rows.withColumns({"__whole": F.concat(F.lit(root.rstrip("/") + "/"), F.col(raw)), "__base": base(F.col(raw))})
    return placed.join(whole, "__whole", "left").join(names, "__base", "left").select(*rows.columns, F.coalesce("__exact", "__named").alias("found"))
