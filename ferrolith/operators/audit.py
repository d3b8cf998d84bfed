"""Join-key readiness audit: flags, status and rollups for samples and their images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.text import count_temperatures, thermal_signature
from ferrolith.operators.aliases import CONDITION_ALIASES, GRADE_ALIASES
from ferrolith.operators.dictionary import resolve_fields

# Cooling codes, and flags that block a sample.
KNOWN_COOLING = ("WQ", "AR", "FC", "Q")
NON_BLOCKING = ("duplicate_sample_label",)
#: Samples of one group that are given its name together: a name holds all ids of its group, so that one group's rows are many tasks' work.
NAMED_TOGETHER = 500


def image_counts(samples: DataFrame, images: DataFrame, key: str, foreign: str, image: str) -> DataFrame:
    """samples with micrographs: the images that name them, 0 if none. Images are counted before they are joined."""
    counts = images.groupBy(F.col(foreign).alias(key)).agg(F.count(image).alias("micrographs"))
    return samples.join(counts, key, "left").withColumn("micrographs", F.coalesce("micrographs", F.lit(0)).cast("bigint"))


def flag_list(flags: list[tuple[str, Column]]) -> Column:
    """The names of those that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in flags]))


def blocking(flags: Column) -> Column:
    return F.size(F.array_except(flags, F.array(*[F.lit(x) for x in NON_BLOCKING]))) > 0


def audit_samples(samples: DataFrame, images: DataFrame) -> DataFrame:
    """One row per sample: key, thermal data, micrographs, flags in fixed order, status and thermal_signature.

    samples: sample_id, label, anneal_time, anneal_time_unit, anneal_temperature, anneal_temp_unit, cool_method; images:
    micrograph_id, sample_key. Codes are compared as they are written, with case and spaces.
    """
    label, cooling = F.coalesce("label", F.lit("")), F.col("cool_method")
    counted = image_counts(samples, images, "sample_id", "sample_key", "micrograph_id")
    counted = resolve_fields(counted, ["label", "cool_method"], {"grade_": GRADE_ALIASES, "condition_": CONDITION_ALIASES}, "bearers")
    unit = lambda c: F.nullif(F.upper(F.coalesce(c, F.lit(""))), F.lit(""))
    keyed = counted.withColumns({"ambiguous": F.col("grade_.ambiguous") | F.col("condition_.ambiguous"), "temp_unit": unit(F.col("anneal_temp_unit")), "hold_unit": unit(F.col("anneal_time_unit"))})
    keyed = keyed.withColumns({"alloy_grade": F.when(~F.col("ambiguous"), F.col("grade_.node_id")), "coarse_condition": F.when(~F.col("ambiguous"), F.col("condition_.node_id"))})
    thermal = F.col("anneal_temperature").isNull() | F.col("anneal_time").isNull() | ~F.coalesce(F.col("temp_unit") == "C", F.lit(False)) | ~F.coalesce(F.col("hold_unit").isin("M", "H"), F.lit(False))
    flags = flag_list([
        ("ambiguous_alias", F.col("ambiguous")),
        ("missing_grade", F.col("alloy_grade").isNull()),
        ("unknown_condition", F.col("coarse_condition").isNull()),
        ("missing_thermal_metadata", thermal),
        ("unspecified_quench_medium", cooling == "Q"),
        ("special_cooling_code", ~cooling.isin(*KNOWN_COOLING)),
        ("multi_step_label", count_temperatures(label) > 1),
        ("duplicate_sample_label", F.col("bearers")[0] > 1),
        ("no_micrographs", F.col("micrographs") == 0),
    ])
    done = keyed.withColumn("flags", flags).withColumn("temperature_c", F.when(F.col("temp_unit") == "C", F.col("anneal_temperature")))
    status = F.when(blocking(F.col("flags")), "blocked").when(cooling == "WQ", "candidate").otherwise("provisional")
    return done.select(
        "sample_id", label.alias("label"), "alloy_grade", "coarse_condition", "temperature_c", F.col("anneal_time").alias("hold_value"), "hold_unit",
        cooling.alias("cooling_code"), "micrographs", status.alias("status"), "flags",
        thermal_signature(F.col("temperature_c"), F.col("anneal_time"), F.col("hold_unit"), cooling).alias("thermal_signature"),
    )


def audit_summary(audited: DataFrame, images: DataFrame) -> DataFrame:
    """One row of conditional totals; orphans are all images that no sample counts."""
    complete = F.col("alloy_grade").isNotNull() & F.col("coarse_condition").isNotNull()
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("micrographs"))), F.lit(0))
    totals = audited.agg(
        F.count("*").alias("sample_rows"), F.count_if(F.col("micrographs") > 0).alias("samples_with_micrographs"), some(F.lit(True)).alias("linked_micrographs"),
        F.count_if(complete).alias("complete_key_samples"), some(complete).alias("complete_key_micrographs"), some(F.col("status") == "candidate").alias("candidate_micrographs"),
        some(F.col("status") == "provisional").alias("provisional_micrographs"), some(complete & (F.col("status") == "blocked")).alias("blocked_complete_key_micrographs"), some(~complete).alias("incomplete"),
    )
    joined = totals.crossJoin(images.agg(F.count("*").alias("micrographs")))  # one row each
    orphans = F.col("micrographs") - F.col("linked_micrographs")
    return joined.withColumn("orphan_micrographs", orphans).withColumn("incomplete_key_micrographs", F.col("incomplete") + orphans).drop("incomplete")


def coarse_groups(audited: DataFrame) -> DataFrame:
    whole = audited.filter("alloy_grade IS NOT NULL AND coarse_condition IS NOT NULL AND micrographs > 0")
    return whole.groupBy("alloy_grade", F.col("coarse_condition").alias("condition")).agg(F.count("*").alias("samples"), F.sum("micrographs").alias("micrographs"), F.array_sort(F.collect_set("thermal_signature")).alias("thermal_signatures")).orderBy("alloy_grade", "condition")


def exact_groups(audited: DataFrame) -> DataFrame:
    ready = audited.filter("status IN ('candidate', 'provisional') AND thermal_signature IS NOT NULL")
    return ready.groupBy("status", F.coalesce("alloy_grade", F.lit("")).alias("alloy_grade"), "thermal_signature").agg(
        F.array_sort(F.collect_list("sample_id")).alias("sample_ids"), F.sum("micrographs").alias("micrographs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("flags")
    ).orderBy("status", "alloy_grade", "thermal_signature")


def split_groups(meta: DataFrame, prefix: str = "uhcs") -> DataFrame:
    """sample_key, group_id: samples of one label are one group, named by all its ids; blank labels share one named after the smallest id."""
    rows = meta.filter("sample_key IS NOT NULL").select(F.col("sample_key").cast("bigint").alias("sample_key"), F.coalesce("sample_label", F.lit("")).alias("label")).dropDuplicates(["sample_key"])
    blank, named = rows.filter("label = ''").select("sample_key"), rows.filter("label <> ''")
    least = blank.agg(F.concat(F.lit(f"{prefix}-sample-"), F.min("sample_key").cast("string")).alias("group_id"))
    ids = named.groupBy("label").agg(F.array_sort(F.collect_list("sample_key")).alias("ids"))  # a name holds all ids of its label
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), "-")
    name = F.concat(F.lit(prefix), F.when(F.size("ids") > 1, "-samples-").otherwise("-sample-"), joined)
    # A name is made once for a group, and goes with slices of its ids to as many tasks as a shuffle has.
    steps = F.sequence(F.lit(1), F.size("ids"), F.lit(NAMED_TOGETHER))
    parts = ids.withColumn("group_id", name).select("group_id", F.explode(F.transform(steps, lambda i: F.slice("ids", i, NAMED_TOGETHER))).alias("part"))
    spread = parts.repartition(int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("part"))
    return spread.select(F.explode("part").alias("sample_key"), "group_id").unionByName(blank.crossJoin(F.broadcast(least)))  # one row


def report_sections(audited: DataFrame, images: DataFrame) -> dict[str, DataFrame]:
    """Summary, coarse and exact groups with their arrays joined by bars, ready for CSV."""
    bars = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    coarse, exact = coarse_groups(audited), exact_groups(audited)
    return {
        "summary": audit_summary(audited, images),
        "coarse": coarse.withColumn("thermal_signatures", bars("thermal_signatures")),
        "exact": exact.withColumns({"sample_ids": bars("sample_ids"), "flags": bars("flags")}),
    }
