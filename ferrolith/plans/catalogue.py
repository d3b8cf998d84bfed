"""Queries over the driver's tables, one for each operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.functions import text as T
from ferrolith.functions import vectors as vec
from ferrolith.operators import aliases, audit, boosting, conformal, evaluation, heads, masks, metrics, neighbours, prediction, ranking, records, splits, tiles, training, validation, vocabulary, weak_labels
from ferrolith.sources import metadata, registry
from ferrolith.schemas import canonical, evaluation_block, group_or_record, join_key, physical_scale

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

CLASSES = 4
PROBE_STEEL = ("low carbon steel", "AISI 1045", "quenched & tempered", "0.45C normalised", "1045 4140", "mild steel annealing")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# --- audit ---------------------------------------------------------------------------------------


@query
def q_audit_left_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return audit.image_counts(orders, lines, "o_orderkey", "l_orderkey", "l_orderkey").select("o_orderkey", "micrographs")


#: Labels and cooling codes of the samples made from orders; fixed values of the alias table stand in some.
PROBE_LABELS = ("AC1 800C 90M WQ", "AC 970C 3H FC", "AISI 1045 800C 5M 900C 1H", "low carbon steel", "1045 4140 WQ", "", "quenched & tempered 0.45C", "mild steel annealing")
PROBE_COOLING = ("WQ", "FC", "Q", "oil", None)


def pick(values, index: Column, kind: str = "string") -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), index.cast("int"))


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a sample."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    label = F.concat_ws(" ", pick(PROBE_LABELS, k % 8), F.when((c % 9 == 0) & (k % 8 != 5), F.concat(F.lit("S"), c.cast("string"))))
    return read(spark, sf_dir, "orders").select(
        k.alias("sample_id"), F.when(k % 11 != 0, label).alias("label"), F.when(c % 6 != 0, (c % 4 + 1).cast("double") / 2).alias("anneal_time"), pick(("H", "m", "M", "s", None), c % 5).alias("anneal_time_unit"),
        F.when(c % 7 != 0, F.floor(F.col("o_totalprice") / 100000).cast("double") * 100).alias("anneal_temperature"), F.when(c % 10 != 0, F.lit("c")).alias("anneal_temp_unit"), pick(PROBE_COOLING, k % 5).alias("cool_method"),
    )


def line_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as an image of its order; one in 50 names a sample that isn't there."""
    missing = F.col("l_partkey") % 50 == 0
    return read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("micrograph_id"), F.when(missing, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("sample_key"))


def audited_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_samples(order_samples(spark, sf_dir), line_images(spark, sf_dir))


@query
def q_audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited_orders(spark, sf_dir).select("sample_id", "alloy_grade", "coarse_condition", "temperature_c", "hold_value", "hold_unit", "micrographs", F.array_join("flags", "|").alias("flags"), "status", "thermal_signature")


@query
def q_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_summary(audited_orders(spark, sf_dir), line_images(spark, sf_dir))


@query
def q_audit_coarse_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coarse_groups(audited_orders(spark, sf_dir)).withColumn("thermal_signatures", F.array_join("thermal_signatures", "|"))


@query
def q_audit_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform("sample_ids", lambda i: i.cast("string")), "|")
    return audit.exact_groups(audited_orders(spark, sf_dir)).withColumns({"sample_ids": ids, "flags": F.array_join("flags", "|")})


@query
def q_split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_key"), F.when(F.col("o_custkey") % 4 != 0, (F.col("o_custkey") % 90).cast("string")).alias("sample_label"))
    return audit.split_groups(meta, "lot")


# --- records -------------------------------------------------------------------------------------


@query
def q_metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", "n_name", r6(physical_scale(F.col("c_acctbal"), F.col("c_nationkey"))).alias("scale"))


@query
def q_canonical_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("documents-"), text("doc_id")).alias("record_id"), F.lit("-").alias("image_path"), F.lit("text").alias("modality"), F.col("source").alias("group_id"), F.lit("documents").alias("adapter"))
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("pages-"), text("page_id")).alias("record_id"), F.lit("-").alias("image_path"), F.lit("html").alias("modality"), F.lit("").alias("group_id"), F.lit("pages").alias("adapter"))
    turns = read(spark, sf_dir, "conversations").select(F.concat(F.lit("turns-"), text("conv_id"), F.lit("-"), text("turn")).alias("record_id"), F.lit("-").alias("image_path"), F.col("role").alias("modality"), text("conv_id").alias("group_id"), F.lit("conversations").alias("adapter"))
    rows = canonical(docs).unionByName(canonical(pages)).unionByName(canonical(turns))
    return rows.select("record_id", "modality", "group_id", "adapter", F.size("properties").cast("bigint").alias("n_properties"))


@query
def q_group_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    group = group_or_record(F.when(F.col("lang") == "fr", "").otherwise(F.col("lang")), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    key = join_key(F.nullif("lang", F.lit("de")), F.nullif("source", F.lit("src0")))
    return docs.select("doc_id", group.alias("group_id"), key["alloy_grade"].alias("alloy_grade"), key["condition"].alias("condition"))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: language as family, source as adapter, both as labels; Spanish ones have no label."""
    doc = F.col("doc_id").cast("string")
    labels = F.when(F.col("lang") != "es", F.array("source", "lang"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/"), doc).alias("image_path"), F.col("lang").alias("family"), F.col("source").alias("adapter"), labels.alias("taxonomy_labels"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/m"), doc)).alias("mask_path"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("mask_class_nodes"))


def labelled_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing that holds the images of labelled documents alone."""
    return read(spark, sf_dir, "labels").select(F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"))


@query
def q_masked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_records(spark, sf_dir)
    return records.with_masks(rows).select("doc_id", F.lit("|".join(records.mask_nodes(rows))).alias("nodes"))


@query
def q_labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.with_labels(document_records(spark, sf_dir), labelled_paths(spark, sf_dir)).select("doc_id")


@query
def q_class_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_records(spark, sf_dir).select("doc_id", records.label_set(F.col("taxonomy_labels")).alias("label_set"))
    return records.encode_classes(rows, "label_set", records.class_table(rows, "label_set")).select("doc_id", F.array_join("label_set", "|").alias("label_set"), "cls")


@query
def q_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_records(spark, sf_dir)
    scope = lambda s: weak_labels.in_scope(F.col("family"), F.col("adapter"), s)
    return rows.select("doc_id", F.when(scope("en/src1"), "en/src1").when(scope("en"), "en").alias("scope"))


@query
def q_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.run_counters(document_records(spark, sf_dir), "en", labelled_paths(spark, sf_dir))


@query
def q_training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with their mean size, and the first value of those that have one; brands that end with 3 have none."""
    features = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("group_id")).agg(F.avg("p_size").alias("size"))
    values = weak_labels.first_value_by_group(part_records(spark, sf_dir).withColumn("properties", F.when(~F.col("group_id").endswith("3"), F.col("properties"))), "hardness_hv")
    return records.training_table(features, values).select("group_id", r6("size").alias("size"), "value")


@query
def q_grade_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    grade, condition = F.when(k % 5 == 0, "").when(k % 7 != 0, F.col("p_brand")), F.when(k % 3 != 0, F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", records.grade_or_unresolved(grade).alias("grade"), evaluation_block(condition, F.col("p_brand")).alias("block"))


@query
def q_value_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.most_values_in_group(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query
def q_intersection_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, nations = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    met = records.intersection_or_first(customers, nations.select((F.col("key") * 2).alias("key"))).withColumn("case", F.lit("both"))
    return met.unionByName(records.intersection_or_first(nations, nations.select((-F.col("key") - 1).alias("key"))).withColumn("case", F.lit("first")))


@query
def q_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("metric"))
    return records.best_epochs(rows, "user_id", "event_id", "metric")


@query
def q_head_middle_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.head_middle_tail(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("part", "place", "o_orderkey", "o_totalprice")


# --- vocabulary ----------------------------------------------------------------------------------


def place_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    tops = region.select(F.col("r_name").alias("id"), F.col("r_name").alias("name"), F.lit(1).alias("level"), F.lit("region").alias("axis"))
    below = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    return tops.unionByName(below.select(F.concat_ws("/", "r_name", "n_name").alias("id"), F.col("n_name").alias("name"), F.lit(2).alias("level"), F.lit("nation").alias("axis")))


@query
def q_vocab_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.tree_lines(place_nodes(spark, sf_dir))


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    node = F.when(F.col("c_custkey") % 50 == 0, "ATLANTIS").when(F.col("c_custkey") % 20 == 0, F.col("r_name")).when(F.col("c_custkey") % 33 != 0, F.concat_ws("/", "r_name", "n_name"))
    return joined.select("c_custkey", node.alias("node"))


@query
def q_vocab_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.unknown_ids(customer_places(spark, sf_dir), "node", place_nodes(spark, sf_dir)).select("c_custkey", "node")


@query
def q_vocab_wrong_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.wrong_axis(customer_places(spark, sf_dir), "node", place_nodes(spark, sf_dir), "nation").select("c_custkey", "node", "axis")


@query
def q_record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records with labels that are unknown or on another axis, and with sources of properties that they don't have."""
    k = F.col("p_partkey")
    labels = F.when(k % 4 == 0, F.array(F.lit("ferrous/pearlite"))).when(k % 4 == 1, F.array(F.lit("nowhere"))).when(k % 4 == 2, F.array(F.lit("grade/ferrous"), F.lit("ferrous")))
    sources = F.when(k % 5 == 0, F.create_map(F.lit("hardness_hv"), F.lit("distant")))
    rows = canonical(read(spark, sf_dir, "part").select(k.cast("string").alias("record_id"), F.lit("-").alias("image_path"), F.lit("SEM").alias("modality"), F.lit("").alias("group_id"), labels.alias("taxonomy_labels"), sources.alias("property_sources"), F.when(k % 6 == 0, "ferrous/pearlite").alias("alloy_grade")))
    return registry.record_violations(spark, rows, vocabulary.Vocabulary.load())


@query
def q_metadata_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images of samples: sizes are sample keys, some labels are measured, a fourth of the images has a mask."""
    k, key = F.col("p_partkey"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_size"))
    stem = F.concat(F.lit("image"), k.cast("string"))
    label = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("L"), (key % 10).cast("string")))
    parts = read(spark, sf_dir, "part")
    none = F.lit(None)
    meta = parts.select(
        k.alias("micrograph_id"), F.concat(F.lit("/images/"), stem, F.lit(".tif")).alias("path"), key.alias("sample_key"), label.alias("sample_label"), none.cast("string").alias("cool_method"), none.cast("double").alias("anneal_temperature"),
        none.cast("string").alias("anneal_temp_unit"), none.cast("double").alias("anneal_time"), none.cast("string").alias("anneal_time_unit"), F.col("p_size").alias("micron_bar"), (k % 3).alias("micron_bar_px"),
        F.when(k % 2 == 0, "BSE").alias("detector"), F.when(k % 8 == 0, "pearlite+spheroidite").when(k % 8 == 1, "unheard of").alias("primary_microconstituent"),
    )
    measured = read(spark, sf_dir, "nation").select(F.concat(F.lit("L"), (F.col("n_nationkey") % 7).cast("string")).alias("sample_label"), F.col("n_nationkey").cast("double").alias("hardness_hv"), F.col("n_nationkey").alias("row"))
    there = parts.select(F.when(k % 4 == 0, stem).otherwise(F.concat(F.lit("other"), stem)).alias("stem"), F.concat(F.lit("/masks/"), stem, F.lit(".png")).alias("path"))
    rows = metadata.metadata_records(meta, measured, there, name="lot")
    return rows.select("record_id", "group_id", r6("scale_um_per_px").alias("scale"), "modality", F.array_join("taxonomy_labels", "|").alias("labels"), "mask_path", F.size("mask_class_nodes").alias("classes"), F.col("properties")["hardness_hv"].alias("hardness"), "record_ord")


@query
def q_feature_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of features as one, in which the right one wins; a feature that is missing counts as 0."""
    left, right = F.create_map(F.lit("a"), F.col("p_size").cast("double"), F.lit("b"), F.lit(1.0)), F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("b"), F.lit(2.0), F.lit("c"), F.lit(3.0))).otherwise(F.create_map(F.lit("c"), F.lit(4.0)))
    merged = read(spark, sf_dir, "part").select("p_partkey", weak_labels.merge_features(left, right).alias("f"))
    return merged.select("p_partkey", *[weak_labels.feature(F.col("f"), name).alias(name) for name in ("a", "b", "c", "d")])


@query
def q_bounded_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", T.bounded_bool(pick(("true", "false", "TRUE", "1", None), F.col("p_partkey") % 5)).alias("value"))


# --- strings -------------------------------------------------------------------------------------


@query
def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(T.canonical_tokens(F.col("text")), " ")).alias("tokens_md5"))


def steel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(x) for x in PROBE_STEEL])
    return read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.get(texts, (F.col("p_partkey") % 8).cast("int"))).alias("raw"))


@query
def q_alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases.normalize_strings(steel_names(spark, sf_dir), "p_partkey", "raw", spark, aliases.GRADE_ALIASES).select("p_partkey", "node_id")


@query
def q_alias_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases.normalize_strings(steel_names(spark, sf_dir), "p_partkey", "raw", spark, aliases.GRADE_ALIASES).filter("ambiguous").select("p_partkey")


@query
def q_condition_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, clash = aliases.match_column(F.col("raw"), aliases.CONDITION_ALIASES)
    return steel_names(spark, sf_dir).select("p_partkey", node.alias("node_id"), clash.alias("ambiguous"))


@query
def q_structured_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    route = F.when(F.col("p_partkey") % 3 == 0, "WQ").when(F.col("p_partkey") % 3 == 1, "water-quenched").otherwise("WQ-2C")
    temperature = F.get(F.array(*[F.lit(float(x)) for x in (700, 800, 970, 1000)]), (F.col("p_size") % 4).cast("int"))
    hold = F.get(F.array(*[F.lit(float(x)) for x in (5, 90, 1.5, 8, 24)]), (F.col("p_partkey") % 5).cast("int"))
    unit = F.when(F.col("p_partkey") % 5 >= 2, " h").otherwise("M")
    return part.select("p_partkey", aliases.structured_condition(route, temperature, F.lit("c "), hold, unit).alias("node_id"))


@query
def q_exact_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of water-quench routes: the label's one step must agree with the columns."""
    k = F.col("p_partkey")
    celsius, minutes = pick((800, 970, 1000), k % 3, "double"), pick((90, 180, 7), k % 3, "double")
    step = F.concat(F.lit("AC1 "), celsius.cast("int").cast("string"), F.lit("C "), minutes.cast("int").cast("string"), F.lit("M"))
    label = F.when(k % 4 < 3, step).otherwise(F.concat(step, F.lit(" 900C 5M")))
    cool, hours = F.when(k % 5 != 0, "WQ").otherwise("FC"), k % 2 == 0
    found = aliases.exact_condition(label, cool, celsius + F.when(k % 7 == 0, 1.0).otherwise(0.0), F.lit("C"), F.when(hours, minutes / 60).otherwise(minutes), F.when(hours, "H").otherwise("M"))
    return read(spark, sf_dir, "part").select("p_partkey", found.alias("node_id"))


@query
def q_regex_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    label = F.when(key % 4 == 0, F.concat(size, F.lit("C 5M x-"), size, F.lit("C"))).when(key % 4 == 1, F.concat(F.lit("AC "), size, F.lit(".5 c 1H "), size, F.lit(" C 2H"))).when(key % 4 == 2, "WQ").otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", T.count_temperatures(label).cast("bigint").alias("n_temperatures"))


@query
def q_scope_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("scope"))
    heads_ = requests.groupBy("scope").agg(F.count("*").alias("n")).filter("n % 2 = 0").select(F.col("scope").alias("registered_scope"), F.lit("own").alias("head"))
    types = read(spark, sf_dir, "part").select(F.col("p_type").alias("registered_scope"), F.lit("type").alias("head")).distinct()
    return prediction.resolve_scopes(requests, "scope", heads_.unionByName(types)).select("p_partkey", "registered_scope", "head")


# --- validation ----------------------------------------------------------------------------------


def messy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of text for each part, with an error in some."""
    k = F.col("p_partkey")
    pick = lambda n, at, bad, good: F.when(k % n == at, bad).otherwise(good)
    return read(spark, sf_dir, "part").select(
        k.alias("row"), pick(31, 1, "  ", F.col("p_brand")).alias("alloy_grade"), pick(37, 1, "", F.col("p_type")).alias("condition"), pick(23, 1, "fatigue_life", F.lit(" hardness_hv")).alias("property_name"),
        F.when(k % 29 == 1, "nan").when(k % 29 == 2, "0").when(k % 29 == 3, "abc").when(k % 29 == 4, "").otherwise(F.col("p_size").cast("string")).alias("value"), pick(19, 1, "HB", F.lit("HV")).alias("unit"),
        F.when(k % 17 == 1, "-1").when(k % 17 == 2, "inf").when(k % 17 == 3, "").otherwise("8").alias("scatter"), pick(13, 1, "range", pick(17, 3, "", F.lit("SD "))).alias("scatter_kind"),
        F.when(k % 11 == 1, "2.5").when(k % 11 == 2, "0").when(k % 11 == 3, "").otherwise("4").alias("n_measurements"), pick(7, 1, "pretty sure", pick(7, 2, "High", F.lit("low"))).alias("join_confidence"),
        pick(41, 1, " ", F.lit("a paper")).alias("source_citation"), F.lit("").alias("source_url"), F.lit("").alias("note"),
    )


@query
def q_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.violations(messy_lookup(spark, sf_dir), validation.lookup_rules()).select("row", "rule_ord", "rule")


@query
def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.duplicates(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), F.md5("text").alias("digest")), ["digest"])


@query
def q_fd_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.dependency_violations(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), "source", "lang"), ["source"], ["lang"])


@query
def q_hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    digest = F.when(F.col("doc_id") % 10 == 0, F.sha2("source", 256)).otherwise(F.upper(F.sha2("text", 256)))
    manifest = docs.select(F.col("doc_id").alias("row"), F.col("doc_id").cast("string").alias("image_path"), digest.alias("image_sha256"))
    files = docs.select(F.concat(F.when(F.col("doc_id") % 17 == 0, "elsewhere/").otherwise(""), F.col("doc_id").cast("string")).alias("image_path"), F.encode("text", "UTF-8").alias("content"))
    return validation.hash_violations(manifest, files)


# --- weak labels ---------------------------------------------------------------------------------


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = F.when(F.col("p_partkey") % 11 == 0, F.create_map(F.lit("hardness_hv"), F.col("p_size").cast("double")))
    rows = read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("record_id"), F.lit("-").alias("image_path"), F.lit("SEM").alias("modality"), F.col("p_brand").alias("group_id"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")).alias("alloy_grade"),
        F.col("p_type").alias("condition"), have.alias("properties"), F.lit("part").alias("adapter"), F.lit("ferrous").alias("family"), F.lit(0).alias("adapter_ord"), F.col("p_partkey").alias("record_ord"),
    )
    return canonical(rows)


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("alloy_grade"), F.col("p_type").alias("condition")).agg(F.max("p_retailprice").alias("value"), F.count("*").alias("n"))
    level = F.get(F.array(*[F.lit(x) for x in validation.CONFIDENCE_LEVELS]), (F.col("n") % 3).cast("int"))
    return grouped.select("alloy_grade", "condition", F.lit("hardness_hv").alias("property_name"), "value", level.alias("join_confidence"))


def weak_join(spark: SparkSession, sf_dir: str, floor: str) -> DataFrame:
    joined = weak_labels.join_properties(part_records(spark, sf_dir), part_entries(spark, sf_dir), floor)
    return joined.select("record_id", F.col("properties")["hardness_hv"].alias("value"), F.col("property_sources")["hardness_hv"].alias("source"))


@query
def q_weak_join_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_join(spark, sf_dir, "low")


@query
def q_weak_join_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_join(spark, sf_dir, "medium")


@query
def q_measured_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "labels")
    values = F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double"))
    sources = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("quality"), F.lit("measured"), F.lit("toxic"), F.lit("distant"))).otherwise(F.create_map(F.lit("quality"), F.lit("distant")))
    return docs.select("doc_id", F.array_join(F.array_sort(F.map_keys(weak_labels.measured_properties(values, sources))), "|").alias("measured"))


@query
def q_first_value_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.when(F.col("event_type") == "click", 0).otherwise(1)
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("group_id"), order.alias("adapter_ord"), F.col("event_id").alias("record_ord"), F.create_map(F.lit("v"), F.when(F.col("event_id") % 3 != 0, F.col("value"))).alias("properties"))
    return weak_labels.first_value_by_group(rows, "v")


# --- splits and groups ---------------------------------------------------------------------------


@query
def q_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hashed_group_split(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.2, 0.15, 7).select("o_orderkey", "o_custkey", "split")


@query
def q_group_split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = splits.hashed_group_split(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", 0.2, 0.2, 7)
    return splits.straddling_groups(split, "source").agg(F.count("*").alias("straddling"))


@query
def q_heldout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.held_out_split(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["de", "fr"])


@query
def q_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 9 != 0, F.col("l_orderkey")).alias("group_id"), F.when(F.col("l_linenumber") % 3 == 0, float("nan")).otherwise(F.col("l_quantity")).alias("l_quantity"), "l_discount", F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).alias("at"))
    means = masks.group_means(lines, "group_id", ["l_quantity", "l_discount"], ["l_returnflag", "l_linestatus"], "at")
    return means.select("group_id", "l_returnflag", "l_linestatus", r6("l_quantity").alias("l_quantity"), r6("l_discount").alias("l_discount"))


@query
def q_summary_nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("value").alias("low"), F.max("value").alias("high"))


# --- masks ---------------------------------------------------------------------------------------


def embedding_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 masks of four classes."""
    cls = lambda x: F.when(x < F.lit(-0.1), 0).when(x < F.lit(0.0), 1).when(x < F.lit(0.1), 2).otherwise(3)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform(vec.doubles(F.col("embedding")), cls).alias("px"))


@query
def q_class_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = masks.class_fractions(F.col("px"), CLASSES)
    return embedding_masks(spark, sf_dir).select("record_id", F.posexplode(shares).alias("cls", "fraction")).select("record_id", "cls", r6("fraction").alias("fraction"))


@query
def q_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = embedding_masks(spark, sf_dir).select(F.explode("px").alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select("cls", "n", r6(F.col("n") / F.col("total")).alias("share"))  # total: one row


@query
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(read(spark, sf_dir, "lineitem"), F.col("l_quantity"), 0.0, 48.0, 16)


@query
def q_region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.mask_table(embedding_masks(spark, sf_dir), CLASSES).select("record_id", "cls", "n_regions", r6("mean_area").alias("mean_area"), "max_area")


@query
def q_homology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.persistence(masks.mask_table(embedding_masks(spark, sf_dir), CLASSES))


def tiled_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks in tiles of 3 x 3, joined over their seams."""
    return tiles.tiled_mask_table(tiles.cut_tiles(embedding_masks(spark, sf_dir), 3), CLASSES)


@query
def q_tiled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled_measures(spark, sf_dir).select("record_id", "cls", "n_regions", r6("mean_area").alias("mean_area"), F.col("max_area").cast("int").alias("max_area"))


@query
def q_tiled_homology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.persistence(tiled_measures(spark, sf_dir))


@query
def q_topological_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = masks.topological_features(embedding_masks(spark, sf_dir), [f"node{i}" for i in range(CLASSES)])
    return masks.long_features(features).select("record_id", "feature", "value")


@query
def q_feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = masks.feature_vector(embedding_masks(spark, sf_dir), [f"node{i}" for i in range(CLASSES)])
    return masks.long_features(features).select("record_id", "feature", r6("value").alias("value"))


@query
def q_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sum of weighted pixels loses when a tile is filled with the image's mean; pixel i weighs i."""
    images = read(spark, sf_dir, "embeddings").select("vec_id", vec.doubles(F.col("embedding")).alias("px")).withColumn("mean", vec.total(F.col("px")) / 64)
    loss = lambda tile: F.aggregate(tile, F.lit(0.0), lambda a, i: a + i * (F.get("px", i) - F.col("mean")))
    return images.select("vec_id", F.posexplode(F.transform(masks.tile_classes(F.col("px"), 8, 2), loss)).alias("tile", "delta")).select("vec_id", "tile", r6("delta").alias("delta"))


@query
def q_mean_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = embedding_masks(spark, sf_dir).join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), vec.doubles(F.col("embedding")).alias("x")), "record_id")
    return metrics.class_means(pixels, "x", "px").select("cls", r6("mean_intensity").alias("mean_intensity"), r6("share").alias("share"))


def flat(px: Column) -> Column:
    return F.array_join(F.transform(px, lambda p: p.cast("string")), ",")


@query
def q_pad_and_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 masks in the middle of 32 x 32 (the index of the first pixel that isn't filled, and the sum), and their own middle of 4 x 3."""
    side = F.lit(8)
    rows = embedding_masks(spark, sf_dir).select("record_id", "px", masks.pad_centred(F.transform("px", lambda p: (p + 1).cast("double")), side, side).alias("padded"))
    crop = masks.crop_centred(F.col("px"), side, side, F.lit(4), F.lit(3))
    return rows.select("record_id", F.size("padded").alias("n"), (F.array_position(F.transform("padded", lambda p: p > 0), F.lit(True)) - 1).alias("first"), vec.total(F.col("padded")).alias("total"), flat(crop).alias("middle"))


@query
def q_pixel_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flips and turns of 8 x 8 masks, rows without a banner of two, the first 48 as planes of 4 x 4, and whether a pixel is beyond two classes."""
    px, side = F.col("px"), F.lit(8)
    planes = masks.channels_first(F.slice("px", 1, 48), F.lit(4), F.lit(4))
    return embedding_masks(spark, sf_dir).select(
        "record_id", flat(masks.flip_columns(px, side, side)).alias("flipped"), flat(masks.flip_rows(px, side, side)).alias("upside"), flat(masks.quarter_turn(px, side, side)).alias("turned"),
        flat(masks.without_banner(px, side, side, 2, 8)).alias("bare"), flat(F.transform(planes, lambda p: F.round(p * 255).cast("int"))).alias("planes"), masks.foreign_pixels(px, 2).alias("foreign"), flat(masks.brighter(px, F.lit(1.5))).alias("bright"),
    )


@query
def q_normalised_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.transform("px", lambda p: (p * 60).cast("double"))
    return embedding_masks(spark, sf_dir).select("record_id", r6(vec.total(vec.normalise_pixels(px, 0.485, 0.229))).alias("total"))


@query
def q_centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cosine with its class mean."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return rows.join(evaluation.centroids(rows, "label", "embedding"), "label").select("vec_id", r6(vec.cosine(vec.doubles(F.col("embedding")), F.col("centroid"))).alias("cosine"))


# --- classifiers ---------------------------------------------------------------------------------


def with_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return evaluation.class_distances(rows, "vec_id", "embedding", evaluation.centroids(rows, "label", "embedding"), "label")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_distances(spark, sf_dir).select("vec_id", "label", evaluation.nearest_mean(F.col("distances")).alias("predicted"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, p: softmax of negative distances, class by class."""
    return with_distances(spark, sf_dir).select("vec_id", "label", vec.softmax(F.transform("distances", lambda d: -10 * d["d"])).alias("p"))


@query
def q_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = evaluation.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("i", "m")).select("label", "i", r6("m").alias("m"))


@query
def q_nearest_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir)


@query
def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(predicted(spark, sf_dir), "label", "predicted", 10)


@query
def q_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_iou(metrics.confusion(predicted(spark, sf_dir), "label", "predicted", 12), 12).select("cls", r6("iou").alias("iou"))


@query
def q_mean_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    ious = metrics.class_iou(metrics.confusion(predicted(spark, sf_dir), "label", "predicted", 12), 12)
    return metrics.mean_iou(ious).select(r6("mean_iou").alias("mean_iou"))


@query
def q_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).agg(r6(metrics.accuracy(F.col("label"), F.col("predicted"))).alias("accuracy"))


@query
def q_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(spark, sf_dir).select("vec_id", F.posexplode("p").alias("cls", "p")).select("vec_id", "cls", r6("p").alias("p"))


@query
def q_ranked_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(f"family{i}") for i in range(10)])
    ranked = F.transform(conformal.ranked_classes(F.transform("p", lambda p: F.round(p, 6)), names), lambda s: s["name"])
    return probabilities(spark, sf_dir).select("vec_id", F.array_join(ranked, "|").alias("families"))


@query
def q_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(spark, sf_dir).select("vec_id", r6(vec.cross_entropy(F.col("p"), F.col("label").cast("int"))).alias("loss"))


@query
def q_conformal_qhat(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Split conformal: one half calibrates; sets are then made for all.
    scored = probabilities(spark, sf_dir).filter("vec_id % 2 = 0").select(conformal.nonconformity(F.col("p"), F.col("label").cast("int")).alias("score"))
    return conformal.calibrate(scored, "score", 0.1)


@query
def q_conformal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q_hat = q_conformal_qhat(spark, sf_dir).select("q_hat")
    tested = probabilities(spark, sf_dir).crossJoin(F.broadcast(q_hat))  # one row
    chosen = conformal.prediction_set(F.col("p"), F.col("q_hat"))
    return tested.select("vec_id", F.array_join(F.transform(chosen, lambda i: i.cast("string")), "|").alias("classes"), F.when(F.size(chosen) == 1, F.get(chosen, F.lit(0))).cast("int").alias("single"))


@query
def q_predict_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"family{i}" for i in range(10)]
    rows = probabilities(spark, sf_dir).select(F.col("vec_id").alias("record_id"), F.col("p").alias("probabilities"), F.array(*[F.lit(n) for n in names]).alias("families"), F.array(F.col("vec_id") / F.lit(100.0), F.lit(1.0)).alias("features"))
    rows = rows.crossJoin(F.broadcast(q_conformal_qhat(spark, sf_dir).select("q_hat")))  # one row
    segmenters = spark.createDataFrame([(n,) for n in names[:6]], "family string")
    heads = spark.createDataFrame([(n, 5.0, [2.0, 0.5]) for n in names[2:8]], "family string, intercept double, weights array<double>")
    out = prediction.predict(rows, F.col("q_hat"), segmenters, heads)
    first = F.get(F.map_keys("abstentions"), F.lit(0))
    return out.select("record_id", "family", r6("value").alias("value"), first.alias("stage"), F.col("abstentions")[first].alias("reason"))


@query
def q_knn_exclude_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbour(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding").select("vec_id", "neighbour", r6("similarity").alias("similarity"))


# --- regressors ----------------------------------------------------------------------------------


def part_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("double").alias("x1"), (F.col("p_partkey") % 97).cast("double").alias("x2"), F.col("p_retailprice").alias("y"))


@query
def q_logo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.leave_block_out_mean(part_values(spark, sf_dir), "p_brand", "y").select("p_partkey", F.round("p", 8).alias("p"))


@query
def q_logo_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.leave_block_out_grade_mean(part_values(spark, sf_dir), "p_brand", "p_type", "y").select("p_partkey", F.round("p", 8).alias("p"))


@query
def q_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_values(spark, sf_dir).select("y", F.explode(F.create_map(F.lit("size"), F.col("x1") * 30 + 200, F.lit("key"), F.col("x2") * 10 + 900)).alias("model", "p"))
    return metrics.regression_metrics(rows, ["model"]).select("model", "n", *[r6(c).alias(c) for c in ("mae", "rmse", "r2", "spearman")])


@query
def q_measured_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_values(spark, sf_dir).select("y", F.when(F.col("p_partkey") % 3 == 0, "measured").otherwise("distant").alias("source"), F.explode(F.create_map(F.lit("size"), F.col("x1") * 30 + 200, F.lit("key"), F.col("x2") * 10 + 900)).alias("model", "p"))
    return metrics.measured_metrics(rows, ["model"], F.col("source")).select("model", "subset", "n", *[r6(c).alias(c) for c in ("mae", "rmse", "r2", "spearman")])


def brand_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_values(spark, sf_dir).groupBy(F.col("p_brand").alias("group_id")).agg(F.avg("x1").alias("x1"), F.avg("x2").alias("x2"), F.avg("y").alias("y"))


@query
def q_fit_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head that is chosen for brands by leave-one-out, and its value for every brand."""
    table = brand_table(spark, sf_dir)
    head = heads.fit_head(table, "group_id", ["x1", "x2"], "y")
    features = F.create_map(F.lit("x1"), "x1", F.lit("x2"), "x2")
    return table.select("group_id", F.lit(head["kind"]).alias("kind"), r6(heads.head_value(head, features)).alias("value"))


@query
def q_linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out predictions of the linear head for brands."""
    table = brand_table(spark, sf_dir).withColumn("all", F.lit(0))
    return evaluation.leave_one_out_ridge(table, "all", "group_id", ["x1", "x2"], "y", heads.RIDGE).select("group_id", r6("p").alias("p"))


def grouped_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("family"), F.col("label").cast("string")).alias("family"), (F.col("vec_id") % 40).alias("group_id"))


@query
def q_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding routed by a linear head whose abstention is calibrated on held-out groups."""
    rows = grouped_embeddings(spark, sf_dir)
    router = training.train_router(rows, "embedding", "family", "group_id")
    return training.route(rows.drop("family"), router, "embedding").select("vec_id", "family")


@query
def q_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label set that a linear head predicts for every embedding; some sets have two labels."""
    rows = grouped_embeddings(spark, sf_dir).withColumn("labels", F.when(F.col("family") < "family5", F.array("family")).when(F.col("family") < "family8", F.array(F.lit("upper"), "family")))
    head = training.train_classifier(rows, "embedding", "labels", "group_id")
    return training.classify(rows, head, "embedding").select("vec_id", F.array_join("predicted", "|").alias("predicted"))


@query
def q_pca_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.principal_plane(read(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", r6("pc1").alias("pc1"), r6("pc2").alias("pc2"))


@query
def q_loo_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.leave_one_out_ridge(part_values(spark, sf_dir), "p_brand", "p_partkey", ["x1", "x2"], "y").select("p_brand", "p_partkey", r6("p").alias("p"))


@query
def q_pca_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", (F.col("vec_id") % 13).cast("double").alias("y"))
    return evaluation.pca_ridge_folds(rows, "vec_id", "label", "embedding", "y").select("vec_id", r6("p").alias("p"))


@query
def q_gbt_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_values(spark, sf_dir)
    return evaluation.fit_tree_head(rows, "p_partkey", ["x1", "x2"], "y").transform(rows).select("p_partkey", r6("p").alias("p"))


@query
def q_boosted_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's value by trees fitted on all other brands, all brands at once."""
    rows = part_values(spark, sf_dir)
    return boosting.leave_folds_out(rows, "p_partkey", "p_brand", ["x1", "x2"], "y", trees=5, rate=heads.SHRINKAGE, depth=heads.DEPTH).select("p_partkey", r6("p").alias("p"))


@query
def q_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query
def q_best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = q_metrics(spark, sf_dir).select("model", "mae", F.when(F.col("model") == "size", 0).otherwise(1).alias("ord"))
    return evaluation.better_model(scores, "model", "mae", "ord")
