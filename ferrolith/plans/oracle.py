"""DuckDB SQL for the catalogue's queries, written apart from their Spark plans."""

from __future__ import annotations

import re

from ferrolith.functions.text import SPELLING, STOPWORDS
from ferrolith.operators.aliases import CONDITION_ALIASES, EXACT_ROUTES, GRADE_ALIASES, WATER_QUENCH
from ferrolith.plans.catalogue import PROBE_LABELS, PROBE_STEEL

SQL: dict[str, str] = {}


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def tokens(raw: str) -> str:
    forms = "CASE t " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in SPELLING.items()) + " ELSE t END"
    cut = f"string_split(trim(regexp_replace(lower({raw}), '[^a-z0-9.]+', ' ', 'g')), ' ')"
    stop = ", ".join(map(quoted, STOPWORDS))
    return f"list_filter(list_transform(list_transform({cut}, lambda t: trim(t, '.')), lambda t: {forms}), lambda t: t <> '' AND t NOT IN ({stop}))"


def phrase(alias: str) -> list[str]:
    words = (SPELLING.get(w.strip("."), w.strip(".")) for w in re.sub(r"[^a-z0-9.]+", " ", alias.lower()).split())
    return [w for w in words if w and w not in STOPWORDS]


def alias_rows(aliases: dict[str, str]) -> str:
    rows = sorted({(" ".join(phrase(a)), len(phrase(a)), n) for a, n in aliases.items()})
    return "(VALUES " + ", ".join(f"({quoted(p)}, {k}, {quoted(n)})" for p, k, n in rows) + ") AS al(phrase, len, node)"


# --- audit
SQL["q_audit_left_count"] = "SELECT o_orderkey, count(l_orderkey) AS micrographs FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"
NUMBER = lambda x: f"CASE WHEN {x} = floor({x}) THEN ({x})::BIGINT::VARCHAR ELSE replace(({x})::VARCHAR, '.', 'p') END"
AUDIT = f"""
WITH s AS (SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 11 <> 0 THEN concat_ws(' ', CASE o_orderkey % 8 {' '.join(f"WHEN {i} THEN {quoted(x)}" for i, x in enumerate(PROBE_LABELS))} END,
        CASE WHEN o_custkey % 9 = 0 AND o_orderkey % 8 <> 5 THEN 'S' || o_custkey END) END AS label, CASE WHEN o_custkey % 6 <> 0 THEN (o_custkey % 4 + 1)::DOUBLE / 2 END AS hold, CASE o_custkey % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'M' WHEN 2 THEN 'M' WHEN 3 THEN 'S' END AS unit,
        CASE WHEN o_custkey % 7 <> 0 THEN floor(o_totalprice / 100000) * 100 END AS t, o_custkey % 10 <> 0 AS celsius, CASE o_orderkey % 5 WHEN 0 THEN 'WQ' WHEN 1 THEN 'FC' WHEN 2 THEN 'Q' WHEN 3 THEN 'oil' END AS cool FROM orders),
i AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN -l_orderkey ELSE l_orderkey END AS sample_id, count(*) AS micrographs FROM lineitem GROUP BY 1),
raw AS (SELECT DISTINCT raw FROM (SELECT label AS raw FROM s UNION ALL SELECT cool FROM s) WHERE raw IS NOT NULL),
tok AS (SELECT raw, ' ' || array_to_string({tokens('raw')}, ' ') || ' ' AS padded FROM raw),
hit AS (SELECT raw, 'g' AS kind, node, len FROM tok JOIN {alias_rows(GRADE_ALIASES)} ON contains(padded, ' ' || phrase || ' ') UNION ALL SELECT raw, 'c', node, len FROM tok JOIN {alias_rows(CONDITION_ALIASES)} ON contains(padded, ' ' || phrase || ' ')),
top AS (SELECT raw, kind, list_distinct(list(node)) AS nodes FROM hit WHERE (raw, kind, len) IN (SELECT raw, kind, max(len) FROM hit GROUP BY ALL) GROUP BY ALL),
g AS (SELECT s.sample_id, list_distinct(flatten(list(nodes) FILTER (kind = 'g'))) AS gn, list_distinct(flatten(list(nodes) FILTER (kind = 'c'))) AS cn FROM s JOIN top ON top.raw = s.label OR top.raw = s.cool GROUP BY 1),
k AS (SELECT s.*, coalesce(label, '') AS lab, coalesce(len(gn), 0) > 1 OR coalesce(len(cn), 0) > 1 AS clash, gn[1] AS g1, cn[1] AS c1, coalesce(micrographs, 0) AS micrographs, count(*) OVER (PARTITION BY coalesce(label, '')) AS same FROM s LEFT JOIN g USING (sample_id) LEFT JOIN i USING (sample_id)),
f AS (SELECT *, CASE WHEN NOT clash THEN g1 END AS alloy_grade, CASE WHEN NOT clash THEN c1 END AS coarse_condition, CASE WHEN celsius THEN t END AS temp FROM k),
e AS (SELECT *, list_filter([CASE WHEN clash THEN 'ambiguous_alias' END, CASE WHEN alloy_grade IS NULL THEN 'missing_grade' END, CASE WHEN coarse_condition IS NULL THEN 'unknown_condition' END,
    CASE WHEN t IS NULL OR hold IS NULL OR NOT celsius OR coalesce(unit, '') NOT IN ('M', 'H') THEN 'missing_thermal_metadata' END, CASE WHEN cool = 'Q' THEN 'unspecified_quench_medium' END, CASE WHEN cool = 'oil' THEN 'special_cooling_code' END,
    CASE WHEN len(regexp_extract_all(lab, '(?i)(?:^|[^-\\w])\\d+(?:\\.\\d+)?\\s*C\\b')) > 1 THEN 'multi_step_label' END, CASE WHEN lab <> '' AND same > 1 THEN 'duplicate_sample_label' END, CASE WHEN micrographs = 0 THEN 'no_micrographs' END], lambda x: x IS NOT NULL) AS flags,
    CASE WHEN temp IS NOT NULL AND hold IS NOT NULL AND unit IS NOT NULL THEN 't' || {NUMBER("temp")} || 'c_' || {NUMBER("hold")} || lower(unit) || '_' || lower(coalesce(cool, 'unknown')) END AS thermal_signature FROM f),
a AS (SELECT *, CASE WHEN len(list_filter(flags, lambda x: x <> 'duplicate_sample_label')) > 0 THEN 'blocked' WHEN cool = 'WQ' THEN 'candidate' ELSE 'provisional' END AS status FROM e)
"""
SQL["q_audit_flags"] = AUDIT + "SELECT sample_id, alloy_grade, coarse_condition, temp AS temperature_c, hold AS hold_value, unit AS hold_unit, micrographs, array_to_string(flags, '|') AS flags, status, thermal_signature FROM a"
COMPLETE = "alloy_grade IS NOT NULL AND coarse_condition IS NOT NULL"
SQL["q_audit_summary"] = AUDIT + f"""
SELECT count(*) AS sample_rows, count(*) FILTER (micrographs > 0) AS samples_with_micrographs, sum(micrographs)::BIGINT AS linked_micrographs, count(*) FILTER ({COMPLETE}) AS complete_key_samples,
    coalesce(sum(micrographs) FILTER ({COMPLETE}), 0)::BIGINT AS complete_key_micrographs, coalesce(sum(micrographs) FILTER (status = 'candidate'), 0)::BIGINT AS candidate_micrographs,
    coalesce(sum(micrographs) FILTER (status = 'provisional'), 0)::BIGINT AS provisional_micrographs, coalesce(sum(micrographs) FILTER (status = 'blocked' AND {COMPLETE}), 0)::BIGINT AS blocked_complete_key_micrographs,
    (SELECT count(*) FROM lineitem) AS micrographs, ((SELECT count(*) FROM lineitem) - sum(micrographs))::BIGINT AS orphan_micrographs,
    ((SELECT count(*) FROM lineitem) - coalesce(sum(micrographs) FILTER ({COMPLETE}), 0))::BIGINT AS incomplete_key_micrographs FROM a"""
SQL["q_audit_coarse_groups"] = AUDIT + f"SELECT alloy_grade, coarse_condition AS condition, count(*) AS samples, sum(micrographs)::BIGINT AS micrographs, coalesce(array_to_string(list_sort(list(DISTINCT thermal_signature) FILTER (thermal_signature IS NOT NULL)), '|'), '') AS thermal_signatures FROM a WHERE {COMPLETE} AND micrographs > 0 GROUP BY ALL"
SQL["q_audit_exact_groups"] = AUDIT + """
SELECT status, coalesce(alloy_grade, '') AS alloy_grade, thermal_signature, array_to_string(list_sort(list(sample_id)), '|') AS sample_ids, sum(micrographs)::BIGINT AS micrographs,
    array_to_string(list_sort(list_distinct(flatten(list(flags)))), '|') AS flags FROM a WHERE status IN ('candidate', 'provisional') AND thermal_signature IS NOT NULL GROUP BY 1, 2, 3"""
SQL["q_split_groups"] = """
WITH m AS (SELECT DISTINCT o_custkey AS sample_key, CASE WHEN o_custkey % 4 <> 0 THEN (o_custkey % 90)::VARCHAR ELSE '' END AS label FROM orders),
g AS (SELECT label, list_sort(list(sample_key)) AS ids FROM m GROUP BY label)
SELECT unnest(ids) AS sample_key, CASE WHEN label <> '' AND len(ids) > 1 THEN 'lot-samples-' || array_to_string(ids, '-') ELSE 'lot-sample-' || ids[1] END AS group_id FROM g"""

# --- records
SQL["q_metadata_join"] = "SELECT c_custkey, n_name, round(c_acctbal / nullif(c_nationkey, 0), 6) AS scale FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"
SQL["q_canonical_union"] = """
SELECT 'documents-' || doc_id AS record_id, 'text' AS modality, source AS group_id, 'documents' AS adapter, 0::BIGINT AS n_properties FROM documents
UNION ALL SELECT 'pages-' || page_id, 'html', 'pages-' || page_id, 'pages', 0 FROM pages
UNION ALL SELECT 'turns-' || conv_id || '-' || turn, role, conv_id::VARCHAR, 'conversations', 0 FROM conversations"""
SQL["q_group_default"] = """
SELECT doc_id, CASE WHEN lang = 'fr' THEN 'doc-' || doc_id ELSE lang END AS group_id, CASE WHEN lang <> 'de' AND source <> 'src0' THEN lang END AS alloy_grade,
    CASE WHEN lang <> 'de' AND source <> 'src0' THEN source END AS condition FROM documents"""

# --- vocabulary
NODES = """
WITH RECURSIVE edge AS (SELECT r_name AS key, NULL::VARCHAR AS up, r_name AS name, 'region' AS axis FROM region
    UNION ALL SELECT n_name, r_name, n_name, 'nation' FROM nation JOIN region ON n_regionkey = r_regionkey),
node AS (SELECT key AS id, key, axis, 1 AS level FROM edge WHERE up IS NULL
    UNION ALL SELECT node.id || '/' || edge.key, edge.key, edge.axis, level + 1 FROM edge JOIN node ON edge.up = node.key AND node.level = 1)"""
PLACES = NODES + """,
place AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'ATLANTIS' WHEN c_custkey % 20 = 0 THEN r_name WHEN c_custkey % 33 <> 0 THEN r_name || '/' || n_name END AS node
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SQL["q_vocab_tree"] = NODES + "SELECT axis, id, repeat('  ', level - 1) || id AS line FROM node"
SQL["q_vocab_unknown"] = PLACES + "SELECT c_custkey, node FROM place WHERE node IS NOT NULL AND node NOT IN (SELECT id FROM node)"
SQL["q_vocab_wrong_axis"] = PLACES + "SELECT c_custkey, place.node, axis FROM place JOIN node ON place.node = node.id WHERE axis <> 'nation'"

# --- strings
SQL["q_tokens"] = f"SELECT doc_id, md5(array_to_string({tokens('text')}, ' ')) AS tokens_md5 FROM documents"
STEEL = "WITH s AS (SELECT p_partkey, concat_ws(' ', p_name, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {quoted(x)}" for i, x in enumerate(PROBE_STEEL)) + " END) AS raw FROM part)"


def matched(aliases: dict[str, str]) -> str:
    return STEEL + f""",
    t AS (SELECT p_partkey, ' ' || array_to_string({tokens('raw')}, ' ') || ' ' AS padded FROM s),
    h AS (SELECT p_partkey, node, rank() OVER (PARTITION BY p_partkey ORDER BY len DESC) AS best FROM t JOIN {alias_rows(aliases)} ON contains(padded, ' ' || phrase || ' ')),
    b AS (SELECT p_partkey, min(node) AS node, count(DISTINCT node) AS n FROM h WHERE best = 1 GROUP BY p_partkey)"""


SQL["q_alias_match"] = matched(GRADE_ALIASES) + "SELECT s.p_partkey, CASE WHEN n = 1 THEN node END AS node_id FROM s LEFT JOIN b USING (p_partkey)"
SQL["q_alias_ambiguous"] = matched(GRADE_ALIASES) + "SELECT p_partkey FROM b WHERE n > 1"
SQL["q_condition_match"] = matched(CONDITION_ALIASES) + "SELECT s.p_partkey, CASE WHEN n = 1 THEN node END AS node_id, coalesce(n > 1, false) AS ambiguous FROM s LEFT JOIN b USING (p_partkey)"
SQL["q_structured_lookup"] = f"""
WITH s AS (SELECT p_partkey, p_partkey % 3 < 2 AS water, [700, 800, 970, 1000][p_size % 4 + 1] AS c, [5, 90, 90, 480, 1440][p_partkey % 5 + 1] AS m FROM part)
SELECT p_partkey, CASE WHEN water THEN CASE {' '.join(f"WHEN c = {c} AND m = {m} THEN '{WATER_QUENCH}/{leaf}'" for (c, m), leaf in EXACT_ROUTES.items())} END END AS node_id FROM s"""
SQL["q_regex_steps"] = """
WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || 'C 5M x-' || p_size || 'C' WHEN 1 THEN 'AC ' || p_size || '.5 c 1H ' || p_size || ' C 2H' WHEN 2 THEN 'WQ' ELSE p_name END AS label FROM part)
SELECT p_partkey, len(regexp_extract_all(label, '(?i)(?:^|[^-\\w])\\d+(?:\\.\\d+)?\\s*C\\b'))::BIGINT AS n_temperatures FROM s"""
SQL["q_scope_fallback"] = """
WITH q AS (SELECT p_partkey, p_type, p_type || '/' || p_brand AS scope FROM part), own AS (SELECT scope FROM q GROUP BY scope HAVING count(*) % 2 = 0)
SELECT p_partkey, coalesce(own.scope, p_type) AS registered_scope, CASE WHEN own.scope IS NULL THEN 'type' ELSE 'own' END AS head FROM q LEFT JOIN own ON own.scope = q.scope"""

# --- validation
_K = "p_partkey"
RULES = [
    "trim(alloy_grade) = ''", "trim(condition) = ''", "trim(property_name) <> 'hardness_hv'", "trim(property_name) <> 'hardness_hv' OR trim(unit) <> 'HV'", "conf NOT IN ('low', 'medium', 'high')", "kind NOT IN ('sd', 'half_range', 'tolerance_band', 'unreported')",
    "trim(source_citation) = ''", "v IS NULL", "trim(property_name) = 'hardness_hv' AND v <= 0", "trim(scatter) <> '' AND s IS NULL", "s < 0", "(trim(scatter) = '') <> (kind = 'unreported')",
    "(trim(n_measurements) <> '' AND n IS NULL) OR n <> floor(n) OR n < 1", "conf = 'high' AND trim(scatter) = '' AND trim(n_measurements) = ''",
]
RULE_NAMES = ["alloy_grade", "condition", "property_name", "unit", "join_confidence", "scatter_kind", "source_citation", "value", "value_positive", "scatter", "scatter_negative", "scatter_reported", "n_measurements", "evidence"]
_finite = lambda c: f"CASE WHEN isfinite(TRY_CAST(trim({c}) AS DOUBLE)) THEN TRY_CAST(trim({c}) AS DOUBLE) END"
SQL["q_validation_report"] = f"""
WITH m AS (SELECT {_K} AS row, CASE WHEN {_K} % 31 = 1 THEN '  ' ELSE p_brand END AS alloy_grade, CASE WHEN {_K} % 37 = 1 THEN '' ELSE p_type END AS condition, CASE WHEN {_K} % 23 = 1 THEN 'fatigue_life' ELSE ' hardness_hv' END AS property_name,
    CASE {_K} % 29 WHEN 1 THEN 'nan' WHEN 2 THEN '0' WHEN 3 THEN 'abc' WHEN 4 THEN '' ELSE p_size::VARCHAR END AS value, CASE WHEN {_K} % 19 = 1 THEN 'HB' ELSE 'HV' END AS unit,
    CASE {_K} % 17 WHEN 1 THEN '-1' WHEN 2 THEN 'inf' WHEN 3 THEN '' ELSE '8' END AS scatter, CASE WHEN {_K} % 13 = 1 THEN 'range' WHEN {_K} % 17 = 3 THEN '' ELSE 'SD ' END AS scatter_kind,
    CASE {_K} % 11 WHEN 1 THEN '2.5' WHEN 2 THEN '0' WHEN 3 THEN '' ELSE '4' END AS n_measurements, CASE {_K} % 7 WHEN 1 THEN 'pretty sure' WHEN 2 THEN 'High' ELSE 'low' END AS join_confidence,
    CASE WHEN {_K} % 41 = 1 THEN ' ' ELSE 'a paper' END AS source_citation FROM part),
t AS (SELECT *, lower(trim(join_confidence)) AS conf, coalesce(nullif(lower(trim(scatter_kind)), ''), 'unreported') AS kind, {_finite('value')} AS v, {_finite('scatter')} AS s, {_finite('n_measurements')} AS n FROM m)
""" + " UNION ALL ".join(f"SELECT row, {i} AS rule_ord, '{name}' AS rule FROM t WHERE {cond}" for i, (name, cond) in enumerate(zip(RULE_NAMES, RULES)))
SQL["q_duplicates"] = "WITH d AS (SELECT doc_id AS row, md5(text) AS digest, min(doc_id) OVER (PARTITION BY md5(text)) AS first_row FROM documents) SELECT row, first_row, digest FROM d WHERE row <> first_row"
SQL["q_fd_violation"] = "WITH d AS (SELECT doc_id AS row, source, lang, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents) SELECT row, source FROM d WHERE before IS NOT NULL AND before <> lang"
SQL["q_hash_check"] = """
SELECT d.doc_id AS row, d.doc_id::VARCHAR AS image_path, CASE WHEN d.doc_id % 10 = 0 THEN sha256(d.source) ELSE sha256(d.text) END AS expected, CASE WHEN d.doc_id % 17 <> 0 THEN sha256(d.text) END AS found
FROM documents d WHERE d.doc_id % 17 = 0 OR d.doc_id % 10 = 0"""


# --- weak labels
def weak(levels: str) -> str:
    return f"""
    WITH e AS (SELECT p_brand, p_type, max(p_retailprice) AS value, count(*) % 3 AS level FROM part GROUP BY ALL)
    SELECT p_partkey::VARCHAR AS record_id, CASE WHEN p_partkey % 11 = 0 THEN p_size::DOUBLE ELSE e.value END AS value, CASE WHEN p_partkey % 11 <> 0 AND e.value IS NOT NULL THEN 'distant' END AS source
    FROM part LEFT JOIN e ON part.p_brand = e.p_brand AND part.p_type = e.p_type AND p_partkey % 13 <> 0 AND level IN ({levels})"""


SQL["q_weak_join_low"], SQL["q_weak_join_medium"] = weak("0, 1, 2"), weak("1, 2")
SQL["q_measured_only"] = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'quality' ELSE 'toxic' END AS measured FROM labels"
SQL["q_first_value_by_group"] = """
WITH e AS (SELECT user_id AS group_id, value, row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'click'), event_id) AS n FROM events WHERE event_id % 3 <> 0)
SELECT group_id, value FROM e WHERE n = 1"""

# --- splits and groups
SQL["q_group_split"] = """
WITH g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('7:' || o_custkey), o_custkey) AS place, count(*) OVER () AS n FROM g)
SELECT o_orderkey, orders.o_custkey, CASE WHEN place <= round_even(n * 0.15::DOUBLE, 0) THEN 'test' WHEN place <= round_even(n * 0.15::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM orders JOIN r ON orders.o_custkey = r.o_custkey"""
SQL["q_group_split_leakage"] = "SELECT 0::BIGINT AS straddling"
SQL["q_heldout_split"] = "SELECT doc_id, lang, CASE WHEN lang IN ('de', 'fr') THEN 'test' ELSE 'train' END AS split FROM documents"
SQL["q_group_mean"] = """
WITH l AS (SELECT l_orderkey AS group_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS q, l_discount, CASE WHEN l_linenumber > 1 THEN l_returnflag END AS f, l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS place FROM lineitem WHERE l_orderkey % 9 <> 0)
SELECT group_id, arg_min(f, place) FILTER (f IS NOT NULL) AS l_returnflag, arg_min(l_linestatus, place) AS l_linestatus, round(avg(q), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM l GROUP BY group_id"""
SQL["q_summary_nunique"] = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(value) AS low, max(value) AS high FROM events GROUP BY event_type"

# --- masks
PIXELS = """
WITH RECURSIVE px AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
cell AS (SELECT vec_id, i, CASE WHEN x < -0.1::DOUBLE THEN 0 WHEN x < 0 THEN 1 WHEN x < 0.1::DOUBLE THEN 2 ELSE 3 END AS cls FROM px),
spine AS (SELECT vec_id, k AS cls FROM embeddings, range(4) t(k))"""
SQL["q_class_fraction"] = PIXELS + "SELECT s.vec_id AS record_id, s.cls::INTEGER AS cls, round(count(c.i) / 64, 6) AS fraction FROM spine s LEFT JOIN cell c ON c.vec_id = s.vec_id AND c.cls = s.cls GROUP BY ALL"
SQL["q_class_balance"] = PIXELS + "SELECT cls, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cell GROUP BY cls"
SQL["q_histogram"] = "SELECT least(floor(l_quantity / 3), 15)::INTEGER AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 48 GROUP BY 1"
NEAR4, NEAR8 = "(abs(a.i % 8 - b.i % 8) + abs(a.i // 8 - b.i // 8) = 1)", "(greatest(abs(a.i % 8 - b.i % 8), abs(a.i // 8 - b.i // 8)) = 1)"


def reach(name: str, cells: str, near: str) -> str:
    """root of every cell: the least cell that it is joined with."""
    return f""", {name} AS (SELECT vec_id, k, i, i AS root FROM {cells} UNION SELECT b.vec_id, b.k, b.i, a.root FROM {name} a JOIN {cells} b ON a.vec_id = b.vec_id AND a.k = b.k AND {near}),
    {name}_root AS (SELECT vec_id, k, i, min(root) AS root FROM {name} GROUP BY ALL)"""


REGION = PIXELS + ", own AS (SELECT vec_id, cls AS k, i FROM cell)" + reach("r", "own", NEAR4) + ", area AS (SELECT vec_id, k, root, count(*) AS n FROM r_root GROUP BY ALL)"
STATS = "SELECT s.vec_id AS record_id, s.cls::INTEGER AS cls, count(a.n)::INTEGER AS n_regions, round(coalesce(avg(a.n), 0), 6) AS mean_area, coalesce(max(a.n), 0)::INTEGER AS max_area FROM spine s LEFT JOIN area a ON a.vec_id = s.vec_id AND a.k = s.cls GROUP BY ALL"
SQL["q_region_stats"] = REGION + STATS
SQL["q_homology"] = PIXELS + ", own AS (SELECT vec_id, cls AS k, i FROM cell), back AS (SELECT c.vec_id, t.k, c.i FROM cell c, range(4) t(k) WHERE c.cls <> t.k)" + reach("r", "own", NEAR8) + reach("q", "back", NEAR4) + """,
    hole AS (SELECT vec_id, k, root FROM r_root GROUP BY ALL HAVING bool_and(i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6)),
    part_ AS (SELECT DISTINCT vec_id, k, root FROM q_root),
    bars AS (SELECT s.vec_id AS record_id, s.cls::INTEGER AS cls, greatest(0, (SELECT count(*) FROM part_ p WHERE p.vec_id = s.vec_id AND p.k = s.cls) - 1)::DOUBLE AS h0_count,
        (SELECT count(*) FROM hole h WHERE h.vec_id = s.vec_id AND h.k = s.cls)::DOUBLE AS h1_count FROM spine s),
    summary AS (SELECT record_id, cls, h0_count, h0_count AS h0_total_persistence, least(h0_count, 1) AS h0_max_persistence, h1_count, h1_count AS h1_total_persistence, least(h1_count, 1) AS h1_max_persistence FROM bars)"""
SQL["q_topological_features"] = SQL["q_homology"] + "SELECT record_id, 'topo_' || what || ':node' || cls AS feature, value FROM summary UNPIVOT (value FOR what IN (h0_count, h0_total_persistence, h0_max_persistence, h1_count, h1_total_persistence, h1_max_persistence))"
SQL["q_homology"] += "SELECT * FROM summary"
SQL["q_tiled_regions"], SQL["q_tiled_homology"] = SQL["q_region_stats"], SQL["q_homology"]
SQL["q_feature_vector"] = REGION + f""", st AS ({STATS}), fr AS (SELECT s.vec_id AS record_id, s.cls, count(c.i) / 64 AS fraction FROM spine s LEFT JOIN cell c ON c.vec_id = s.vec_id AND c.cls = s.cls GROUP BY ALL)
    SELECT record_id, 'frac:node' || cls AS feature, round(fraction, 6) AS value FROM fr UNION ALL SELECT record_id, 'n_regions:node' || cls, n_regions::DOUBLE FROM st
    UNION ALL SELECT record_id, 'mean_region_area:node' || cls, mean_area FROM st UNION ALL SELECT record_id, 'max_region_area:node' || cls, max_area::DOUBLE FROM st"""
SQL["q_occlusion"] = """
WITH px AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT vec_id, sum(x) / 64 AS mean FROM px GROUP BY vec_id)
SELECT vec_id, ((i // 8 // 2) * 4 + i % 8 // 2)::INTEGER AS tile, round(sum(i * (x - mean)), 6) AS delta FROM px JOIN m USING (vec_id) GROUP BY ALL"""

# --- classifiers
MEANS = """
WITH px AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), mean AS (SELECT label, i, avg(x) AS m FROM px GROUP BY ALL),
dist AS (SELECT vec_id, px.label, mean.label AS cls, round(sqrt(sum((x - m) * (x - m))), 9) AS d FROM px JOIN mean USING (i) GROUP BY ALL),
pred AS (SELECT vec_id, label, arg_min(cls, (d, cls)) AS predicted FROM dist GROUP BY ALL),
ex AS (SELECT vec_id, label, cls, exp(-10 * d - max(-10 * d) OVER (PARTITION BY vec_id)) AS e FROM dist),
prob AS (SELECT vec_id, label, cls, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM ex)"""
SQL["q_centroid"] = MEANS + "SELECT label, i::INTEGER AS i, round(m, 6) AS m FROM mean"
SQL["q_nearest_mean"] = MEANS + "SELECT * FROM pred"
SQL["q_confusion"] = MEANS + "SELECT label AS truth, predicted, count(*) AS n FROM pred GROUP BY ALL"
IOU = MEANS + ", iou AS (SELECT k::INTEGER AS cls, round((SELECT count(*) FROM pred WHERE label = k AND predicted = k) / nullif((SELECT count(*) FROM pred WHERE label = k OR predicted = k), 0), 6) AS iou FROM range(12) t(k))"
SQL["q_iou"], SQL["q_mean_iou"] = IOU + "SELECT * FROM iou", IOU + "SELECT round(avg(iou), 6) AS mean_iou FROM iou"
SQL["q_accuracy"] = MEANS + "SELECT round(avg((label = predicted)::INTEGER), 6) AS accuracy FROM pred"
SQL["q_softmax"] = MEANS + "SELECT vec_id, cls::INTEGER AS cls, round(p, 6) AS p FROM prob"
SQL["q_cross_entropy"] = MEANS + "SELECT vec_id, round(-ln(p), 6) AS loss FROM prob WHERE cls = label"
QHAT = MEANS + """, score AS (SELECT round(1 - p, 9) AS s, row_number() OVER (ORDER BY round(1 - p, 9)) AS k, count(*) OVER () AS n FROM prob WHERE cls = label AND vec_id % 2 = 0),
qhat AS (SELECT n, s AS q_hat FROM score WHERE k = ceil((n - 1) * least(ceil((n + 1) * 0.9::DOUBLE) / n, 1)) + 1),
sets AS (SELECT vec_id, list_sort(list(cls) FILTER (round(1 - p, 9) <= q_hat)) AS c FROM prob, qhat GROUP BY vec_id)"""
SQL["q_conformal_qhat"] = QHAT + "SELECT n, q_hat FROM qhat"
SQL["q_conformal_sets"] = QHAT + "SELECT vec_id, coalesce(array_to_string(c, '|'), '') AS classes, CASE WHEN len(c) = 1 THEN c[1] END::INTEGER AS single FROM sets"
SQL["q_predict_abstain"] = QHAT + """, f AS (SELECT vec_id, CASE WHEN len(c) = 1 THEN c[1] END AS k FROM sets)
SELECT vec_id AS record_id, 'family' || k AS family, CASE WHEN k < 6 AND k BETWEEN 2 AND 7 THEN round(vec_id / 100 * 2 + 0.5::DOUBLE + 5, 6) END AS value,
    CASE WHEN k IS NULL THEN 'family' WHEN k >= 6 THEN 'features' WHEN k < 2 THEN 'property' END AS stage,
    CASE WHEN k IS NULL THEN 'prediction set is not a single family' WHEN k >= 6 THEN 'no segmenter for family' || k WHEN k < 2 THEN 'no fitted head for family' || k END AS reason FROM f"""
SQL["q_knn_exclude_block"] = """
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_dot_product(a.v, b.v), 9) AS similarity FROM u a JOIN u b ON a.label <> b.label),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS n FROM s)
SELECT vec_id, neighbour, round(similarity, 6) AS similarity FROM k WHERE n = 1"""

# --- regressors
SQL["q_logo_mean"] = """
WITH b AS (SELECT p_brand, sum(p_retailprice) AS s, count(*) AS n FROM part GROUP BY 1)
SELECT p_partkey, round(((SELECT sum(s) FROM b) - b.s) / ((SELECT sum(n) FROM b) - b.n), 8) AS p FROM part JOIN b USING (p_brand)"""
SQL["q_logo_grade"] = """
WITH w AS (SELECT p_partkey, sum(p_retailprice) OVER () - sum(p_retailprice) OVER (PARTITION BY p_brand) AS s, count(*) OVER () - count(*) OVER (PARTITION BY p_brand) AS n,
    sum(p_retailprice) OVER (PARTITION BY p_type) - sum(p_retailprice) OVER (PARTITION BY p_type, p_brand) AS gs, count(*) OVER (PARTITION BY p_type) - count(*) OVER (PARTITION BY p_type, p_brand) AS gn FROM part)
SELECT p_partkey, round(CASE WHEN gn > 0 THEN gs / gn ELSE s / n END, 8) AS p FROM w"""
METRICS = """
WITH m AS (SELECT 'size' AS model, p_retailprice AS y, p_size::DOUBLE * 30 + 200 AS p FROM part UNION ALL SELECT 'key', p_retailprice, (p_partkey % 97)::DOUBLE * 10 + 900 FROM part),
r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY y) + (count(*) OVER (PARTITION BY model, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2 AS rp, avg(y) OVER (PARTITION BY model) AS my FROM m),
g AS (SELECT model, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)), 6) AS r2, round(corr(ry, rp), 6) AS spearman FROM r GROUP BY model)"""
SQL["q_metrics"] = METRICS + "SELECT * FROM g"
SQL["q_best_model"] = METRICS + "SELECT model, mae FROM g ORDER BY mae, model DESC LIMIT 1"
SQL["q_topk"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"
SQL["q_measured_metrics"] = """
WITH m AS (SELECT 'size' AS model, p_partkey, p_retailprice AS y, p_size::DOUBLE * 30 + 200 AS p FROM part UNION ALL SELECT 'key', p_partkey, p_retailprice, (p_partkey % 97)::DOUBLE * 10 + 900 FROM part),
b AS (SELECT 'all' AS subset, * FROM m UNION ALL SELECT 'measured', * FROM m WHERE p_partkey % 3 = 0),
r AS (SELECT *, rank() OVER (PARTITION BY model, subset ORDER BY y) + (count(*) OVER (PARTITION BY model, subset, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY model, subset ORDER BY p) + (count(*) OVER (PARTITION BY model, subset, p) - 1) / 2 AS rp, avg(y) OVER (PARTITION BY model, subset) AS my FROM b)
SELECT model, subset, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)), 6) AS r2, round(corr(ry, rp), 6) AS spearman FROM r GROUP BY model, subset"""


def two_feature_ridge(rows: str, block: str, key: str) -> str:
    """Leave-one-out by taking each row out of its block's moments; two standardised features with a penalty of 1 solve in closed form."""
    return f"""
    WITH t AS ({rows}), g AS (SELECT {block}, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS c1, covar_pop(x2, y) * count(*) AS c2 FROM t GROUP BY {block} HAVING count(*) >= 3),
    d AS (SELECT t.*, n, m1, m2, my, x1 - m1 AS d1, x2 - m2 AS d2, y - my AS e, n / (n - 1) AS f, s11, s22, s12, c1, c2 FROM t JOIN g USING ({block})),
    r AS (SELECT *, sqrt((s11 - f * d1 * d1) / (n - 1)) AS sd1, sqrt((s22 - f * d2 * d2) / (n - 1)) AS sd2, s12 - f * d1 * d2 AS r12, c1 - f * d1 * e AS b1, c2 - f * d2 * e AS b2 FROM d),
    q AS (SELECT *, r12 / (sd1 * sd2) AS o, b1 / sd1 AS z1, b2 / sd2 AS z2 FROM r)
    SELECT {block}, {key}, round(my - e / (n - 1) + f * d1 / sd1 * (n * z1 - o * z2) / (n * n - o * o) + f * d2 / sd2 * (n * z2 - o * z1) / (n * n - o * o), 6) AS p FROM q"""


SQL["q_loo_ridge"] = two_feature_ridge("SELECT p_brand, p_partkey, p_size::DOUBLE AS x1, (p_partkey % 97)::DOUBLE AS x2, p_retailprice AS y FROM part", "p_brand", "p_partkey")
SQL["q_linear_head"] = "SELECT group_id, p FROM (" + two_feature_ridge("SELECT 0 AS one, p_brand AS group_id, avg(p_size::DOUBLE) AS x1, avg((p_partkey % 97)::DOUBLE) AS x2, avg(p_retailprice) AS y FROM part GROUP BY p_brand", "one", "group_id") + ")"

# --- record operators
SQL["q_masked_records"] = "SELECT doc_id, 'a|b' AS nodes FROM documents WHERE doc_id % 3 = 0"
SQL["q_labelled_records"] = "SELECT doc_id FROM documents WHERE lang <> 'es' AND doc_id IN (SELECT doc_id FROM labels)"
SQL["q_class_encode"] = "SELECT doc_id, least(lang, source) || '|' || greatest(lang, source) AS label_set, (dense_rank() OVER (ORDER BY least(lang, source), greatest(lang, source)) - 1)::INTEGER AS cls FROM documents WHERE lang <> 'es'"
SQL["q_scope_filter"] = "SELECT doc_id, CASE WHEN lang = 'en' THEN CASE WHEN source = 'src1' THEN 'en/src1' ELSE 'en' END END AS scope FROM documents"
SQL["q_run_counters"] = """
WITH d AS (SELECT lang = 'en' AS own, doc_id IN (SELECT doc_id FROM labels) AS there FROM documents)
SELECT count(*) FILTER (own AND there) AS used, count(*) FILTER (NOT own) AS skipped_family, count(*) FILTER (own AND NOT there) AS skipped_missing FROM d"""
SQL["q_training_table"] = """
SELECT p_brand AS group_id, round(avg(p_size), 6) AS size, arg_min(p_size::DOUBLE, p_partkey) FILTER (p_partkey % 11 = 0) AS value FROM part
WHERE p_brand NOT LIKE '%3' GROUP BY 1 HAVING count(*) FILTER (p_partkey % 11 = 0) > 0"""
SQL["q_grade_default"] = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'grade-unresolved' ELSE p_brand END AS grade, CASE WHEN p_partkey % 3 <> 0 THEN p_type ELSE p_brand END AS block FROM part"
SQL["q_value_invariant"] = "SELECT max(n) AS most_values FROM (SELECT count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey)"
SQL["q_intersection_fallback"] = "SELECT key, 'both' AS \"case\" FROM (SELECT c_nationkey AS key FROM customer INTERSECT SELECT n_nationkey * 2 FROM nation) UNION ALL SELECT n_nationkey, 'first' FROM nation"
SQL["q_best_epoch"] = "SELECT user_id, arg_max(event_id, (floor(value), -event_id)) AS event_id, max(floor(value))::BIGINT AS metric FROM events WHERE value IS NOT NULL GROUP BY user_id"
SQL["q_head_middle_tail"] = """
WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
SELECT 'head' AS part, k::INTEGER AS place, o_orderkey, o_totalprice FROM r WHERE k < 2 UNION ALL SELECT 'middle', 0, o_orderkey, o_totalprice FROM r WHERE k = n // 2 UNION ALL SELECT 'tail', (k - n + 3)::INTEGER, o_orderkey, o_totalprice FROM r WHERE k >= n - 3"""
SQL["q_ranked_classes"] = MEANS + "SELECT vec_id, string_agg('family' || cls, '|' ORDER BY round(p, 6) DESC, cls) AS families FROM prob GROUP BY vec_id"

# --- pixels
SQL["q_mean_intensity"] = PIXELS.replace("cell AS (SELECT vec_id, i,", "cell AS (SELECT vec_id, i, x,") + "SELECT cls, round(avg(x), 6) AS mean_intensity, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cell GROUP BY cls"
SQL["q_pad_and_crop"] = PIXELS + """
SELECT vec_id AS record_id, 1024 AS n, (12 * 32 + 12)::BIGINT AS first, sum(cls + 1)::DOUBLE AS total, string_agg(cls::VARCHAR, ',' ORDER BY i) FILTER (i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 4) AS middle FROM cell GROUP BY vec_id"""
SQL["q_pixel_layouts"] = PIXELS + """
SELECT vec_id AS record_id, string_agg(cls::VARCHAR, ',' ORDER BY i // 8, -(i % 8)) AS flipped, string_agg(cls::VARCHAR, ',' ORDER BY -(i // 8), i % 8) AS upside, string_agg(cls::VARCHAR, ',' ORDER BY -(i % 8), i // 8) AS turned,
    string_agg(cls::VARCHAR, ',' ORDER BY i) FILTER (i < 48) AS bare, string_agg(cls::VARCHAR, ',' ORDER BY i % 3, i // 3) FILTER (i < 48) AS planes, max(cls) >= 2 AS foreign, string_agg(floor(cls * 1.5)::INTEGER::VARCHAR, ',' ORDER BY i) AS bright FROM cell GROUP BY vec_id"""
SQL["q_normalised_pixels"] = PIXELS + "SELECT vec_id AS record_id, round(sum((cls * 60 / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE), 6) AS total FROM cell GROUP BY vec_id"
SQL["q_centroid_cosine"] = MEANS + "SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS cosine FROM px JOIN mean USING (label, i) GROUP BY vec_id"

# --- records and their checks
SQL["q_record_violations"] = """
SELECT p_partkey::VARCHAR AS record_id, 'nowhere' AS node, 'taxonomy_labels: unknown' AS problem FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey::VARCHAR, 'grade/ferrous', 'taxonomy_labels: not on microconstituent' FROM part WHERE p_partkey % 4 = 2
UNION ALL SELECT p_partkey::VARCHAR, 'ferrous/pearlite', 'alloy_grade: not on alloy_grade' FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT p_partkey::VARCHAR, NULL, 'property_sources' FROM part WHERE p_partkey % 5 = 0"""
SQL["q_metadata_records"] = """
WITH m AS (SELECT *, CASE WHEN p_partkey % 9 <> 0 THEN p_size END AS key, 'image' || p_partkey AS stem FROM part),
l AS (SELECT *, CASE WHEN key % 5 = 0 THEN '' ELSE 'L' || key % 10 END AS label FROM m),
s AS (SELECT DISTINCT key, label FROM l WHERE key IS NOT NULL),
g AS (SELECT key, CASE WHEN label = '' THEN 'lot-sample-' || min(key) OVER (PARTITION BY label) WHEN count(*) OVER (PARTITION BY label) > 1 THEN 'lot-samples-' || string_agg(key::VARCHAR, '-') OVER (PARTITION BY label ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE 'lot-sample-' || key END AS group_id FROM s),
h AS (SELECT 'L' || n_nationkey % 7 AS label, max(n_nationkey)::DOUBLE AS hardness FROM nation GROUP BY 1)
SELECT 'lot-' || p_partkey AS record_id, coalesce(group_id, 'lot-orphan-' || p_partkey) AS group_id, round(p_size / nullif(p_partkey % 3, 0), 6) AS scale, CASE WHEN p_partkey % 2 = 0 THEN 'BSE' ELSE 'SE' END AS modality,
    CASE WHEN p_partkey % 8 = 0 THEN 'ferrous/pearlite|ferrous/spheroidite' END AS labels, CASE WHEN p_partkey % 4 = 0 THEN '/masks/' || stem || '.png' END AS mask_path,
    CASE WHEN p_partkey % 4 = 0 THEN 4 END::INTEGER AS classes, hardness, p_partkey::BIGINT AS record_ord FROM l LEFT JOIN g ON l.key = g.key LEFT JOIN h ON l.label = h.label AND l.key IS NOT NULL"""
SQL["q_feature_merge"] = "SELECT p_partkey, p_size::DOUBLE AS a, CASE WHEN p_partkey % 2 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS b, CASE WHEN p_partkey % 2 = 0 THEN 3.0 ELSE 4.0 END::DOUBLE AS c, 0.0::DOUBLE AS d FROM part"
SQL["q_bounded_bool"] = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS value FROM part"
SQL["q_exact_condition"] = f"SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN CASE p_partkey % 3 WHEN 0 THEN '{WATER_QUENCH}/t800c_90m' WHEN 1 THEN '{WATER_QUENCH}/t970c_3h' END END AS node_id FROM part"
