"""The dealt operators as queries over the driver's tables, with DuckDB SQL where SQL expresses the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm import exact_dedup, fingerprints, licenses, lloyd, mixing, periodic_runs, sentencepiece_bpe, sharding, simhash, suffix_dedup, token_files, toxicity, url_filter
from ferrolith.llm.common import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.tree_of(8), sharding.tree_of(9))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), piece_model())


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=4, most_bits=4)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), word_tokenizer(), path, end_id=2)
    return token_files.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id) divides by ten, words from a place a on are repeated with a period. Null doc_ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words).cast("bigint")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("bigint")
        place = F.struct(a.alias("a"), p.alias("p"))
        at = lambda x: F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int"))))
        return F.when(n > 0, F.array_join(F.get(F.transform(F.array(place), at), F.lit(0)), " "))

    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    changed = F.get(F.transform(F.array(words), repeated), F.lit(0))  # so that words are cut once
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(changed, F.col("text"))).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_repeats(table(spark, sf_dir, "documents")))
    # Runs are in the order of start, then period: the first of the longest is the one reported.
    longest = F.array_max(F.transform("runs", lambda r, i: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    start, length, period = -F.col("best.before"), F.col("best.length"), -F.col("best.period")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster_report(*lloyd.lloyd(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, seed=2))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sharding": op3_sharding,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_fingerprints": op5_fingerprints,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_license_scans": op10_license_scans,
    "op11_token_files": op11_token_files,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lloyd": op13_lloyd,
}


def _op1_sql() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # Terms stand between characters that are not ASCII letters or digits; counts overlap at one shared boundary.
    spaced = "regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g')"
    one = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::BIGINT"
    times = lambda t: f"len(regexp_extract_all(spaced, '(?:^|[^a-z0-9]){t.replace('-', '--')}(?:$|[^a-z0-9])'))::BIGINT"
    soft, strict = " + ".join(map(one, url_filter.SOFT_TERMS)), " + ".join(map(times, url_filter.STRICT_TERMS))
    fits = []
    for verdict, host, path in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])):
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')", host + path, verdict))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + f" WHEN n_strict >= 1 OR n_soft >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END"
    return f"""
    WITH a AS (SELECT page_id, url, {low} AS low,
        translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    b AS (SELECT *, {spaced} AS spaced FROM a),
    c AS (SELECT *, {soft} AS n_soft, {strict} AS n_strict FROM b)
    SELECT page_id, host, path, {rule} AS rule, {ruled} AS verdict, n_strict, n_soft FROM c"""


OP2_SQL = """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""

OP9_SQL = """
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
    w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM r),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
    c AS (SELECT first(level ORDER BY cap / weight, rank) FILTER (level * weight <= cap) AS chosen FROM l),
    t AS (SELECT source, source_size, least(cap, coalesce(chosen * weight, cap)) AS target FROM l, c),
    k AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS copies FROM t),
    hs AS (SELECT source, h, sum(size)::BIGINT AS at_hash FROM d GROUP BY source, h),
    run AS (SELECT source, h, at_hash, sum(at_hash) OVER (PARTITION BY source ORDER BY h) AS running FROM hs),
    j AS (SELECT run.*, target - copies * source_size AS left_over FROM run JOIN k ON run.source IS NOT DISTINCT FROM k.source),
    cut AS (SELECT source, min(h) AS h FROM j WHERE running > left_over GROUP BY source),
    more AS (SELECT j.source, j.h, CASE WHEN cut.h IS NULL OR j.h < cut.h THEN 1 WHEN j.h = cut.h AND (left_over - (running - at_hash)) * 2 >= at_hash THEN 1 ELSE 0 END AS one
        FROM j LEFT JOIN cut ON j.source IS NOT DISTINCT FROM cut.source)
    SELECT d.doc_id, d.size, k.source_size, k.target::DOUBLE AS target,
        CASE WHEN k.source_size > 0 THEN least(k.copies + more.one, 3) ELSE 0 END * d.size AS taken,
        (CASE WHEN k.source_size > 0 THEN least(k.copies + more.one, 3) ELSE 0 END)::BIGINT AS copies
    FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN more ON d.source IS NOT DISTINCT FROM more.source AND d.h = more.h"""


def _op13_sql(rounds: int = 5) -> str:
    """Each round as long tables of components: distances by a join over dimensions, then floors of integer means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    d{r} AS (SELECT x.rid, y.c, sum((x.v - y.v) * (x.v - y.v))::BIGINT AS d FROM x JOIN c{r} y USING (i) GROUP BY ALL),
    a{r} AS (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
    s{r} AS (SELECT a.c, x.i, sum(x.v)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN x USING (rid) GROUP BY ALL),
    c{r + 1} AS (SELECT y.c, y.i, CASE WHEN n IS NULL THEN y.v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{r} y LEFT JOIN s{r} USING (c, i))""")
    return f"""
    WITH q AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    first AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM q QUALIFY c < 40),
    x AS (SELECT rid, unnest(range(64)) AS i, unnest(v) AS v FROM q),
    c0 AS (SELECT c, unnest(range(64)) AS i, unnest(v) AS v FROM first),{",".join(steps)},
    h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
    SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM a{rounds} JOIN q USING (rid) JOIN h USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": _op1_sql(),
    "op2_exact_dedup": OP2_SQL,
    "op9_mixing": OP9_SQL,
    "op13_lloyd": _op13_sql(),
}
