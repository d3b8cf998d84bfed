import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolith.llm import lloyd, periodic_runs, queries, token_files

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
ODD_TEXTS = [None, "", "   ", "a", "Ünï Cödé x y", "I'm <|endoftext|>they'll <|startoftext|> ΑΣ ΟΔΟΣ", "tab\tnl\nvt\x0bff\x0ccr\rfs\x1cend", "é ́x", "日本語 テキスト😀!!", "x" * 5000, "w " * 3000, "1234567 8.9.10"]


def brute_runs(words):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            if words[i] == words[i + p]:
                j = i
                while j + p < len(words) and words[j] == words[j + p]:
                    j += 1
                if j + p - i >= max(12, 2 * p):
                    found.setdefault((i, j + p - i), p)
                i = j
            i += 1
    return sorted((i, p, n) for (i, n), p in found.items())


def collapsed(words, runs):
    gone = {k for i, p, n in runs for k in range(i + p, i + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("many", [2, 32])  # through whole Z-functions, and through shifts that are followed one by one
def test_runs_equal_brute_force(many, monkeypatch):
    monkeypatch.setattr(periodic_runs, "MANY_SHIFTS", many)
    rng = random.Random(many)
    for _ in range(250):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            words = []
            for _ in range(rng.randrange(0, 6)):
                if rng.random() < 0.6:
                    unit = [rng.randrange(rng.choice([2, 3, 20])) for _ in range(rng.randrange(1, 9))]
                    words += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)]
                else:
                    words += [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(0, 30))]
            docs.append([str(w) for w in words])
        for words, (runs, text) in zip(docs, periodic_runs.search([" ".join(d).encode() for d in docs])):
            expected = brute_runs(words)
            assert [(int(i), int(p), int(n)) for i, n, p in runs] == expected
            assert text.decode() == collapsed(words, expected)


def test_z_function():
    assert periodic_runs.z_function([1, 1, 2, 1, 1, 1, 2]) == [7, 1, 0, 2, 3, 1, 0] and periodic_runs.z_function([3]) == [1]


def test_runs_of_odd_texts(spark):
    texts = [*ODD_TEXTS, " ".join(["a b c"] * 5), "x " * 11, "x " * 12]
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t) for i, t in enumerate(texts)] * 2, DOCS).withColumns({"runs": F.lit(1), "collapsed": F.lit("x"), "row_": F.lit(2)})
    got = sorted((repr(r.doc_id), r.collapsed, [tuple(x) for x in r.runs]) for r in periodic_runs.collapse_runs(docs).collect())
    expected = []
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(words) if len(words) < 1000 else [(0, 1, len(words))]
        expected += [(repr(None if i == 3 else i // 2), collapsed(words, runs), [(s, n, p) for s, p, n in runs])] * 2
    assert got == sorted(expected)
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0


def test_op12_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        ids: dict = {}
        s = np.array([ids.setdefault(w, len(ids)) for w in words])
        runs: dict = {}
        for p in range(1, n // 2 + 1):
            change = np.flatnonzero(np.diff(np.concatenate([[0], (s[:-p] == s[p:]).astype(int), [0]])))
            for i, j in zip(change[::2].tolist(), change[1::2].tolist()):
                if j - i + p >= max(12, 2 * p):
                    runs.setdefault((i, j - i + p), p)
        runs = sorted((i, p, length) for (i, length), p in runs.items())
        best = min(runs, key=lambda r: (-r[2], r[0], r[1])) if runs else None
        top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        lines = "".join(f"{i},{length},{p}\n" for i, p, length in runs)
        assert tuple(got[doc_id]) == (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


# --- token files ---------------------------------------------------------------------------------


def library_ids(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.word_tokenizer())
    return [[*model.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("width, bits", [(2, True), (2, False), (4, True), (4, False)])
def test_planes_come_back(width, bits):
    for n in (1, 7, 8, 9, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << (8 * width), n).astype(f"<u{width}")
        planes = token_files.to_planes(ids, width, bits)
        assert len(planes) == (8 * width if bits else width) and (token_files.from_planes(planes, n, width) == ids).all()


@pytest.mark.parametrize("bits", [True, False])
def test_token_files_of_odd_texts(spark, tmp_path, bits):
    texts = ODD_TEXTS * 3
    docs = spark.createDataFrame([(None if i % 12 == 4 else 7 if i % 3 else i, t) for i, t in enumerate(texts)], DOCS).withColumns({"ids": F.lit(0), "shard": F.lit(5), "row": F.lit("r"), "hash": F.lit(1)})
    path = f"{tmp_path}/files"
    token_files.write_token_files(docs.repartition(5), queries.word_tokenizer(), path, block_ids=16, bits=bits)
    got = token_files.read_documents(spark, path).orderBy("start").collect()
    unpack = lambda r: np.frombuffer(bytes(r.ids), "<u4").tolist()
    wanted = sorted((repr(d), i) for (d, _, *_), i in zip(docs.collect(), library_ids(texts)))
    assert sorted((repr(r.doc_id), unpack(r)) for r in got) == wanted
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d)) and [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    everything = [i for r in got for i in unpack(r)]
    index = token_files.read_index(spark, path).orderBy("start").collect()
    assert sum(r.n_ids for r in index) == len(everything) and sum(r.n_docs for r in index) == len(got) and all(len(r.plane_bytes) == (16 if bits else 2) for r in index)
    for first, last in ((0, 1), (5, 77), (15, 17), (len(everything) - 3, len(everything) + 9), (len(everything), len(everything) + 1)):
        pieces = token_files.read_ids(spark, path, first, last).orderBy("start").collect()
        assert [i for p in pieces for i in p.ids] == everything[first:last]


def test_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], DOCS), queries.word_tokenizer(), f"{tmp_path}/none")
    assert token_files.read_documents(spark, f"{tmp_path}/none").count() == 0 and token_files.read_ids(spark, f"{tmp_path}/none", 0, 9).count() == 0


def test_many_rows_with_one_id_are_spread(spark, tmp_path):
    docs = spark.range(4000).select((F.col("id") * 0 + 3).alias("doc_id"), F.lit("same words in each").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one task's otherwise
    try:
        token_files.write_token_files(docs, queries.word_tokenizer(), f"{tmp_path}/hot")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n for r in token_files.read_index(spark, f"{tmp_path}/hot").groupBy("shard").agg(F.sum("n_docs").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    assert token_files.read_documents(spark, f"{tmp_path}/hot").agg(F.count("*"), F.max("start")).first() == (4000, 3999 * 5)


def test_a_wide_end_id_widens_all(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([(1, "a b")], DOCS), queries.word_tokenizer(), f"{tmp_path}/wide", end_id=70_000)
    assert np.frombuffer(bytes(token_files.read_documents(spark, f"{tmp_path}/wide").first().ids), "<u4").tolist() == [*library_ids(["a b"])[0][:-1], 70_000]


def test_op11_equals_the_library(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op11_token_files(spark, SF).collect()}
    start = 0
    for (doc_id, _), ids in zip(rows, library_ids([r.text for r in rows])):
        assert tuple(got[doc_id]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


# --- clusters ------------------------------------------------------------------------------------


def test_op13_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    ours = queries.op13_lloyd(spark, SF)
    theirs = db.sql(f"SELECT {', '.join(ours.columns)} FROM ({queries.ORACLE_SQL['op13_lloyd']})").fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(theirs) and theirs


def plain_lloyd(vectors, clusters, rounds, dims):
    kept = [(i, [int(np.floor(min(max(256 * float(x), -(2**27)), 2**27))) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        members: dict = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[k]) for x in zip(*members[k])] if k in members else c for k, c in enumerate(centroids)]
    return sorted((repr(i), near(v)[1], near(v)[0]) for i, v in kept), centroids


def test_lloyd_with_ties_nulls_and_odd_vectors(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0, 2.5]) for _ in range(4)]) for i in range(200)]
    vectors += [(None, [9.0, 9.0, 9.0, 9.0]), (3, vectors[3][1]), (3, [1.0] * 4), (500, None), (501, []), (502, [1.0] * 3), (503, [1.0, None, 2.0, 3.0]), (504, [float("nan")] * 4), (505, [float("inf")] + [0.0] * 3), (506, [1e300, -1e300, 0.0, 1.0])]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").withColumns({"v": F.lit(1), "cluster": F.lit("c"), "h": F.lit(0)})
    for clusters in (3, 17):
        assigned, centroids = lloyd.lloyd(table.repartition(7), clusters=clusters, rounds=3, dims=4)
        expected, wanted = plain_lloyd(vectors, clusters, 3, 4)
        assert sorted((repr(r.vec_id), r.cluster, r.distance) for r in assigned.collect()) == expected and centroids == wanted
        report = lloyd.cluster_report(assigned, centroids).collect()
        for r in report:
            assert r.cluster_inertia == sum(d for _, k, d in expected if k == r.cluster) and r.inertia == sum(d for _, _, d in expected)
            assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, wanted[r.cluster])).encode()).hexdigest()
        assert len(report) == len(expected)


def test_lloyd_with_few_vectors_and_none(spark):
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assigned, centroids = lloyd.lloyd(two, clusters=40, dims=2)
    assert {tuple(r) for r in assigned.collect()} == {(1, 0, 0), (2, 0, 0)} and len(centroids) == 2  # equal distances: the smaller number
    assigned, centroids = lloyd.lloyd(two.limit(0), dims=2)
    assert assigned.count() == 0 and centroids == [] and lloyd.cluster_report(assigned, centroids).count() == 0
