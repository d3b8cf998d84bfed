"""Toxicity on held-out labels, segments against brute force, and the pipeline against a plain version of it."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from ferrolith.llm import queries, sentencepiece_bpe, simhash, toxicity

SF = "/root/testdata/sf0.01"


def plain_segments(scores):
    """All maximal segments by recursion: the best segment, then those left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[2] + 1e-12 or (abs(s - best[2]) < 1e-12 and j - i < best[1] - best[0])):
                best = (i, j, s)
    if best is None:
        return []
    i, j, _ = best
    return plain_segments(scores[:i]) + [best] + [(a + j, b + j, s) for a, b, s in plain_segments(scores[j:])]


def test_segments_against_recursion():
    rng = np.random.default_rng(1)
    for _ in range(150):
        x = np.round(rng.normal(-0.2, 1, rng.integers(0, 14)), 3)
        ours = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(x)]
        assert ours == [(a, b, round(s, 6)) for a, b, s in plain_segments(list(x))]


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of plain words, some with toxic ones."""
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.integers(0, 400, rng.integers(5, 120))]
        toxic = i % 7 == 0
        for _ in range(rng.integers(2, 5) if toxic else 0):
            words.insert(int(rng.integers(0, len(words))), ["idiot", "scum", "trashen", "trashing"][int(rng.integers(0, 4))])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(0), "toxic": F.lit(3), "held_out": F.lit("x")})
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score_documents(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    text = "wab wcd idiot scum idiot wef"
    (start, end, _), *_ = toxicity.toxic_passages(text, model)
    assert "idiot" in text[start:end]


def test_held_out_labels_are_never_read(labelled):
    docs, labels = labelled
    odd = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels).scores == toxicity.fit(docs, odd).scores


def test_toxicity_edges(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "idiot " * 20000)], "doc_id long, text string")
    rows = toxicity.score_documents(odd, model).collect()
    assert len(rows) == 4 and rows[0].score == rows[1].score == rows[2].score < 0.3 < rows[3].score and rows[0].held_out is False
    assert toxicity.score_documents(odd.filter("false"), model).count() == 0
    blank = toxicity.fit(docs, labels.filter("false"))
    assert {r.predicted for r in toxicity.score_documents(odd, blank).collect()} == {0}
    assert toxicity.clean_documents(docs.filter("false"), labels).count() == 0
    mixed = spark.createDataFrame([(1, "a harmless short note", {"a": 1}), (1, "idiot scum idiot scum", None), (None, "scum idiot " * 9, None), (None, "waa wab", None), (2, None, None)], "doc_id long, text string, more map<string,int>")
    kept = toxicity.clean_documents(docs.select("doc_id", "text").unionByName(mixed, allowMissingColumns=True), labels).filter("doc_id IS NULL OR doc_id < 3")
    assert {(r.doc_id, r.text) for r in kept.join(mixed.select(F.col("text").alias("t")), F.col("text").eqNullSafe(F.col("t"))).collect()} == {(1, "a harmless short note"), (None, "waa wab"), (2, None)}
    first, second = (toxicity.fit(docs.repartition(n), labels) for n in (2, 5))  # reruns agree
    assert first.scores == second.scores and np.allclose(first.weights, second.weights) and first.decay == second.decay


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames, seen = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF)
        out.write.parquet(str(tmp_path / name))
        frames[name] = seen = spark.read.parquet(str(tmp_path / name))
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert frames[name].columns == docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = {name: Counter(r.doc_id for r in f.select("doc_id").collect()) for name, f in frames.items()}

    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {k for k, t in text.items() if model.probability(t)[0] < toxicity.THRESHOLD}
    assert set(ids["toxicity"]) == clean
    last = {}
    for k in sorted(clean):
        last[text[k]] = k
    assert set(ids["exact_dedup"]) == set(last.values())
    shingles = {k: set(simhash.shingle_hashes(text[k], 5)) for k in last.values()}
    holders, least = {}, {k: k for k in shingles}
    for k in sorted(shingles):
        for h in shingles[k]:
            holders.setdefault(h, []).append(k)

    def find(k):
        while least[k] != k:
            k = least[k]
        return k

    for k, own in shingles.items():  # every pair at a similarity of 0.8 or more
        shared = Counter(o for h in own for o in holders[h] if o < k) if own else {o: 0 for o in shingles if o < k and not shingles[o]}
        for o, n in shared.items():
            if n >= 0.8 * (len(own) + len(shingles[o]) - n) - 1e-9 and find(o) != find(k):
                a, b = sorted((find(o), find(k)))
                least[b] = a
    kept = set(ids["simhash_dedup"])
    assert kept == {find(k) for k in shingles}
    assert set(ids["mixing"]) <= kept and max(ids["mixing"].values()) <= 3
    sp = sentencepiece_bpe.load_model(queries.piece_model()).library
    assert ids["sentencepiece"] == ids["mixing"]
    for r in frames["sentencepiece"].limit(60).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, sp.encode(text[r.doc_id]))).encode()).hexdigest()
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, frames["sentencepiece"].collect()))


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
