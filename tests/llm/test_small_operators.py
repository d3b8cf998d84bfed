"""URL filters, exact dedup, sharding, SentencePiece, mixing: against brute force, with edge cases."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from ferrolith.llm import exact_dedup, mixing, queries, sentencepiece_bpe, sharding, simhash, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, n long"
TEXTS = ["a b", "a b", "", None, "x" * 3000, "é ü\n\n", "a b ", None, "tie", "tie"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, 7) for i, t in enumerate(TEXTS)] + [(None, "a b", "s1", 1), (5, "é ü\n\n", "s2", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({"digest": F.lit(1), "size": F.lit("clash"), "shard": F.lit(3), "bucket": F.lit(0), "filter_row": F.lit(9)})


def nothing(docs):
    return docs.filter("false")


def test_registered_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        ours, theirs = queries.QUERIES[name](spark, SF), db.sql(sql)
        order = sorted(ours.columns)
        assert order == sorted(theirs.columns)
        plain = lambda rel, cols: Counter(tuple(round(r[cols.index(c)], 6) if isinstance(r[cols.index(c)], float) else r[cols.index(c)] for c in order) for r in rel)
        assert plain(ours.collect(), ours.columns) == plain(theirs.fetchall(), theirs.columns), name


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://www.a.example.com/en/7x?q#f", "www.a.example.com", "/en/7x", "example.com/en/7", "allow"), ("http://A.Example.COM/en/8", "a.example.com", "/en/8", "com/en/", "block"),
    ("http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"), ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"), ("http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
    ("http://org/es/", "org", "/es/", "org/es/", "block"), ("http://a.org?x=/es/", "a.org", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("http://x.de/porn/1", "x.de", "/porn/1", None, "block"), ("http://x.de/pornography", "x.de", "/pornography", None, "allow"), ("http://x.de/poker-poker", "x.de", "/poker-poker", None, "allow"),
    ("http://poker.de/casino", "poker.de", "/casino", None, "block"), ("ftp://a#b://c/d", "a", "", None, "allow"), ("x\n://h/en/", "h", "/en/", None, "allow"),
])
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "clash")], "page_id long, url string, verdict string")
    r = url_filter.judge_urls(df).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_urls_of_odd_tables(spark):
    schema = "page_id long, url string, host int, n_soft string, html string"
    long = "http://x.de/" + "a-" * 100_000 + "poker?casino"
    rows = [(None, "http://x.de/porn", 1, "clash", None), (3, long, 1, None, ""), (3, long, 1, None, ""), (4, None, None, None, None)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.verdict, r.n_strict, r.n_soft) for r in got) == [(0, "block", 1, 0), (3, "block", 0, 2), (3, "block", 0, 2), (4, "allow", 0, 0)]
    assert url_filter.judge_urls(spark.createDataFrame([], schema)).count() == 0


def test_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Bad", 2.0), ("meh", 1.0), ("meh", None), ("so-so", None), ("", 2.0), (None, 2.0)], "term string, weight double")
    strict, soft = url_filter.read_vocabulary(terms)
    assert (strict, soft) == (("bad",), ("meh", "so-so"))
    pages = spark.createDataFrame([(1, "http://a.de/BAD"), (2, "http://a.de/meh"), (3, "http://meh.de/so-so"), (4, "http://a.de/porn")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, strict=strict, soft=soft).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}


def brute_groups(rows):
    ids = {}
    for i, t in rows:
        ids.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in x if i is not None), default=None) for t, x in ids.items()}
    done, out = set(), Counter()
    for i, t in rows:  # one row of each group is kept
        first = i == keep[t or ""] and (t or "") not in done
        done |= {t or ""} if first else set()
        out[(i, keep[t or ""], len(ids[t or ""]), first, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    return out


def test_exact_groups(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in exact_dedup.exact_groups(docs).collect()) == brute_groups(rows)
    assert exact_dedup.exact_groups(nothing(docs)).count() == 0


def test_colliding_digests_are_told_apart(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    weak = lambda text: F.encode((F.length(text) % 3).cast("string"), "UTF-8")
    got = Counter(tuple(r)[:4] for r in exact_dedup.exact_groups(docs, digest=weak).collect())
    assert got == Counter({k[:4]: n for k, n in brute_groups(rows).items()})


def test_kept_copies_keep_columns(docs):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 9]


def test_exactly_one_row_of_each_text_stays(spark):
    for rows, stay in (
        ([(None, "a b"), (1, "a b"), (None, "zzz")], [(None, "zzz"), (1, "a b")]),
        ([(5, "q"), (5, "q"), (5, "w"), (6, "w")], [(5, "q"), (6, "w")]),
        ([(None, None), (None, ""), (None, "x")], [(None, ""), (None, "x")]),
    ):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"maybe": F.lit(1), "row_": F.lit("mine"), "digest": F.lit("x"), "more": F.create_map(F.lit("a"), F.lit(1))})
        for digest in (exact_dedup.sha256_digest, lambda text: F.encode(F.lit("same"), "UTF-8")):
            groups = exact_dedup.exact_groups(df, digest=digest)
            assert groups.filter("kept").count() == len(stay)
        kept = exact_dedup.drop_exact_copies(df)
        assert kept.columns == df.columns and Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter(stay)


def test_lookups_read_what_the_filters_pass(spark):
    docs = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    digests = lambda d: d.select(exact_dedup.sha256_digest(F.col("text")).alias("digest"))
    index = exact_dedup.DigestIndex(spark, keep="min")
    index.flush(docs(1, 2, 3))
    index.compact()
    level, first, second = index.level.path, index.flush(docs(10, 11)).path, index.flush(docs(20, 21, 21)).path
    assert {(r.doc_id, r.n) for r in index.lookup(digests(docs(2, 21, 99))).collect()} == {(2, 1), (21, 2)} and index.read == [level, second]
    assert index.lookup(digests(docs(98))).count() == 0 and index.read == []
    assert index.lookup(digests(docs(10))).count() == 1 and index.read == [first]
    index.flush(docs(2, 30))
    assert {r.doc_id: r.n for r in index.compact().collect()} == {1: 1, 2: 2, 3: 1, 10: 1, 11: 1, 20: 1, 21: 2, 30: 1} and not index.runs
    assert index.lookup(digests(docs(30))).count() == 1 and index.read == [index.level.path]


def test_runs_merge_over_batches(spark, docs):
    index = exact_dedup.DigestIndex(spark, keep="min")
    assert index.compact().count() == 0
    index.flush(docs.filter("doc_id < 4"))
    index.flush(docs.filter("doc_id >= 4"))
    level = index.compact()
    assert level.agg(F.sum("n")).first()[0] == docs.filter("doc_id IS NOT NULL").count() and {r.doc_id for r in level.filter("n > 1").collect()} == {0, 2, 5, 8}


def xxh64_of(key, name):
    """The hash of two strings, the first one's hash being the second one's seed."""
    h = xxhash.xxh64_intdigest(key.encode(), 42)
    return xxhash.xxh64_intdigest(name.encode(), h)


def plain_shard(hash_of, key, node):
    """The way down the tree, one row at a time."""
    while node.shard is None:
        u = lambda c: ((hash_of(key, c.name) >> 11) + 0.5) / 2**53
        node = min((c for c in node.children if c.total > 0), key=lambda c: (-math.log(u(c)) / c.total, node.children.index(c)))
    return node.shard


def test_shards(spark, docs):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    for df, n in ((docs, 12), (many, 4000)):
        rows = sharding.assign(df, sharding.tree_of(8), sharding.tree_of(9)).collect()
        assert len(rows) == n and all(r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8 for r in rows)
        for s in range(8):
            slots = sorted(r.slot for r in rows if r.shard == s)
            assert slots == list(range(len(slots)))
    text = {r.doc_id: r.text for r in many.collect()}
    plain = {i: plain_shard(xxh64_of, str(i), sharding.tree_of(8)) for i in range(0, 4000, 7)}
    assert {r.doc_id: r.shard for r in rows if r.doc_id % 7 == 0} == plain
    same = spark.createDataFrame([(None, "x")] * 300 + [(4, "y")] * 200, "doc_id long, text string")
    slots = {}
    for r in sharding.assign(same, sharding.tree_of(8)).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == 500
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    shares = Counter(r.shard for r in rows)
    assert all(abs(shares[s] - 500) < 100 for s in range(8)) and 330 < sum(r.grown_shard == 8 for r in rows) < 560
    assert sharding.assign(nothing(docs), sharding.tree_of(8)).count() == 0


def test_weight_changes_stay_in_their_subtree(spark):
    ids = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    before, after = sharding.tree_of(8), sharding.tree_of(8, weights={0: 2.0})
    rows = ids.select(sharding.descend(F.col("k"), before).alias("a"), sharding.descend(F.col("k"), after).alias("b")).collect()
    assert any(r.a != r.b for r in rows) and all(r.b < 4 for r in rows if r.a != r.b)
    assert Counter(r.b for r in rows)[0] > 1.5 * Counter(r.b for r in rows)[4]
    with pytest.raises(ValueError):
        sharding.tree_of(0)


def test_pieces_like_the_library():
    model = sentencepiece_bpe.load_model(queries.piece_model())
    cache = sentencepiece_bpe.SegmentCache(model)
    texts = ["", " ", "  two", "a▁b", "\x00", "tab\there\n\nx", "😀 é ﬁ नमस्ते", "_x² _²a", "<s> <0x41>", "w" * 700, "▁" * 90, "1st 22,333.44 [[_{x}_2]]."]
    for text, (n, ids, decoded, failed) in zip(texts, cache.encode_batch(texts)):
        assert failed == 0
        theirs = model.library.encode(text)
        assert ids == ",".join(map(str, theirs)) and n == len(theirs) and decoded == model.library.decode(theirs)
        assert model.encode(text) == theirs and model.decode(theirs) == decoded


def test_encoded_documents(docs):
    model = sentencepiece_bpe.load_model(queries.piece_model())
    rows = sentencepiece_bpe.encode_documents(docs, queries.piece_model(), with_ids=True).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        ids = model.library.encode(text[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()
    assert sentencepiece_bpe.encode_documents(nothing(docs), queries.piece_model()).count() == 0


def test_a_worker_holds_little():
    model = sentencepiece_bpe.load_model(queries.piece_model())
    assert all(s.isascii() for s in model.segments("a plain▁text,  with 2 spaces"))
    assert max(sum(map(len, g)) for g in sentencepiece_bpe.grouped(["x" * 1000] * 3000)) <= 300_000
    cache = sentencepiece_bpe.SegmentCache(model)
    for i in range(0, 400_000, 20_000):
        cache.encode_batch([" ".join(f"{j:x}z" for j in range(i, i + 20_000))])
    assert len(cache.young) + len(cache.old) <= 350_000


def test_a_wrong_merge_is_noticed():
    model = sentencepiece_bpe.BpeModel(queries.piece_model())
    model.ranks.pop("▁the")
    ((n, ids, text, failed),) = sentencepiece_bpe.SegmentCache(model).encode_batch(["the end"])
    assert failed and ids == ",".join(map(str, model.library.encode("the end"))) and text == "the end" and n == ids.count(",") + 1


def test_a_wrong_cut_is_noticed():
    model = sentencepiece_bpe.BpeModel(queries.piece_model())
    model.segments = lambda text: list(("▁" + text.replace(" ", "▁")))  # every character by itself
    found = sentencepiece_bpe.SegmentCache(model).encode_batch(["the end"])[0]
    assert found[3] and found[1] == ",".join(map(str, model.library.encode("the end"))) and found[2] == "the end"


def test_the_agenda_alone_equals_the_library_on_whole_documents(spark):
    """What op4 returns, held against the library over a whole table."""
    folder = "/root/testdata/sf0.01"
    library = sentencepiece_bpe.load_model(queries.piece_model()).library
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op4_sentencepiece(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.failed_checks) == (len(ids), 0) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


#: Names that the operators use for columns of their own.
INNER_NAMES = "row digest digest_ pair pair_ pair_id pair_id_ touched touched_ likely likely_ known known_ known_id maybe filter_row filter_bits filter_row_ filter_bits_ row_ n keep_id kept rows limit copy hash_rank size below __rank __copy __source id keys root component_id first".split()


def test_callers_columns_keep_their_names_and_values(spark):
    long = " ".join(f"word{i}" for i in range(60))
    texts = ["same", "same", "other words here", None, "", long, long + " more", "solo text"]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    df = df.withColumns({name: F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")) for name in INNER_NAMES})
    whole = {r.doc_id: r.asDict() for r in df.collect()}
    for stage, stay in ((exact_dedup.drop_exact_copies, {1, 2, 4, 5, 6, 7}), (simhash.one_of_each_similar, {0, 2, 3, 5, 7}), (mixing.mixed_documents, None)):
        found = stage(df)
        assert found.columns == df.columns
        rows = found.collect()
        assert all(r.asDict() == whole[r.doc_id] for r in rows)
        assert stay is None or {r.doc_id for r in rows} == stay and len(rows) == len(stay)


def targets_by_rounds(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] >= most * sizes[s]}
        for s in full or free:
            target[s] = most * sizes[s] if full else unit * weight[s]
            left -= target[s]
        free -= full or free
    return target


def test_mix(spark, docs):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), f"src{int(i ** 0.5) % 7}" if i % 29 else None) for i in range(900)]
    for df in (docs, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(1))):
        source = {r.doc_id: r.source for r in df.collect()}
        sizes = Counter()
        for r in df.collect():
            sizes[r.source] += len((r.text or "").split())
        got = mixing.mix(df).collect()
        wanted = targets_by_rounds(sizes)
        assert len(got) == df.count()
        largest = max(r.size for r in got)
        for s in wanted:
            mine = [r for r in got if source[r.doc_id] == s or (r.doc_id is None and s == "s1")]
            assert all(r.target == pytest.approx(wanted[s]) and 0 <= r.taken <= 3 * r.size for r in mine)
        if df is not docs:
            for s in wanted:
                assert abs(sum(r.taken for r in got if source[r.doc_id] == s) - wanted[s]) <= largest
            mixed = mixing.mixed_documents(df)
            assert mixed.columns == df.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mix(nothing(docs)).count() == 0 and mixing.mixed_documents(nothing(docs)).count() == 0
    assert math.isclose(sum(targets_by_rounds({"a": 1, "b": 100}).values()), 101)
