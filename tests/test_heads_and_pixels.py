"""Heads, training, ranks, record checks, pixel layouts, model table, configuration: against plain versions."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolith import cli, sinks
from ferrolith.operators import evaluation as E
from ferrolith.operators import heads, masks, metrics, ranking, records, training
from ferrolith.operators.prediction import HeadRegistry
from ferrolith.sources import tables
from ferrolith.sources.registry import Config


def one(df):
    return df.first()[0]


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MOST_VALUES", 5)
    monkeypatch.setattr(ranking, "RANGES", 4)
    rnd = random.Random(1)
    values = [rnd.choice([0.0, 1.5, -2.0, 1e9, rnd.random(), rnd.gauss(0, 1e-9)]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").cache()
    for place in (0, 1, 57, 200, 398, 399):
        assert ranking.order_statistic(df, "v", place) == sorted(values)[place]
    with pytest.raises(IndexError):
        ranking.order_statistic(df, "v", 400)


def plain_ranks(v):
    s = sorted(v)
    return [s.index(x) + (s.count(x) + 1) / 2 for x in v]


def test_ranks_and_spearman(spark):
    rnd = random.Random(2)
    rows = [(g, float(rnd.randint(0, 9)), rnd.choice([0.0, rnd.random()])) for g in ("a", "b") for _ in range(120)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    for g in ("a", "b"):
        own = [(y, p) for h, y, p in rows if h == g]
        ry, rp = plain_ranks([y for y, _ in own]), plain_ranks([p for _, p in own])
        got = {r.y: r.r for r in ranking.average_ranks(df, ["g"], "y", "r", parts=4).filter(F.col("g") == g).collect()}
        assert got == dict(zip([y for y, _ in own], ry))
        found = metrics.regression_metrics(df, ["g"]).filter(F.col("g") == g).first()
        assert found.spearman == pytest.approx(np.corrcoef(ry, rp)[0, 1]) and found.n == 120
        y, p = np.array(own).T
        assert found.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "g string, y double, p double")
    assert metrics.regression_metrics(flat, ["g"]).select("r2", "spearman").first() == (None, None)


def test_head_middle_tail_of_few_and_none(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(4)], "k long, v double")
    got = [(r.part, r.place, r.k) for r in ranking.head_middle_tail(df, "v", "k").collect()]
    assert sorted(got) == sorted([("head", 0, 0), ("head", 1, 3), ("middle", 0, 1), ("tail", 0, 3), ("tail", 1, 1), ("tail", 2, 2)])
    assert ranking.head_middle_tail(df.filter("false"), "v", "k").count() == 0


def test_trees_fit_and_choose(spark):
    rng = np.random.default_rng(4)
    x = rng.random((40, 2))
    step = np.where(x[:, 0] > 0.5, 10.0, 0.0) + np.where(x[:, 1] > 0.3, 3.0, 0.0)
    gain, j, threshold = heads.split_at(x, step - step.mean())
    errors = {(k, t): sum(((part - part.mean()) ** 2).sum() for part in (step[x[:, k] <= t], step[x[:, k] > t])) for k in (0, 1) for t in x[:, k] if (x[:, k] > t).any()}
    assert sum(((part - part.mean()) ** 2).sum() for part in (step[x[:, j] <= threshold], step[x[:, j] > threshold])) == pytest.approx(min(errors.values())) and gain > 0
    fitted = heads.fit_trees(x, step)
    assert np.abs(heads.tree_values(fitted, x) - step).max() < 0.1
    make = lambda y: spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "group_id long, a double, b double, y double")
    table = make(step)
    head = heads.fit_head(table, "group_id", ["a", "b"], "y")
    assert head["kind"] == "trees" and head["scores"]["trees"]["mae"] < head["scores"]["linear"]["mae"]
    left_out = {r.group_id: r.p for r in heads.leave_one_out_trees(table, "group_id", ["a", "b"], "y").collect()}
    assert left_out[7] == pytest.approx(heads.tree_values(heads.fit_trees(np.delete(x, 7, 0), np.delete(step, 7)), x[7:8])[0])
    linear = heads.fit_head(make(3 * x[:, 0] - x[:, 1]), "group_id", ["a", "b"], "y")
    assert linear["kind"] == "linear"
    for h in (head, linear):
        at = spark.createDataFrame([({"a": 0.9},)], "f map<string,double>")
        mean, scale = (np.array(linear[k]) for k in ("mean", "scale"))
        wanted = heads.tree_values(h, np.array([[0.9, 0.0]]))[0] if h["kind"] == "trees" else ((np.array([0.9, 0.0]) - mean) / scale) @ np.array(linear["weights"]) + linear["intercept"]
        assert one(at.select(heads.head_value(h, F.col("f")))) == pytest.approx(wanted)  # a missing feature counts as 0
    with pytest.raises(ValueError):
        heads.fit_head(table.limit(2), "group_id", ["a", "b"], "y")


def test_property_heads(spark, tmp_path, capsys):
    registry = HeadRegistry()
    registry.register("ferrous/uhcs", "hv", dict)
    features = spark.createDataFrame([(f"g{i}", "ferrous", "uhcs" if i < 9 else "other", float(i), float(i * i % 7)) for i in range(12)], "group_id string, family string, adapter string, a double, b double")
    rows = [(f"g{i}", 0, j, {"hv": 100.0 + 5 * i + j} if j else {}) for i in range(8) for j in range(3)]
    recs = spark.createDataFrame(rows, "group_id string, adapter_ord int, record_ord long, properties map<string,double>")
    root = str(tmp_path)
    with pytest.raises(KeyError):
        heads.fit_property_head(registry, root, "ferrous/uhcs", "other", features, recs)
    with pytest.raises(FileNotFoundError):
        heads.fit_property_head(registry, root, "ferrous/uhcs", "hv", None, recs)
    assert heads.fit_property_head(registry, root, "ferrous/uhcs", "hv", features, recs.filter("group_id = 'g1'")) is None
    assert heads.fit_property_head(registry, root, "ferrous/uhcs", "hv", features, recs.filter("false")) is None
    head = heads.fit_property_head(registry, root, "ferrous/uhcs", "hv", features, recs)
    assert head["n"] == 8 and head["features"] == ["a", "b"]
    images = spark.createDataFrame([("r", {"a": 3.0, "b": 2.0})], "record_id string, features map<string,double>")
    assert heads.predict_property(root, "ferrous/uhcs", "hv", images).first().value == pytest.approx(116, abs=12)
    assert heads.predict_property(root, "ferrous", "hv", images).first().reason.startswith("no fitted head")


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(3, 6)) * 4
    rows = [(i, (middles[i % 3] + rng.normal(size=6) * 0.3).tolist(), f"f{i % 3}", i % 20) for i in range(300)]
    return spark.createDataFrame(rows, "k long, embedding array<double>, family string, group_id int")


def test_router_and_classifier(spark, clusters):
    router = training.train_router(clusters, "embedding", "family", "group_id")
    assert router["families"] == ["f0", "f1", "f2"] and router["accuracy"] == 1.0 and 0 <= router["q_hat"] < 0.5
    truth = {r.k: r.family for r in clusters.collect()}
    routed = {r.k: r.family for r in training.route(clusters.drop("family"), router, "embedding").collect()}
    assert sum(routed[k] == truth[k] for k in truth) >= 0.85 * len(truth) and all(f in (None, truth[k]) for k, f in routed.items())
    with pytest.raises(ValueError):
        training.train_router(clusters, "embedding", "family", "group_id", calibration_share=0.0)
    lone = training.train_router(clusters.filter("family = 'f1'"), "embedding", "family", "group_id")
    assert lone["families"] == ["f1"] and lone["accuracy"] == 1.0
    labelled = clusters.withColumn("labels", F.when(F.col("family") != "f2", F.array(F.lit("z"), "family")).otherwise(F.array().cast("array<string>")))
    head = training.train_classifier(labelled, "embedding", "labels", "group_id")
    assert head["classes"] == [["f0", "z"], ["f1", "z"]] and head["accuracy"] == 1.0 and head["penalty"] == training.PENALTIES[0]
    got = {r.k: r.predicted for r in training.classify(labelled, head, "embedding").collect()}
    assert all(got[k] == [f, "z"] for k, f in truth.items() if f != "f2")


def test_segmenting_by_a_model(spark):
    def make_predict():
        return lambda pixels: np.stack([255 - pixels[..., 0], pixels[..., 0]], 1)

    px = [0, 0, 0, 255, 0, 0] * 2
    images = spark.createDataFrame([("r", 2, 2, px)], "record_id string, h int, w int, data array<int>")
    assert training.segment(images, make_predict).first().px == [0, 1, 0, 1]


def test_plane_of_largest_variance(spark, clusters):
    x = np.array([r.embedding for r in clusters.orderBy("k").collect()])
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    got = np.array([[r.pc1, r.pc2] for r in E.principal_plane(clusters, "k", "embedding").orderBy("k").collect()])
    for i in range(2):
        d = vt[i] * np.sign(vt[i][np.abs(vt[i]).argmax()])
        assert np.allclose(got[:, i], c @ d)


def test_stacks_of_masks_and_shapes(spark):
    rng = np.random.default_rng(9)
    grids = [rng.integers(0, 3, s) for s in ((5, 7), (5, 7), (4, 4), (1, 9))]
    df = spark.createDataFrame([(i, *g.shape, g.ravel().tolist()) for i, g in enumerate(grids)], "record_id int, h int, w int, px array<int>")
    got = {(r.record_id, r.cls): (r.n_regions, round(r.mean_area, 9), r.max_area, r.h0, r.h1) for r in masks.mask_table(df, 3).collect()}
    for i, g in enumerate(grids):
        for cls in range(3):
            n, mean, most = masks.region_stats(g, cls)
            assert got[i, cls] == (n, round(mean, 9), most, *masks.homology(g, cls))
    ring = np.array([[0, 0, 0, 0, 0], [0, 1, 1, 1, 0], [0, 1, 0, 1, 0], [0, 1, 1, 1, 0], [0, 0, 0, 0, 0]])
    assert masks.homology(ring, 1) == (1, 1) and masks.region_stats(ring, 0) == (2, 8.5, 16)
    bars = masks.persistence(masks.mask_table(spark.createDataFrame([(1, 5, 5, ring.ravel().tolist())], "record_id int, h int, w int, px array<int>"), 2)).filter("cls = 1").first()
    assert (bars.h0_total_persistence, bars.h0_max_persistence, bars.h1_count) == (1.0, 1.0, 1.0)


def test_pixel_layouts(spark):
    g = np.arange(20).reshape(4, 5)
    df = spark.createDataFrame([(g.ravel().tolist(), list(range(4 * 5 * 3)))], "px array<int>, rgb array<int>")
    h, w = F.lit(4), F.lit(5)
    r = df.select(
        masks.flip_columns(F.col("px"), h, w).alias("lr"), masks.flip_rows(F.col("px"), h, w).alias("ud"), masks.quarter_turn(F.col("px"), h, w).alias("turn"), masks.channels_first(F.col("rgb"), h, w).alias("planes"),
        masks.pad_centred(F.col("px").cast("array<double>"), h, w, 6).alias("pad"), masks.crop_centred(F.col("px"), h, w, F.lit(2), F.lit(2)).alias("crop"), masks.without_banner(F.col("px"), h, w, 1, 4).alias("bare"), masks.without_banner(F.col("px"), h, w, 1, 5).alias("whole"),
    ).first()
    assert r.lr == g[:, ::-1].ravel().tolist() and r.ud == g[::-1].ravel().tolist() and r.turn == np.rot90(g).ravel().tolist()
    assert np.allclose(r.planes, np.arange(60).reshape(4, 5, 3).transpose(2, 0, 1).ravel() / 255)
    padded = np.zeros((6, 6))
    padded[1:5, 0:5] = g
    assert r.pad == padded.ravel().tolist() and r.crop == g[1:3, 1:3].ravel().tolist() and r.bare == list(range(15)) and r.whole == list(range(20))
    with pytest.raises(Exception, match="smaller"):
        df.select(masks.crop_centred(F.col("px"), h, w, F.lit(9), F.lit(2))).collect()
    square = spark.range(40).select("id", F.lit(list(range(9))).alias("px"))
    turned = {tuple(r.p) for r in square.select(masks.augmented(F.col("px"), F.lit(3), F.lit(3), F.col("id"), 1).alias("p")).collect()}
    assert len(turned) > 8 and turned == {tuple(r.p) for r in square.select(masks.augmented(F.col("px"), F.lit(3), F.lit(3), F.col("id"), 1).alias("p")).collect()}


def test_record_checks(spark):
    schema = "record_id string, image_path string, family string, mask_path string, mask_class_nodes array<string>, taxonomy_labels array<string>"
    rows = [("1", "/a", "x", "/m", ["n"], ["q", "p"]), ("2", "/b", "x", None, None, []), ("3", "/c", "y", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    listing = spark.createDataFrame([("/a",), ("/a",), ("/c",)], "path string")
    assert records.mask_nodes(df) == ["n"] and [r.record_id for r in records.with_labels(df, listing).collect()] == ["1"]
    assert tuple(records.run_counters(df, "x", listing).first()) == (1, 1, 1) and tuple(records.run_counters(df.filter("false"), "x", listing).first()) == (0, 0, 0)
    with pytest.raises(FileNotFoundError):
        records.mask_nodes(df.filter("mask_path IS NULL"))
    with pytest.raises(ValueError):
        records.mask_nodes(df.unionByName(spark.createDataFrame([("4", "/d", "x", "/n", ["o"], None)], schema)))
    a, b = (spark.createDataFrame([(i,) for i in x], "k int") for x in ([3, 1, 1], [1, 2]))
    assert [r.k for r in records.intersection_or_first(a, b).collect()] == [1]
    assert sorted(r.k for r in records.intersection_or_first(a, b.filter("k = 2")).collect()) == [1, 3]
    runs = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.9), ("r", 3, 0.9), ("r", 4, float("nan"))], "run string, epoch int, metric double")
    assert tuple(records.best_epochs(runs, "run", "epoch", "metric").first()) == ("r", 2, 0.9)


def test_model_table_and_cache(spark, tmp_path):
    root = str(tmp_path / "models")
    assert sinks.load_model(spark, root, "router") is None
    assert [sinks.save_model(spark, root, "router", {"w": i}, m) for i, m in enumerate((0.5, 0.9, 0.9))] == [1, 2, 3]
    assert sinks.save_model(spark, root, "clf", {"w": 9}, 1.0) == 1
    assert sinks.load_model(spark, root, "router") == {"w": 1} and sinks.load_model(spark, root, "router", 3) == {"w": 2}
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    keys = [sinks.fingerprint(d, [F.col("k"), F.col("v")]) for d in (df, df.repartition(3), df.distinct(), df.filter("false"))]
    assert keys[0] == keys[1] and len(set(keys)) == 3
    calls = []
    for _ in range(2):
        assert sinks.cached(spark, root + "-cache", keys[0], lambda: calls.append(1) or df).count() == 3
    assert calls == [1]


def test_configuration(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('data_dir = "d"\nadapters = ["a", "b"]\nrouter_alpha = 0.2\n')
    c = Config.load(f)
    assert str(c.place("features")) == "d/features.csv" and c.adapters == ("a", "b") and c.router_alpha == 0.2 and c.seed == 42
    assert Config.load().place("heads").parts == ("checkpoints", "heads")
    for bad in ("colour = 1", 'min_confidence = "mine"'):
        f.write_text(bad)
        with pytest.raises(ValueError):
            Config.load(f)


def test_rows_of_several_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("a,b\n" + "".join(f"{i},{j}\n" for j in range(4)))
    got = sorted((r.a, r.b, r.row) for r in tables.read_strings(spark, str(tmp_path), ["a", "b"]).collect())
    assert got == [(str(i), str(j), j + 2) for i in range(3) for j in range(4)]


def write_png(path, px):
    """A PNG of (h, w, channels) bytes, grey or RGB."""
    h, w, channels = px.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + px[y].astype(np.uint8).tobytes() for y in range(h))
    header = struct.pack(">IIBBBBB", w, h, 8, 2 if channels == 3 else 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def test_paths_and_mask_images(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write_png(tmp_path / "sub" / "m.png", np.dstack([np.array([[0, 1], [2, 3]]), np.full((2, 2), 9), np.full((2, 2), 7)]))
    write_png(tmp_path / "g.png", np.array([[5, 6]])[..., None])
    got = {r.origin.rsplit("/", 1)[-1]: (r.h, r.w, r.px) for p in ("sub/m.png", "g.png") for r in tables.mask_pixels(spark, str(tmp_path / p)).collect()}
    assert got == {"m.png": (2, 2, [0, 1, 2, 3]), "g.png": (1, 2, [5, 6])}
    rows = spark.createDataFrame([("sub/m.png",), ("elsewhere/g.png",), ("none.png",)], "raw string")
    found = {r.raw: r.found for r in tables.attach_paths(rows, tables.list_images(spark, str(tmp_path)), "raw", str(tmp_path)).collect()}
    assert found == {"sub/m.png": f"{tmp_path}/sub/m.png", "elsewhere/g.png": f"{tmp_path}/g.png", "none.png": None}


def test_training_by_command(spark, clusters, tmp_path, capsys):
    path = lambda n: str(tmp_path / n)
    clusters.withColumn("taxonomy_labels", F.array("family")).write.parquet(path("e"))
    assert cli.main(["train-router", path("e"), path("m")]) == 0 and cli.main(["train-clf", path("e"), path("m")]) == 0
    clusters.select(F.col("k").cast("string").alias("record_id"), "embedding", F.create_map(F.lit("a"), F.lit(1.0)).alias("features")).write.parquet(path("i"))
    spark.createDataFrame([(f"g{i}", "f1", "x", float(i)) for i in range(5)], "group_id string, family string, adapter string, a double").write.parquet(path("f"))
    spark.createDataFrame([(f"g{i}", 0, 0, {"hv": 10.0 * i}) for i in range(5)], "group_id string, adapter_ord int, record_ord long, properties map<string,double>").write.parquet(path("r"))
    assert cli.main(["fit-head", path("f"), path("r"), "f1", "hv", path("h")]) == 0 and cli.main(["fit-head", path("f"), path("r"), "f2", "hv", path("h")]) == 1
    assert cli.main(["predict", path("i"), path("none"), path("h"), "hv", path("o")]) == 1
    assert cli.main(["predict", path("i"), path("m"), path("h"), "hv", path("o")]) == 0
    out = {(r.family, r.value is None, r.reason is None) for r in spark.read.parquet(path("o")).collect()}
    assert ("f1", False, True) in out and ("f0", True, False) in out
