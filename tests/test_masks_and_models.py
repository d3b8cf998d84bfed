import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolith.operators import conformal, evaluation as E, masks as M, metrics, neighbours, prediction as P


def flood(mask, steps):
    h, w = mask.shape
    seen, sizes, touching = np.zeros_like(mask, bool), [], []
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not seen[y, x]:
                stack, n, edge = [(y, x)], 0, False
                seen[y, x] = True
                while stack:
                    a, b = stack.pop()
                    n, edge = n + 1, edge or a in (0, h - 1) or b in (0, w - 1)
                    for dy, dx in steps:
                        c, d = a + dy, b + dx
                        if 0 <= c < h and 0 <= d < w and mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            stack.append((c, d))
                sizes.append(n)
                touching.append(edge)
    return sizes, touching


def test_regions_against_flood_fill():
    rng = np.random.default_rng(5)
    for _ in range(200):
        mask = rng.integers(0, 3, (rng.integers(1, 12), rng.integers(1, 12)))
        sizes, _ = flood(mask == 1, M.FOUR)
        assert M.region_stats(mask, 1) == (len(sizes), sum(sizes) / len(sizes) if sizes else 0.0, max(sizes, default=0))
        background, _ = flood(mask != 1, M.FOUR)
        inner, touching = flood(mask == 1, M.EIGHT)
        assert M.homology(mask, 1) == (max(0, len(background) - 1), len(inner) - sum(touching))


def test_fractions_and_features(spark):
    px = [0] * 40 + [1] * 50 + [3] * 10
    df = spark.createDataFrame([("r", 10, 10, px)], "record_id string, h int, w int, px array<int>")
    assert df.select(M.class_fractions(F.col("px"), 4).alias("f")).first().f == [0.4, 0.5, 0.0, 0.1]
    features = M.feature_vector(df, ["a", "b", "c", "d"]).first().features
    assert features["frac:b"] == 0.5 and features["n_regions:d"] == 1.0 and features["max_region_area:a"] == 40.0 and len(features) == 16


def test_group_means(spark):
    rows = [("r1", "A", None, 0.2, 0), ("r2", "A", "x", 0.4, 1), ("r3", "B", "y", 0.9, 2), ("r4", None, "z", 1.0, 3), ("r5", "B", "q", float("nan"), 4)]
    df = spark.createDataFrame(rows, "record_id string, g string, family string, v double, o int")
    got = {r.g: (r.family, round(r.v, 6)) for r in M.group_means(df, "g", ["v"], ["family"], "o").collect()}
    assert got == {"A": ("x", 0.3), "B": ("y", 0.9)}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (7, 0)], "t int, p int")
    ious = {r.cls: r.iou for r in metrics.class_iou(metrics.confusion(df, "t", "p", 4), 4).collect()}
    assert ious == {0: 0.5, 1: 1 / 3, 2: 0.0, 3: None}
    assert df.filter("t > 90").agg(metrics.accuracy(F.col("t"), F.col("p")).alias("a")).first().a == 0.0
    rng = random.Random(2)
    rows = [("m", float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(60)]
    got = metrics.regression_metrics(spark.createDataFrame(rows, "m string, y double, p double"), ["m"]).first()
    y, p = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert got.mae == pytest.approx(np.abs(y - p).mean()) and got.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.spearman == pytest.approx(np.corrcoef(rank(y), rank(p))[0, 1])


@pytest.mark.parametrize("n, alpha", [(1, 0.1), (10, 0.1), (40, 0.1), (41, 0.25), (99, 0.5)])
def test_conformal_quantile(spark, n, alpha):
    scores = np.round(np.random.default_rng(n).random(n), 6)
    level = min(np.ceil((n + 1) * (1 - alpha)) / n, 1)
    got = conformal.calibrate(spark.createDataFrame([(float(s),) for s in scores], "score double"), "score", alpha).first()
    assert got.n == n and got.q_hat == pytest.approx(np.quantile(scores, level, method="higher"))


def test_conformal_sets(spark):
    df = spark.createDataFrame([([0.92, 0.05, 0.03],), ([1 / 3] * 3,)], "p array<double>")
    got = [r.s for r in df.select(conformal.prediction_set(F.col("p"), F.lit(0.1)).alias("s")).collect()]
    assert got == [[0], []]
    with pytest.raises(ValueError):
        conformal.calibrate(df, "p", 1.0)


def test_leave_one_out_ridge(spark):
    rng = np.random.default_rng(0)
    x = rng.random((8, 2))
    y = 100 + 400 * x[:, 0]
    df = spark.createDataFrame([("g", i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "g string, k int, a double, b double, y double")
    got = {r.k: r.p for r in E.leave_one_out_ridge(df, "g", "k", ["a", "b"], "y").collect()}
    for i in range(8):
        keep = np.arange(8) != i
        z = (x - x[keep].mean(0)) / x[keep].std(0)
        design = np.hstack([np.ones((7, 1)), z[keep]])
        w = np.linalg.solve(design.T @ design + np.diag([0.0, 1.0, 1.0]), design.T @ y[keep])
        assert got[i] == pytest.approx(w[0] + z[i] @ w[1:])


def test_leave_block_out(spark):
    rows = [(1, "a", "x", 1.0), (2, "a", "y", 2.0), (3, "b", "x", 10.0), (4, "c", "z", 4.0)]
    df = spark.createDataFrame(rows, "k int, block string, grade string, y double")
    assert {r.k: r.p for r in E.leave_block_out_mean(df, "block", "y").collect()} == {1: 7.0, 2: 7.0, 3: 7 / 3, 4: 13 / 3}
    assert {r.k: r.p for r in E.leave_block_out_grade_mean(df, "block", "grade", "y").collect()} == {1: 10.0, 2: 7.0, 3: 1.0, 4: 13 / 3}


def test_neighbours_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_NUMBERS", 200)
    v = np.random.default_rng(3).normal(size=(50, 5))
    df = spark.createDataFrame([(i, i % 4, r.tolist()) for i, r in enumerate(v)], "k long, b int, v array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    s = unit @ unit.T
    s[np.equal.outer(np.arange(50) % 4, np.arange(50) % 4)] = -9
    assert {r.k: r.neighbour for r in neighbours.nearest_neighbour(df, "k", "b", "v").collect()} == dict(enumerate(s.argmax(1)))


def test_pca_ridge_folds_match_direct_fits(spark):
    rng = np.random.default_rng(8)
    v, b = rng.normal(size=(40, 6)), np.arange(40) % 4
    y = v @ rng.normal(size=6) + rng.normal(size=40)
    df = spark.createDataFrame([(i, int(b[i]), v[i].tolist(), float(y[i])) for i in range(40)], "k long, b int, v array<double>, y double")
    got = {r.k: r.p for r in E.pca_ridge_folds(df, "k", "b", "v", "y", parts=3).collect()}
    for block in range(4):
        x, t = v[b != block], y[b != block]
        c = x - x.mean(0)
        _, _, vt = np.linalg.svd(c, full_matrices=False)
        z, scale = c @ vt[:3].T, (c @ vt[:3].T).std(0)
        w = np.linalg.solve((z / scale).T @ (z / scale) + 10 * np.eye(3), (z / scale).T @ (t - t.mean()))
        for i in np.flatnonzero(b == block):
            assert got[i] == pytest.approx(((v[i] - x.mean(0)) @ vt[:3].T / scale) @ w + t.mean())


def test_head_registry():
    r = P.HeadRegistry()
    r.register("ferrous", "hv", int)
    r.register("ferrous/uhcs", "hv", float)
    assert r.find("ferrous/uhcs", "hv") is float and r.find("ferrous/other", "hv") is int and r.find("aluminum", "hv") is None
    assert r.for_family("ferrous") == [("ferrous", "hv"), ("ferrous/uhcs", "hv")]
    with pytest.raises(TypeError):
        r.register("x", "y", 3)
