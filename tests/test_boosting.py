import numpy as np
import pytest

from ferrolith.operators import boosting, evaluation, heads


def data(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, 3)), 2)
    return x, np.where(x[:, 0] > 0.5, 10.0, 0.0) + 3 * x[:, 1] ** 2 + rng.normal(size=n)


def frame(spark, x, y, folds=None):
    rows = [(i, f"f{i if folds is None else folds[i]}", *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k long, fold string, a double, b double, c double, y double").repartition(3)


@pytest.fixture()
def few_trees(monkeypatch):
    monkeypatch.setattr(heads, "TREES", 5)
    monkeypatch.setattr(boosting, "REFRESH", 2)


def test_a_distributed_forest_equals_the_plain_one(spark, few_trees):
    x, y = data(60, 1)
    plain, ours = heads.fit_trees(x, y), boosting.fit(frame(spark, x, y), ["a", "b", "c"], "y", 5, heads.SHRINKAGE, heads.DEPTH)
    grid = np.random.default_rng(2).random((500, 3))
    assert np.allclose(heads.tree_values(plain, grid), heads.tree_values(ours, grid), atol=1e-9) and len(ours["trees"]) == 5


@pytest.mark.parametrize("cells", [2**21, 4 * 3 * 25 * 2])  # all folds in one wave, and two at a time
def test_left_out_folds_equal_plain_fits(spark, few_trees, monkeypatch, cells):
    monkeypatch.setattr(boosting, "CELLS", cells)
    x, y = data(25, 3)
    folds = [i % 4 for i in range(25)]
    got = {r.k: (r.y, r.p) for r in boosting.leave_folds_out(frame(spark, x, y, folds), "k", "fold", ["a", "b", "c"], "y", 5, heads.SHRINKAGE, heads.DEPTH).collect()}
    assert len(got) == 25
    for i in range(25):
        keep = np.array([f != folds[i] for f in folds])
        assert got[i] == (pytest.approx(y[i]), pytest.approx(heads.tree_values(heads.fit_trees(x[keep], y[keep]), x[i : i + 1])[0], abs=1e-9))


def test_heads_have_no_row_cap(spark, monkeypatch):
    monkeypatch.setattr(heads, "TREES", 2)
    monkeypatch.setattr(heads, "MOST_TREE_ROWS", 5)
    x, y = data(12, 5)
    head = heads.fit_head(frame(spark, x, y), "k", ["a", "b", "c"], "y")
    rest = [np.arange(12) != i for i in range(12)]
    plain = [heads.tree_values(heads.fit_trees(x[k], y[k]), x[~k])[0] for k in rest]
    assert head["n"] == 12 and head["scores"]["trees"]["mae"] == pytest.approx(np.abs(plain - y).mean())
    mean, scale, w, b = evaluation.ridge(x, y, heads.RIDGE)
    assert head["kind"] == "linear" and np.allclose(head["weights"], w) and head["intercept"] == pytest.approx(b)


def test_quantile_bins_keep_order_and_bounds(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 3))
    state = frame(spark, x, x[:, 0]).selectExpr("array(a, b, c) AS x")
    for own, values in zip(boosting.make_bins(state, 3, most=16), x.T):
        assert 8 <= len(own.largest) <= 17 and (own.least[1:] > own.largest[:-1]).all() and own.least[0] == values.min() and own.largest[-1] == values.max()
        sizes = np.bincount(own.of(values))
        assert sizes.sum() == 3000 and sizes.max() < 3000 / 4
    x, y = np.repeat(x[:, :1], 3, axis=1), np.where(x[:, 0] > 0.3, 5.0, -5.0)
    rough = boosting.fit(frame(spark, x, y), ["a", "b", "c"], "y", 1, 1.0, 2)
    assert np.abs(heads.tree_values(rough, x) - y).mean() < 0.5


def test_ridge_from_moments(spark):
    x, y = data(40, 9)
    x[:, 2] = 4.0  # a feature without spread
    for ours, plain in zip(evaluation.fit_ridge(frame(spark, x, y), ["a", "b", "c"], "y", 1.0), evaluation.ridge(x, y, 1.0)):
        assert np.allclose(ours, plain)


def test_folds_without_others_and_no_rows(spark, few_trees):
    x, y = data(4, 11)
    assert boosting.leave_folds_out(frame(spark, x, y, [0] * 4), "k", "fold", ["a", "b", "c"], "y", 2, 0.1, 3).count() == 0
    assert boosting.leave_folds_out(frame(spark, x, y).limit(0), "k", "fold", ["a", "b", "c"], "y", 2, 0.1, 3).count() == 0
    with pytest.raises(ValueError):
        boosting.fit(frame(spark, x, y).limit(0), ["a", "b", "c"], "y", 2, 0.1, 3)
