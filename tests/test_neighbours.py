"""Neighbours by pruned tiles against all pairs."""

import numpy as np
import pytest

from ferrolith.operators import neighbours as N


def brute(x, blocks, keys):
    unit = [v / np.linalg.norm(v) if v is not None and all(c is not None and np.isfinite(c) for c in v) and np.linalg.norm(v) > 0 else None for v in (None if v is None else np.array(v, float) if None not in v else None for v in x)]
    out = {}
    for i, a in enumerate(unit):
        if a is not None:
            found = [(-round(float(a @ b), 9), keys[j]) for j, b in enumerate(unit) if b is not None and blocks[i] != blocks[j]]
            if found:
                s, j = min(found)
                out[keys[i]] = (j, -s)
    return out


def clustered(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6))
    near = centres[rng.integers(0, 12, 500)] + rng.normal(size=(500, 6)) * 0.02
    return near.tolist(), [int(b) for b in rng.integers(0, 3, 500)]


def ties():
    """A third of the rows are one vector; others lie on a grid of directions, so that most similarities are ties."""
    rng = np.random.default_rng(5)
    x = [[1.0, 2.0, 2.0]] * 150 + rng.integers(-1, 2, (250, 3)).astype(float).tolist()
    x[3], x[7], x[11], x[12] = [0.0] * 3, None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0]
    return x, [None if i % 7 == 0 else int(b) for i, b in enumerate(rng.integers(0, 4, 400))]


@pytest.mark.parametrize("x, blocks", [clustered(1), ties()], ids=["clusters", "ties"])
def test_equals_all_pairs(spark, x, blocks):
    keys = [f"k{i:04d}" for i in range(len(x))]
    counted = {}
    df = spark.createDataFrame(list(zip(keys, blocks, x)), "k string, b int, v array<double>").repartition(3)
    got = N.nearest_neighbour(df, "k", "b", "v", counted, tile_numbers=150).collect()
    want = brute(x, blocks, keys)
    assert {r.k: r.neighbour for r in got} == {k: j for k, (j, _) in want.items()} and len(got) == len(want)
    assert all(abs(r.similarity - want[r.k][1]) < 2e-9 for r in got)
    if len(x) == 500:
        assert counted["all"] == 500**2 and counted["compared"] < 0.35 * counted["all"], counted


def test_one_block_and_none(spark):
    kinds = "k bigint, b string, v array<float>"
    assert N.nearest_neighbour(spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0])], kinds), "k", "b", "v").count() == 0
    assert N.nearest_neighbour(spark.createDataFrame([], kinds), "k", "b", "v").count() == 0
    two = N.nearest_neighbour(spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, None, [0.0, 1.0])], kinds), "k", "b", "v")
    assert {(r.k, r.neighbour, r.similarity) for r in two.collect()} == {(1, 2, 0.0), (2, 1, 0.0)}


def test_a_task_holds_a_tile_as_arrow_and_small_matrices(spark):
    rows = spark.createDataFrame([(i, i % 2, [1.0, float(i)]) for i in range(40)], "k bigint, b int, v array<double>")
    found = N.nearest_neighbour(rows, "k", "b", "v")
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString() and N.MATRIX * 8 <= 8_000_000 and N.HANDED <= 5_000
    assert {r.k: r.neighbour for r in found.collect()} == {k: j for k, (j, _) in brute([[1.0, float(i)] for i in range(40)], [i % 2 for i in range(40)], list(range(40))).items()}
