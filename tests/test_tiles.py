"""Tiled images against whole ones, and components against a plain union-find."""

import random

import numpy as np
import pytest

from ferrolith.operators import masks as M
from ferrolith.operators import tiles as T
from ferrolith.operators.components import components

CLASSES = 3


def spiral(n: int) -> np.ndarray:
    """One path that winds through the whole image: its pieces meet over many seams."""
    grid, y, x, dy, dx = np.zeros((n, n), int), 0, 0, 0, 1
    grid[0, 0] = 1
    free = lambda a, b: 0 <= a < n and 0 <= b < n
    while True:
        for _ in range(2):
            a, b = y + dy, x + dx
            if free(a, b) and not grid[a, b] and not (free(a + dy, b + dx) and grid[a + dy, b + dx]):
                break
            dy, dx = dx, -dy
        else:
            return grid
        y, x = y + dy, x + dx
        grid[y, x] = 1


def images():
    rng = np.random.default_rng(3)
    board = np.indices((9, 9)).sum(0) % 2  # diagonal neighbours alone
    rings = np.maximum(abs(np.arange(13) - 6)[:, None], abs(np.arange(13) - 6)[None, :]) % 2
    found = [rng.integers(0, 4, (rng.integers(1, 14), rng.integers(1, 14))) for _ in range(8)] + [rng.integers(0, 2, (20, 17)), board, rings, spiral(15), np.ones((7, 12), int), np.zeros((1, 1), int)]
    return found


def table(spark, grids):
    return spark.createDataFrame([(i if i else None, *g.shape, g.ravel().tolist()) for i, g in enumerate(grids)], "record_id bigint, h int, w int, px array<int>")


def plain(rows):
    return sorted((-1 if r.record_id is None else r.record_id, r.cls, r.n_regions, round(r.mean_area, 9), r.max_area, r.h0, r.h1) for r in rows)


@pytest.mark.parametrize("side", [3, 50])
def test_tiles_equal_whole_images(spark, side):
    whole = table(spark, images())
    got = T.tiled_mask_table(T.cut_tiles(whole, side), CLASSES)
    assert plain(got.collect()) == plain(M.mask_table(whole, CLASSES).collect())


def test_uneven_tiles_text_ids_and_none(spark):
    grid = spiral(11)
    cuts = [(0, 0, 11, 3), (0, 3, 5, 8), (5, 3, 6, 2), (5, 5, 6, 6)]
    rows = [("a", 11, 11, t, l, h, w, grid[t : t + h, l : l + w].ravel().tolist()) for t, l, h, w in cuts]
    kinds = "record_id string, height int, width int, top int, left int, h int, w int, px array<int>"
    got = [r for r in T.tiled_mask_table(spark.createDataFrame(rows, kinds), 2).orderBy("cls").collect()]
    assert [(r.n_regions, r.mean_area, r.max_area) for r in got] == [M.region_stats(grid, k) for k in (0, 1)]
    assert [(r.h0, r.h1) for r in got] == [M.homology(grid, k) for k in (0, 1)]
    assert T.tiled_mask_table(spark.createDataFrame([], kinds), 2).count() == 0
    empty = T.tiled_mask_table(spark.createDataFrame([("e", 0, 0, 0, 0, 0, 0, [])], kinds), 2).collect()
    assert [(r.n_regions, r.mean_area, r.max_area, r.h0, r.h1) for r in empty] == [(0, 0.0, 0, 0, 0)] * 2


def test_components(spark):
    rng, root = random.Random(1), {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1030)] + [(7, 7), (5, None)]
    for a, b in links:
        if b is not None and a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: top(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0
