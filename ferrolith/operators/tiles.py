"""Regions and homology of images that are larger than a task: tiles are labelled apart, and their regions are joined over the seams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.operators.components import grouped_components
from ferrolith.operators.masks import EIGHT, FOUR, STACK_PIXELS, label_stack
from ferrolith.session import materialize

#: Pixels of images whose tiles are passed on together.
CUT_PIXELS = 200_000
#: What is labelled: a class's 4-connected regions, its 8-connected regions, and the 4-connected parts of all else.
REGION, WIDE, BACKGROUND = 0, 1, 2


def cut_tiles(masks: DataFrame, side: int) -> DataFrame:
    """record_id, height, width, top, left, h, w, px: masks (record_id, h, w, px) in tiles of up to side x side pixels. Masks without pixels stay as one tile without."""
    kind = dict(masks.dtypes)["record_id"]

    columns = ["record_id", "height", "width", "top", "left", "h", "w", "px"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, pixels = [], 0
            for record, h, w, px in zip(batch.record_id, batch.h, batch.w, batch.px):
                grid = np.asarray(px).reshape(h, w)
                for top in range(0, max(h, 1), side):
                    for left in range(0, max(w, 1), side):
                        part = grid[top : top + side, left : left + side]
                        out.append((record, h, w, top, left, *part.shape, part.ravel()))
                pixels += grid.size
                if pixels >= CUT_PIXELS:  # small images' tiles travel together
                    yield pd.DataFrame(out, columns=columns)
                    out, pixels = [], 0
            yield pd.DataFrame(out, columns=columns)

    return masks.select("record_id", "h", "w", "px").mapInPandas(cut, f"record_id {kind}, height int, width int, top int, left int, h int, w int, px array<int>")


def stack_regions(part: pd.DataFrame, classes: int) -> Iterator[dict]:
    """Of tiles of one shape, for each kind: columns of their regions (tile, cls, node, area, border), then of their half links (tile, cls, node, low, high).

    A half link is a pair of pixels, by their places in the image, of a region's pixel and a neighbour beyond the tile.
    """
    n, h, w = len(part), int(part.h.iloc[0]), int(part.w.iloc[0])
    size = h * w
    numbers = lambda c: part[c].to_numpy(np.int64)
    top, left, height, width = numbers("top"), numbers("left"), numbers("height"), numbers("width")
    grids = np.vstack(part.px.to_list()).reshape(n, 1, h, w)
    inside = (grids == np.arange(classes)[None, :, None, None]).reshape(n * classes, h, w)
    in_tile = lambda root: (root - 1) // (size * classes)
    for kind, true, neighbours in ((REGION, inside, FOUR), (WIDE, inside, EIGHT), (BACKGROUND, ~inside, FOUR)):
        labels = label_stack(true, neighbours)

        def named(roots: np.ndarray) -> dict:
            """The tile, class and name of regions: the place in the image of the pixel that a label names."""
            tile, pixel = in_tile(roots), (roots - 1) % size
            return {"tile": tile, "kind": kind, "cls": (roots - 1) // size % classes, "node": (pixel // w + top[tile]) * width[tile] + pixel % w + left[tile]}

        roots, areas = np.unique(labels, return_counts=True)
        roots, areas = roots[roots > 0], areas[roots > 0]
        z, ys, xs = np.nonzero(labels * edge_pixels(h, w)[None])
        root, tile = labels[z, ys, xs], z // classes
        gy, gx = ys + top[tile], xs + left[tile]
        rim = (gy == 0) | (gy == height[tile] - 1) | (gx == 0) | (gx == width[tile] - 1)
        yield {**named(roots), "area": areas, "border": np.isin(roots, root[rim])}
        for dy, dx in neighbours:
            away = (ys + dy < 0) | (ys + dy >= h) | (xs + dx < 0) | (xs + dx >= w)
            away &= (gy + dy >= 0) & (gy + dy < height[tile]) & (gx + dx >= 0) & (gx + dx < width[tile])
            here, there = (gy * width[tile] + gx)[away], ((gy + dy) * width[tile] + gx + dx)[away]
            yield {**named(root[away]), "low": np.minimum(here, there), "high": np.maximum(here, there)}


def edge_pixels(h: int, w: int) -> np.ndarray:
    edge = np.zeros((h, w), bool)
    edge[[0, -1]] = edge[:, [0, -1]] = True
    return edge


def tiled_mask_table(tiles: DataFrame, classes: int) -> DataFrame:
    """record_id, cls, n_regions, mean_area, max_area, h0, h1: what masks.mask_table gives for the whole images.

    tiles: record_id, height and width of the image, top and left of the tile, its h, w and px (row by row). Tiles cover their image once;
    they may have any shapes, and rows of a tile that is there twice are errors of the caller. A null record_id is an image of its own.

    A region's name is the place of a pixel of it. Each tile passes on its regions' areas, and for pixels at its edge the pairs with
    their neighbours beyond it: pairs that both sides name are links, whose number goes with the length of the seams, not with the area.
    Regions that touch no seam meet nothing; the others are joined image by image, those of images with very many links in rounds.
    """
    key = dict(tiles.dtypes)["record_id"]
    columns = ["record_id", "kind", "cls", "node", "area", "border", "low", "high"]
    whole_numbers = ["area", "low", "high"]

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (h, w), same in batch[batch.h * batch.w > 0].groupby(["h", "w"], sort=False):
                at_once = max(1, STACK_PIXELS // (int(h) * int(w) * classes))
                for i in range(0, len(same), at_once):
                    part = same.iloc[i : i + at_once]
                    names = part.record_id.to_numpy(object)
                    out = pd.concat([pd.DataFrame(found) for found in stack_regions(part, classes)], ignore_index=True)
                    out["record_id"] = pd.Series(names[out.tile.to_numpy()], dtype=object)
                    yield out.assign(**{c: out[c].astype("Int64") for c in whole_numbers})[columns]

    chosen = tiles.select("record_id", "height", "width", "top", "left", "h", "w", "px")
    found = materialize(chosen.mapInPandas(regions, f"record_id {key}, kind int, cls int, node bigint, area bigint, border boolean, low bigint, high bigint"), "tile-regions")
    scope = ["record_id", "kind", "cls"]
    # A null record_id is an image of its own: its name isn't null.
    name = F.to_json(F.struct(*scope), {"ignoreNullFields": "false"}).alias("name")
    areas = found.filter("area IS NOT NULL").select(*scope, name, "node", "area", "border")
    halves = found.filter("area IS NULL").groupBy(*scope, "low", "high").agg(F.min("node").alias("one"), F.max("node").alias("other"), F.count("*").alias("n"))
    links = halves.filter("n = 2 AND one <> other").select(name, "one", "other")  # one region is on both sides where it surrounds a tile
    whole = areas.join(grouped_components(links), ["name", "node"], "left")
    joined = whole.groupBy(*scope, F.coalesce("root", "node").alias("root")).agg(F.sum("area").alias("area"), F.max("border").alias("border"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    measured = joined.groupBy("record_id", "cls").agg(
        F.count(of(REGION, 1)).alias("n"), F.sum(of(REGION, F.col("area"))).alias("pixels"), F.max(of(REGION, F.col("area"))).alias("largest"),
        F.count(of(BACKGROUND, 1)).alias("parts"), F.count(of(WIDE, F.when(~F.col("border"), 1))).alias("holes"),
    )
    every = tiles.select("record_id").distinct().select("record_id", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("cls"))
    m = measured.withColumnsRenamed({"record_id": "own_id", "cls": "own_cls"})
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    return every.join(m, F.col("record_id").eqNullSafe(F.col("own_id")) & (F.col("cls") == F.col("own_cls")), "left").select(
        "record_id", "cls", number("n").cast("int").alias("n_regions"), (number("pixels") / F.greatest(number("n"), F.lit(1))).alias("mean_area"), number("largest").cast("bigint").alias("max_area"),
        F.greatest(number("parts") - 1, F.lit(0)).cast("int").alias("h0"), number("holes").cast("int").alias("h1"),
    )
