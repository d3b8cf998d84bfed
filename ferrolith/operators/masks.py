"""Features of integer masks: area fractions, connected regions, homology, and group means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (dy, dx) of neighbours
FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))
EIGHT = FOUR + ((1, 1), (1, -1), (-1, 1), (-1, -1))

#: Pixels, times classes, that are measured at a time.
STACK_PIXELS = 500_000


def class_fraction(px: Column, cls: Column | int) -> Column:
    """Share of pixels of a class; pixels of unlisted classes count in the whole."""
    return F.try_divide(F.size(F.filter(px, lambda p: p == cls)).cast("double"), F.size(px).cast("double"))


def class_fractions(px: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: class_fraction(px, k))


def foreign_pixels(px: Column, classes: int) -> Column:
    """Whether a pixel is no class from 0 to classes - 1."""
    return F.exists(px, lambda p: (p < 0) | (p >= classes))


def label_stack(inside: np.ndarray, neighbours=FOUR) -> np.ndarray:
    """Regions of the true pixels of m images (m, h, w): each pixel has the smallest place in the stack, from 1, that it is joined with; 0 outside.

    Least labels spread to neighbours and jump to the label of the pixel that a label names, in all images at once.
    """
    m, h, w = inside.shape
    none = m * h * w + 1
    kind = np.int32 if none < 2**31 else np.int64
    spread = np.full((m, h + 2, w + 2), none, kind)
    grid = np.full((m, h, w), none, kind)
    grid[inside] = np.flatnonzero(inside) + 1
    while True:
        spread[:, 1:-1, 1:-1] = grid
        low = grid.copy()
        for dy, dx in neighbours:
            np.minimum(low, spread[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], out=low)
        low[~inside] = none
        new = low.ravel()[np.minimum(low, none - 1) - 1] if none > 1 else low
        new[~inside] = none
        if np.array_equal(new, grid):
            grid[~inside] = 0
            return grid
        grid = new


def label_regions(mask: np.ndarray, neighbours=FOUR) -> tuple[np.ndarray, int]:
    """Regions of true pixels of one image, numbered from 1, and their number."""
    label = label_stack(mask[None], neighbours)[0]
    names, dense = np.unique(np.concatenate(([0], label.ravel())), return_inverse=True)
    return dense[1:].reshape(mask.shape), len(names) - 1


def stack_measures(grids: np.ndarray, classes: int) -> list[np.ndarray]:
    """Of images of one shape (n, h, w), for each image and class: 4-connected regions, their mean and largest area, and the finite
    bars of the class's 0/1 image: h0, the background's 4-connected parts less one; h1, the class's 8-connected parts off the border.
    """
    n, h, w = grids.shape
    inside = (grids[:, None] == np.arange(classes)[None, :, None, None]).reshape(n * classes, h, w)
    owner = lambda root: (root - 1) // (h * w)
    count = lambda roots: np.bincount(owner(roots), minlength=n * classes)
    roots, areas = np.unique(label_stack(inside), return_counts=True)
    roots, areas = roots[roots > 0], areas[roots > 0]
    regions, largest = count(roots), np.zeros(n * classes, np.int64)
    np.maximum.at(largest, owner(roots), areas)
    pixels = inside.reshape(n * classes, -1).sum(1)
    background = np.unique(label_stack(~inside))
    wide = label_stack(inside, EIGHT)
    edge = np.unique(np.concatenate([wide[:, 0].ravel(), wide[:, -1].ravel(), wide[:, :, 0].ravel(), wide[:, :, -1].ravel()]))
    every = np.unique(wide)
    h1 = count(every[every > 0]) - count(edge[edge > 0])
    h0 = np.maximum(count(background[background > 0]) - 1, 0)
    return [regions, pixels / np.maximum(regions, 1), largest, h0, h1]


def region_stats(mask: np.ndarray, cls: int) -> tuple[int, float, int]:
    """Number of 4-connected regions of a class, their mean and largest area."""
    n, mean, largest, _, _ = (x[0] for x in stack_measures(np.where(mask == cls, 0, 1)[None], 1))
    return int(n), float(mean), int(largest)


def homology(mask: np.ndarray, cls: int) -> tuple[int, int]:
    """Finite bars of the class's 0/1 image, H0 and H1."""
    _, _, _, h0, h1 = (x[0] for x in stack_measures(np.where(mask == cls, 0, 1)[None], 1))
    return int(h0), int(h1)


def mask_table(masks: DataFrame, classes: int) -> DataFrame:
    """record_id, cls, n_regions, mean_area, max_area, h0, h1 for each class. masks: record_id, h, w, px (row by row).

    Images of one shape are measured together, all classes at once, STACK_PIXELS at a time.
    """
    names = ["record_id", "cls", "n_regions", "mean_area", "max_area", "h0", "h1"]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (h, w), same in batch.groupby(["h", "w"], sort=False):
                at_once = max(1, STACK_PIXELS // max(1, int(h) * int(w) * classes))
                for i in range(0, len(same), at_once):
                    part = same.iloc[i : i + at_once]
                    grids = np.vstack(part.px.to_list()).astype(np.int64).reshape(len(part), int(h), int(w))
                    columns = [np.repeat(part.record_id.to_numpy(), classes), np.tile(np.arange(classes), len(part)), *stack_measures(grids, classes)]
                    yield pd.DataFrame(dict(zip(names, columns)))

    kind = dict(masks.dtypes)["record_id"]
    return masks.select("record_id", "h", "w", "px").mapInPandas(measured, f"record_id {kind}, cls int, n_regions int, mean_area double, max_area int, h0 int, h1 int")


def persistence(measures: DataFrame) -> DataFrame:
    """record_id, cls and of H0 and H1 the count, total and largest persistence: every finite bar of a 0/1 image lasts from 0 to 1."""
    bars = [x for k in (0, 1) for x in (F.col(f"h{k}").cast("double").alias(f"h{k}_count"), F.col(f"h{k}").cast("double").alias(f"h{k}_total_persistence"), F.when(F.col(f"h{k}") > 0, 1.0).otherwise(0.0).alias(f"h{k}_max_persistence"))]
    return measures.select("record_id", "cls", *bars)


def topological_features(masks: DataFrame, nodes: list[str]) -> DataFrame:
    """record_id, features: topo_<summary>:<node> for each class node and each summary of persistence."""
    table = persistence(mask_table(masks, len(nodes))).withColumn("node", F.get(F.array(*[F.lit(n) for n in nodes]), F.col("cls")))
    summaries = [f"h{k}_{what}" for k in (0, 1) for what in ("count", "total_persistence", "max_persistence")]
    entries = F.array(*[F.struct(F.concat(F.lit(f"topo_{c}:"), "node").alias("key"), F.col(c).alias("value")) for c in summaries])
    return table.groupBy("record_id").agg(F.map_from_entries(F.flatten(F.collect_list(entries))).alias("features"))


def feature_vector(masks: DataFrame, nodes: list[str]) -> DataFrame:
    """record_id, features: frac, n_regions, mean_region_area and max_region_area of each class node."""
    names = F.array(*[F.lit(n) for n in nodes])
    stats = mask_table(masks, len(nodes)).withColumn("node", F.get(names, F.col("cls")))
    parts = [("n_regions", F.col("n_regions").cast("double")), ("mean_region_area", F.col("mean_area")), ("max_region_area", F.col("max_area").cast("double"))]
    entries = F.array(*[F.struct(F.concat(F.lit(f"{k}:"), "node").alias("key"), v.alias("value")) for k, v in parts])
    regions = stats.groupBy("record_id").agg(F.flatten(F.collect_list(entries)).alias("entries"))
    shares = masks.select("record_id", F.transform(class_fractions(F.col("px"), len(nodes)), lambda x, i: F.struct(F.concat(F.lit("frac:"), F.get(names, i)).alias("key"), x.alias("value"))).alias("shares"))
    return shares.join(regions, "record_id").select("record_id", F.map_from_entries(F.concat("shares", "entries")).alias("features"))


def long_features(features: DataFrame) -> DataFrame:
    return features.select("record_id", F.explode("features").alias("feature", "value"))


def group_means(features: DataFrame, group: str, columns: list[str], firsts: list[str], order: str) -> DataFrame:
    """Means by group without nulls and NaN; of the other columns the first value that isn't null, by order. Null groups go."""
    means = [F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in firsts]
    return features.filter(F.col(group).isNotNull()).groupBy(group).agg(*first, *means)


def tile_classes(px: Column, side: int, tile: int) -> Column:
    """For each tile, row by row, the flat indices of its pixels."""
    per = side // tile
    return F.array(*[F.array(*[F.lit((ty * tile + y) * side + tx * tile + x) for y in range(tile) for x in range(tile)]) for ty in range(per) for tx in range(per)])


def crop(px: Column, width: Column, top: Column, left: Column, h: Column, w: Column) -> Column:
    """Rows top to top + h of columns left to left + w of a flat image."""
    return F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.slice(px, ((top + y) * width + left + 1).cast("int"), w.cast("int"))))


def padded_side(side: Column, multiple: int = 32) -> Column:
    return (F.ceil(side / multiple) * multiple).cast("int")


def centred_offset(outer: Column, inner: Column) -> Column:
    """Pixels before the inner side when it is centred in the outer one."""
    return F.floor((outer - inner) / 2).cast("int")


def pad_centred(px: Column, h: Column, w: Column, multiple: int = 32, fill: float = 0.0) -> Column:
    """A flat image, centred in one whose sides are multiples; the rest is filled."""
    tall, wide = padded_side(h, multiple), padded_side(w, multiple)
    top, left = centred_offset(tall, h), centred_offset(wide, w)

    def pixel(i: Column) -> Column:
        y, x = F.floor(i / wide).cast("int") - top, i % wide - left
        return F.when((y >= 0) & (y < h) & (x >= 0) & (x < w), F.get(px, y * w + x)).otherwise(F.lit(fill))

    return F.transform(F.sequence(F.lit(0), tall * wide - 1), pixel)


def crop_centred(px: Column, h: Column, w: Column, tall: Column, wide: Column) -> Column:
    """The middle of a flat image of h x w, tall x wide; an error if the image is smaller."""
    small = (h < tall) | (w < wide)
    part = crop(px, w, centred_offset(h, tall), centred_offset(w, wide), tall, wide)
    return F.when(small, F.raise_error(F.lit("the image is smaller than the crop"))).otherwise(part)


def without_banner(px: Column, h: Column, w: Column, banner: int, full: int) -> Column:
    """A flat image without its last `banner` rows if it has exactly `full` rows; else as it is."""
    return F.when(h == full, F.slice(px, 1, (h - banner) * w)).otherwise(px)


def channels_first(px: Column, h: Column, w: Column) -> Column:
    """Interleaved RGB bytes as three planes of numbers from 0 to 1."""
    n = h * w
    return F.transform(F.sequence(F.lit(0), n * 3 - 1), lambda i: F.get(px, (i % n) * 3 + F.floor(i / n).cast("int")) / 255.0)


def flip_columns(px: Column, h: Column, w: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), h * w - 1), lambda i: F.get(px, i - i % w + (w - 1 - i % w)))


def flip_rows(px: Column, h: Column, w: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), h * w - 1), lambda i: F.get(px, (h - 1 - F.floor(i / w).cast("int")) * w + i % w))


def quarter_turn(px: Column, h: Column, w: Column) -> Column:
    """A counter-clockwise quarter turn; the result has w rows of h pixels."""
    return F.transform(F.sequence(F.lit(0), h * w - 1), lambda i: F.get(px, (i % h) * w + (w - 1 - F.floor(i / h).cast("int"))))


def brighter(px: Column, factor: Column) -> Column:
    """Pixels times a factor, rounded down and kept from 0 to 255."""
    return F.transform(px, lambda p: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(p * factor))).cast("int"))


def augmented(px: Column, h: Column, w: Column, key: Column, seed: int) -> Column:
    """px of a square image, flipped, turned and made brighter or darker by up to a fifth, as a hash of key and seed says: reruns agree."""
    draw = lambda name, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), key), F.lit(n))
    flipped = F.when(draw("flip", 2) == 1, flip_columns(px, h, w)).otherwise(px)
    steps = lambda p: F.when(draw("turn", 4) == 0, p).when(draw("turn", 4) == 1, quarter_turn(p, h, w)).when(draw("turn", 4) == 2, flip_rows(flip_columns(p, h, w), h, w)).otherwise(flip_rows(flip_columns(quarter_turn(p, h, w), h, w), h, w))
    return brighter(F.transform(F.array(flipped), steps)[0], F.lit(0.8) + draw("light", 401) / 1000.0)


def class_channel(data: Column, channels: Column) -> Column:
    """Class numbers of a mask's bytes: the only channel, or the first in RGB order of the image source's BGR(A)."""
    at = F.when(channels >= 3, 2).otherwise(0)
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(data) / channels).cast("int") - 1), lambda i: byte_at(data, i * channels + at))


def byte_at(data: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int")


def rgb_pixels(data: Column) -> Column:
    """The image source's BGR bytes as RGB numbers."""
    return F.transform(F.sequence(F.lit(0), F.length(data) - 1), lambda i: byte_at(data, i - i % 3 + 2 - i % 3))
