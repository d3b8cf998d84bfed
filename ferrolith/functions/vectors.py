"""Functions of arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often it is used: expressions inside the functions of arrays aren't shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(v: Column) -> Column:
    powers = lambda v, top: F.transform(v, lambda x: F.exp(x - top))
    shares = lambda p: once(total(p), lambda whole: F.transform(p, lambda x: x / whole))
    return once(v, lambda v: once(F.array_max(v), lambda top: once(powers(v, top), shares)))


def argmax(v: Column) -> Column:
    """0-based; the first of equals."""
    return once(v, lambda v: F.array_position(v, F.array_max(v)).cast("int") - 1)


def cross_entropy(probabilities: Column, index: Column) -> Column:
    return -F.ln(F.get(probabilities, index))


def normalise_pixels(px: Column, mean: float, std: float) -> Column:
    return F.transform(px, lambda x: (x / F.lit(255.0) - F.lit(mean)) / F.lit(std))
