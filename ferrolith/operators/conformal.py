"""Split-conformal calibration and prediction sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.operators.ranking import order_statistic

DECIMALS = 9


def nonconformity(probabilities: Column, index: Column) -> Column:
    return F.round(1 - F.get(probabilities, index), DECIMALS)


def calibrate(calibration: DataFrame, score: str, alpha: float) -> DataFrame:
    """n, q_hat: the exact order statistic at level ceil((n + 1)(1 - alpha)) / n, the higher one between two. Null scores are left out.

    Scores are computed once, counted by ranges, and only those of one range are sorted.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    scores = calibration.select(F.col(score).cast("double").alias("score")).filter("score IS NOT NULL").persist()
    try:
        n = scores.count()
        if not n:
            raise ValueError("calibration needs at least one row")
        level = min(math.ceil((n + 1) * (1 - alpha)) / n, 1.0)
        q_hat = order_statistic(scores, "score", math.ceil((n - 1) * level))
    finally:
        scores.unpersist()
    return calibration.sparkSession.createDataFrame([(n, round(q_hat, DECIMALS))], "n bigint, q_hat double")


def prediction_set(probabilities: Column, q_hat: Column) -> Column:
    """Indices of the classes whose score is within q_hat, in order."""
    return F.filter(F.sequence(F.lit(0), F.size(probabilities) - 1), lambda i: F.round(1 - F.get(probabilities, i), DECIMALS) <= q_hat)


def singleton(probabilities: Column, q_hat: Column) -> Column:
    """The class if the set has one alone; else null."""
    chosen = prediction_set(probabilities, q_hat)
    return F.when(F.size(chosen) == 1, F.get(chosen, F.lit(0)))


def ranked_classes(probabilities: Column, names: Column) -> Column:
    """(name, p) of every class, the likeliest first, then in the classes' order."""
    pairs = F.transform(probabilities, lambda p, i: F.struct((-p).alias("down"), i.alias("i"), F.get(names, i).alias("name"), p.alias("p")))
    return F.transform(F.array_sort(pairs), lambda s: F.struct(s["name"].alias("name"), s["p"].alias("p")))
