"""Linear heads on frozen embeddings: the family router with conformal calibration, and the classifier of label sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.vectors import argmax, dot, doubles, once, softmax
from ferrolith.operators import conformal, records, splits

#: Penalties of the linear head; the first with the best validation accuracy is kept.
PENALTIES = (0.0001, 0.001, 0.01)


def fit_linear(rows: DataFrame, vector: str, cls: str, classes: int, penalty: float = PENALTIES[0]) -> dict:
    """weights and intercepts of a multinomial logistic regression, one row of weights a class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    table = rows.select(array_to_vector(doubles(F.col(vector))).alias("features"), F.col(cls).cast("double").alias("label")).persist()
    try:
        if table.select("label").distinct().limit(2).count() < 2:  # nothing to tell apart
            width = table.first().features.size
            known = int(table.first().label)
            return {"weights": [[0.0] * width for _ in range(classes)], "intercepts": [0.0 if c == known else -50.0 for c in range(classes)]}
        model = LogisticRegression(family="multinomial", regParam=penalty, maxIter=200, tol=1e-8).fit(table)
    finally:
        table.unpersist()
    found = model.numClasses
    weights, intercepts = model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist()
    missing = classes - found  # classes after the last that was seen
    return {"weights": weights + [[0.0] * len(weights[0])] * missing, "intercepts": intercepts + [-50.0] * missing}


def linear_probabilities(head: dict, vector: Column) -> Column:
    rows = F.array(*[F.struct(F.array(*[F.lit(float(w)) for w in ws]).alias("w"), F.lit(float(b)).alias("b")) for ws, b in zip(head["weights"], head["intercepts"])])
    return once(doubles(vector), lambda v: softmax(F.transform(rows, lambda r: dot(v, r["w"]) + r["b"])))


def train_router(rows: DataFrame, vector: str, family: str, group: str, calibration_share: float = 0.25, alpha: float = 0.1, seed: int = 42, split: Callable = splits.hashed_group_split) -> dict:
    """The router: families in order, weights, intercepts, alpha, q_hat and the accuracy on calibration groups, which the fit doesn't see."""
    classes = records.class_table(rows, family)
    names = [r[0] for r in classes.orderBy("cls").collect()]  # one row a family
    if not names:
        raise FileNotFoundError("no record with an embedding and a family")
    if len(names) < 2:
        print(f"only one family, {names[0]}: the router will always predict it")
    dealt = split(records.encode_classes(rows.select(vector, family, group), family, classes), group, calibration_share, 0.0, seed).persist()
    try:
        held = dealt.filter("split = 'val'")
        if not held.limit(1).count():
            raise ValueError("no calibration group; raise calibration_share")
        head = fit_linear(dealt.filter("split = 'train'"), vector, "cls", len(names))
        scored = held.select("cls", linear_probabilities(head, F.col(vector)).alias("p"))
        q_hat = conformal.calibrate(scored.select(conformal.nonconformity(F.col("p"), F.col("cls")).alias("score")), "score", alpha).first().q_hat
        accuracy = scored.agg(F.avg((argmax(F.col("p")) == F.col("cls")).cast("double"))).first()[0]
    finally:
        dealt.unpersist()
    return head | {"families": names, "alpha": alpha, "q_hat": q_hat, "accuracy": accuracy}


def route(rows: DataFrame, router: dict, vector: str) -> DataFrame:
    """rows with probabilities, and family: the one family in the prediction set, else null."""
    names = F.array(*[F.lit(n) for n in router["families"]])
    scored = rows.withColumn("probabilities", linear_probabilities(router, F.col(vector)))
    return scored.withColumn("family", F.get(names, conformal.singleton(F.col("probabilities"), F.lit(router["q_hat"]))))


def train_classifier(rows: DataFrame, vector: str, labels: str, group: str, val: float = 0.15, test: float = 0.15, seed: int = 42) -> dict:
    """The classifier of label sets: classes in order, weights, intercepts and the best validation accuracy."""
    labelled = rows.select(vector, group, records.label_set(F.col(labels)).alias("label_set"))
    classes = records.class_table(labelled, "label_set")
    names = [list(r.label_set) for r in classes.orderBy("cls").collect()]  # one row a class
    if not names:
        raise FileNotFoundError("no labelled record with an embedding")
    dealt = splits.hashed_group_split(records.encode_classes(labelled, "label_set", classes), group, val, test, seed).persist()
    best: dict = {"accuracy": -1.0}
    try:
        for penalty in PENALTIES:
            head = fit_linear(dealt.filter("split = 'train'"), vector, "cls", len(names), penalty)
            hits = dealt.filter("split = 'val'").agg(F.avg((argmax(linear_probabilities(head, F.col(vector))) == F.col("cls")).cast("double"))).first()[0]
            if (hits or 0.0) > best["accuracy"]:
                best = head | {"classes": names, "penalty": penalty, "accuracy": hits or 0.0}
    finally:
        dealt.unpersist()
    return best


def classify(rows: DataFrame, head: dict, vector: str) -> DataFrame:
    """rows with predicted: the likeliest label set."""
    names = F.array(*[F.array(*[F.lit(x) for x in c]) for c in head["classes"]])
    return rows.withColumn("predicted", F.get(names, argmax(linear_probabilities(head, F.col(vector)))))


def segment(images: DataFrame, make_predict: Callable, batch_size: int = 32) -> DataFrame:
    """record_id, h, w, px: the likeliest class of every pixel of images (record_id, h, w, data: RGB numbers), by a model of the caller's.

    make_predict is called once a task, so that a frozen backbone is loaded once for many images; it returns a function from pixels
    (n, h, w, 3) to scores (n, classes, h, w). Images of one shape are predicted together, batch_size at a time.
    """

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for batch in batches:
            for (h, w), same in batch.groupby(["h", "w"], sort=False):
                for i in range(0, len(same), batch_size):
                    part = same.iloc[i : i + batch_size]
                    pixels = np.vstack(part["data"].to_list()).reshape(len(part), int(h), int(w), 3).astype(np.uint8)
                    chosen = predict(pixels).argmax(1).reshape(len(part), -1).astype(np.int32)
                    yield pd.DataFrame({"record_id": part.record_id, "h": part.h, "w": part.w, "px": list(chosen)})

    kind = dict(images.dtypes)["record_id"]
    return images.select("record_id", "h", "w", "data").mapInPandas(predicted, f"record_id {kind}, h int, w int, px array<int>")
