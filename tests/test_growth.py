"""Steps whose cost once grew faster than their rows: expressions made once, groups' names, labels in place, links joined by group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolith.functions import vectors as vec
from ferrolith.operators import audit, components, evaluation, masks


def test_softmax_computes_its_argument_once(spark):
    v = F.transform("x", lambda x: x + F.lit(12345.5))
    for made in (vec.softmax(v), vec.argmax(v)):
        assert str(made).count("12345.5") == 1
    rows = spark.createDataFrame([([0.0, 1.0, -2.5],), ([3.0],), (None,)], "x array<double>").select(vec.softmax(F.col("x")), vec.argmax(F.col("x"))).collect()
    powers = np.exp(np.array([0.0, 1.0, -2.5]) - 1.0)
    assert np.allclose(rows[0][0], powers / powers.sum(), rtol=1e-15) and rows[0][1] == 1 and tuple(rows[1]) == ([1.0], 0) and tuple(rows[2]) == (None, None)


def test_a_group_is_named_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(audit, "NAMED_TOGETHER", 3)
    meta = spark.createDataFrame([(i, "a") for i in range(40)] + [(99, "b"), (7000, None)], "sample_key long, sample_label string")
    groups = audit.split_groups(meta)
    name = "uhcs-samples-" + "-".join(map(str, range(40)))
    assert {tuple(r) for r in groups.collect()} == {*((i, name) for i in range(40)), (99, "uhcs-sample-99"), (7000, "uhcs-sample-7000")}
    tasks = groups.filter("sample_key < 99").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_labels_keep_to_four_bytes():
    inside = np.random.default_rng(4).random((5, 9, 7)) < 0.6
    label = masks.label_stack(inside, masks.EIGHT)
    assert label.dtype == np.int32 and ((label > 0) == inside).all()
    where = {tuple(p): int(label[tuple(p)]) for p in np.argwhere(inside)}
    for (i, y, x), own in where.items():
        assert all(where.get((i, y + dy, x + dx), own) == own for dy, dx in masks.EIGHT)
        assert own <= 63 * i + 7 * y + x + 1 and label.ravel()[own - 1] == own


@pytest.mark.parametrize("most", [1000, 1])
def test_links_are_joined_by_group(spark, monkeypatch, most):
    monkeypatch.setattr(components, "MOST_LINKS", most)
    rows = [("a", i, i + 1) for i in range(30)] + [("b", 9, 4), ("b", 4, 4), ("b", 30, 31), (None, 1, 2), ("c", 5, None)]
    got = {(r.name, r.node): r.root for r in components.grouped_components(spark.createDataFrame(rows, "name string, one long, other long")).collect()}
    want = {("a", i): 0 for i in range(31)} | {("b", 9): 4, ("b", 4): 4, ("b", 30): 30, ("b", 31): 30}
    assert got == want


def test_trees_are_fitted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "TREE_ROWS", 300, raising=False)
    rows = spark.range(0, 1000, 1, 1).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x1"), (F.col("id") % 11).cast("double").alias("x2"), ((F.col("id") % 7) * 3.0).alias("y"))
    dealt = evaluation.dealt_rows(rows, "k")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 1000 and max(sizes) < 400
    assert evaluation.dealt_rows(rows.limit(300), "k").count() == 300 and evaluation.dealt_rows(rows.filter("k < 300"), "k").rdd.getNumPartitions() == 1
    model = evaluation.fit_tree_head(rows, "k", ["x1", "x2"], "y")
    got = model.transform(rows).agg(F.count("*").alias("n"), F.max(F.abs(F.col("p") - F.col("y"))).alias("error")).first()
    assert got.n == 1000 and got.error < 2.5
