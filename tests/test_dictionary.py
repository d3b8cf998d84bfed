import itertools
import random

import pytest
from pyspark.sql import functions as F

from ferrolith.functions import text as T
from ferrolith.operators import aliases as A
from ferrolith.operators.dictionary import resolve_fields, string_dictionary

TABLES = {"grade": A.GRADE_ALIASES, "condition": A.CONDITION_ALIASES}


def test_tokens_of_literals_are_those_of_columns(spark):
    words = [*A.GRADE_ALIASES, *A.CONDITION_ALIASES, "", " .8. x", "the Steel", "Normalising, then cooling", "1.5.C..", "a-b_c", "É45"]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    assert {r.i: r.t for r in rows.select("i", T.canonical_tokens(F.col("w")).alias("t")).collect()} == {i: T.tokens_of(w) for i, w in enumerate(words)}


def test_fields_resolved_by_the_dictionary_equal_the_expression(spark):
    rng = random.Random(3)
    words = ["AC1", "AC", "1045", "AISI", "steel", "WQ", "Q", "quenched", "&", "tempered", "annealed", "full", "x", "0.45C", "mild", "low", "carbon"]
    strings = [None, "", "  ", *(" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(60))]
    rows = spark.createDataFrame([(i, rng.choice(strings), rng.choice(strings)) for i in range(300)], "k int, a string, b string").withColumns({"raw": F.lit("kept"), "tokens": F.lit(1)})
    found = resolve_fields(rows, ["a", "b"], TABLES, "bearers")
    assert found.columns == ["k", "a", "b", "raw", "tokens", "grade", "condition", "bearers"]
    got = {r.k: r for r in found.collect()}
    expected = rows
    for name, table in TABLES.items():
        node, clash = A.agree([F.col("a"), F.col("b")], table)
        expected = expected.withColumns({f"{name}_node": node, f"{name}_clash": clash})
    plain = expected.collect()
    times = [{s: sum(r[c] == s for r in plain) for s in strings} for c in ("a", "b")]
    assert len(got) == len(plain) == 300
    for r in plain:
        ours = got[r.k]
        assert (ours.grade.node_id, ours.grade.ambiguous, ours.condition.node_id, ours.condition.ambiguous) == (r.grade_node, r.grade_clash, r.condition_node, r.condition_clash), r
        assert list(ours.bearers) == [times[i][r[c]] if r[c] else 0 for i, c in enumerate(("a", "b"))] and ours["raw"] == "kept"


def test_dictionary_holds_distinct_strings_once(spark):
    rows = spark.createDataFrame(list(itertools.chain([("1045 4140", "WQ")] * 50, [("odd", None), ("odd", ""), ("alone", "WQ")])), "a string, b string")
    got = {r.raw: r for r in string_dictionary(rows, ["a", "b"], TABLES).collect()}
    assert set(got) == {"1045 4140", "WQ", "odd"} and list(got["WQ"].bearers) == [0, 51] and list(got["odd"].bearers) == [2, 0]
    assert got["1045 4140"].grade.ambiguous and got["1045 4140"].grade.node_id is None and got["WQ"].condition.node_id == A.WATER_QUENCH
    assert string_dictionary(rows.limit(0), ["a"], TABLES).count() == 0


def test_an_audit_plan_is_small(spark):
    from ferrolith.plans import catalogue

    plan = catalogue.q_audit_flags(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert len(plan.toString()) < 60_000  # columns of the dictionary, no expression over all aliases


@pytest.mark.parametrize("value", [None, "1045", "nothing"])
def test_bound_values_are_computed_once(spark, value):
    row = spark.range(1).select(T.bind(F.lit(value).cast("string"), lambda x: F.concat(x, x)).alias("x")).first()
    assert row.x == (value * 2 if value else None)
