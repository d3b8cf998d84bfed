import pytest
from pyspark.sql import functions as F

from ferrolith.functions import text as T
from ferrolith.operators import aliases as A
from ferrolith.operators.vocabulary import CONDITION_AXIS, GRADE_AXIS, Vocabulary, VocabularyError, build


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, expected", [
    ("0.45C", ["0.45c"]), ("Quenched & Tempered", ["quenched", "tempered"]), ("normalised low carbon steel", ["normalized", "low", "carbon"]), ("", []), (".8. x", ["8", "x"]),
])
def test_tokens(spark, raw, expected):
    assert one(spark, T.canonical_tokens(F.lit(raw))) == expected


GRADES = {"AC1 970C 90M WQ": "grade/ferrous/uhcs_ac1", "0.45C quenched & tempered": "grade/ferrous/medium_carbon", "Midrex DRI": None, None: None, "1045 4140": None}
CONDITIONS = {"normalised": "condition/austenitize/air_cool", "Q": "condition/austenitize/unspecified_quench", "650-1H": None, "WC": None, "hot-rolled": "condition/hot_rolled"}


@pytest.mark.parametrize("table, wanted", [(A.GRADE_ALIASES, GRADES), (A.CONDITION_ALIASES, CONDITIONS)])
def test_alias_joins_and_expressions_agree(spark, table, wanted):
    rows = spark.createDataFrame(list(enumerate(wanted)), "k int, raw string")
    joined = {r.k: r.node_id for r in A.normalize_strings(rows, "k", "raw", spark, table).collect()}
    node, _ = A.match_column(F.col("raw"), table)
    direct = {r.k: r.n for r in rows.select("k", node.alias("n")).collect()}
    assert list(wanted.values()) == [joined[k] for k in sorted(joined)] == [direct[k] for k in sorted(direct)]


def test_ambiguous_and_disagreeing_fields(spark):
    node, clash = A.match_column(F.lit("1045 4140"), A.GRADE_ALIASES)
    assert one(spark, F.struct(node.alias("n"), clash.alias("c"))).c
    node, clash = A.agree([F.lit("AC1 WQ"), F.lit("FC")], A.CONDITION_ALIASES)
    assert one(spark, clash) and one(spark, node) is None
    rows = spark.createDataFrame([(1, "AC1 WQ", "FC"), (2, "AC1 WQ", None)], "k int, a string, b string")
    found = {r.k: (r.node_id, r.ambiguous) for r in A.resolve_exploded(rows, "k", ["a", "b"], spark, A.CONDITION_ALIASES).collect()}
    assert found == {1: (None, True), 2: (A.WATER_QUENCH, False)}


def test_alias_table_errors(spark):
    with pytest.raises(A.AliasTableError):
        A.alias_frame(spark, {"the steel": "x"})
    with pytest.raises(A.AliasTableError):
        A.alias_frame(spark, {"mild steel": "x", "Mild": "y"})


@pytest.mark.parametrize("route, t, tu, h, hu, leaf", [
    ("WQ", 800.0, "C", 1.5, "H", "t800c_90m"), ("water quenched", 970.0, " c", 180.0, "m", "t970c_3h"), ("WQ", 850.0, "C", 1.0, "H", None), ("Q", 800.0, "C", 90.0, "M", None),
    ("WQ-2C", 800.0, "C", 90.0, "M", None), ("WQ", 800.0, "F", 90.0, "M", None),
])
def test_structured(spark, route, t, tu, h, hu, leaf):
    got = one(spark, A.structured_condition(F.lit(route), F.lit(t), F.lit(tu), F.lit(h), F.lit(hu)))
    assert got == (leaf and f"{A.WATER_QUENCH}/{leaf}")


def test_exact_condition_needs_agreement(spark):
    rows = [(1, "AC1 800C 90M WQ", "WQ", 800.0, 1.5, "H"), (2, "AC1 800C 90M WQ", "WQ", 800.0, 2.0, "H"), (3, "AC1 800C 90M 700C 5M WQ", "WQ", 800.0, 90.0, "M"), (4, "AC1 WQ", "WQ", 800.0, 90.0, "M"), (5, "AC1 800C 90M", None, 800.0, 90.0, "M")]
    df = spark.createDataFrame(rows, "k int, label string, cool string, t double, h double, hu string")
    got = {r.k: r.x for r in df.select("k", A.exact_condition(F.col("label"), F.col("cool"), F.col("t"), F.lit("C"), F.col("h"), F.col("hu")).alias("x")).collect()}
    assert got == {1: f"{A.WATER_QUENCH}/t800c_90m", 2: None, 3: None, 4: None, 5: None}


def test_aliases_stand_on_their_axes():
    v = Vocabulary.load()
    A.check_alias_targets(A.GRADE_ALIASES, v, GRADE_AXIS)
    A.check_alias_targets(A.CONDITION_ALIASES, v, CONDITION_AXIS)
    assert v.family_of("ferrous/pearlite/lamellar") == "ferrous" and len(v.families()) == 2
    with pytest.raises(VocabularyError):
        v.family_of("grade/ferrous")
    with pytest.raises(VocabularyError):
        v.require(["nowhere"], GRADE_AXIS)
    with pytest.raises(VocabularyError):
        v.require(["ferrous"], GRADE_AXIS)


@pytest.mark.parametrize("raw", [{}, {"a": {"axis": "colour"}}, {"a": {"children": {"b": {"axis": "condition"}}}}, {"a": {"children": {"b": {"children": {"c": {"children": {"d": {}}}}}}}}])
def test_bad_trees(raw):
    with pytest.raises(VocabularyError):
        build(raw)


def test_four_levels_of_conditions(tmp_path):
    nodes = build({"c": {"axis": "condition", "children": {"a": {"children": {"b": {"children": {"d": None}}}}}}})
    assert nodes[-1].id == "c/a/b/d" and nodes[-1].level == 4
    f = tmp_path / "v.json"
    f.write_text('{"x": {"children": {"y": {}}}}')
    assert Vocabulary.load(f).ids() == ["x", "x/y"]


def test_scopes_and_signatures(spark):
    assert one(spark, T.scope_fallbacks(F.lit("a/b"))) == ["a/b", "a"]
    assert one(spark, T.thermal_signature(F.lit(800.0), F.lit(1.5), F.lit("H"), F.lit(None).cast("string"))) == "t800c_1p5h_unknown"
    assert one(spark, T.count_temperatures(F.lit("AC 800C 5M x-900C 700 c"))) == 2
    assert one(spark, T.stem_of(F.lit("/a/b.c/uhcs1.png"))) == "uhcs1"
