"""Filters and columns that reach SQLite, and results that don't depend on it."""

import sqlite3

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from ferrolith.sources import sqlite as S

TEXTS = ["ab", "AB", "aé", "", None, "b\0c", "日本", "a%b", "a_b"]


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "t.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE t (k INTEGER, x REAL, s TEXT COLLATE NOCASE, b BLOB, "odd ""name" TEXT, d DECIMAL)')
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", [(i if i % 4 else None, i / 3 if i % 5 else None, TEXTS[i % 9], bytes([i % 7, 200]), "o", str(i)) for i in range(90)])
        db.execute("CREATE TABLE w (k INTEGER PRIMARY KEY, s TEXT) WITHOUT ROWID")
        db.executemany("INSERT INTO w VALUES (?, ?)", [(i, "x") for i in range(5)])
        db.execute("CREATE VIEW v AS SELECT k, s FROM t WHERE k > 40")
    return path


FILTERS = [
    "k = 7", "k > 40 AND x < 20.5", "k <=> 7", "k IS NULL", "k IS NOT NULL AND s = 'ab'", "s >= 'a' AND s < 'b'", "s LIKE 'a%'", "s LIKE '%b'", "s LIKE '%é%'", "s = ''", "s <> 'ab'", "NOT (k <=> 7)", "k IN (1, 2, 3)", "NOT k IN (1, 2, 3)",
    "s IN ('AB', 'x')", "x = double('nan')", "x > double('-inf')", "k = 7 OR s = 'AB'", "NOT s LIKE 'a%'", "d = '7'", "b = X'03C8'", "b > X'03'", "`odd \"name` = 'o' AND k < 3", "s = 'b\0c'", "s > '日'", "length(s) = 2", "s LIKE 'a\\\\_%'",
]


@pytest.mark.parametrize("where", FILTERS)
def test_filters_change_nothing(spark, database, where):
    pushed = S.read_table(spark, database, "t")
    with sqlite3.connect(database) as db:
        plain = spark.createDataFrame([(*r[:3], None if r[3] is None else bytearray(r[3]), *r[4:]) for r in ((*q[:5], str(q[5])) for q in db.execute("SELECT * FROM t"))], pushed.schema)
    order = lambda df: sorted(map(repr, df.filter(where).collect()))
    assert order(pushed) == order(plain)


def test_statement():
    reader = S.PushingReader("none", "t", ["k"], 1, {"k": "bigint", "s": "string"})
    reader.where, reader.values = ['"k" > ?'], [3]
    assert reader.statement(S._Slice(1, 9)) == ('SELECT "k" FROM "t" WHERE rowid >= ? AND rowid < ? AND ("k" > ?)', [1, 9, 3])
    kinds = {"k": "bigint", "s": "string", "x": "double"}
    assert S.condition(D.Not(D.EqualTo(("k",), 3)), kinds) == ('NOT ("k" = ?)', [3])
    assert S.condition(D.StringStartsWith(("s",), "é"), kinds) == ('CASE WHEN "s" IS NOT NULL THEN ifnull(substr(CAST("s" AS BLOB), 1, 2) = ?, 0) END', ["é".encode()])
    for kept in (D.EqualTo(("x",), float("nan")), D.EqualTo(("s",), "a\0"), D.EqualTo(("d",), "7"), D.EqualTo(("s", "t"), "a"), D.In(("k",), tuple(range(501))), D.In(("k",), (1, None)), D.StringContains(("s",), ""), D.Not(D.EqualTo(("d",), "1"))):
        assert S.condition(kept, kinds) is None


def test_what_is_pushed(database):
    kinds = {"k": "bigint", "s": "string"}
    reader = S.PushingReader(database, "t", ["k"], 2, kinds)
    odd = D.EqualTo(("d",), "7")
    assert list(reader.pushFilters([D.GreaterThan(("k",), 80), odd, D.EqualTo(("s",), "ab")])) == [odd]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert rows == [(81,)] and all(r == (81,) for r in rows)


def test_plan_columns_and_odd_tables(spark, database):
    few = S.read_table(spark, database, "t", ["k", "s"]).filter("k > 80")
    assert few.columns == ["k", "s"] and {r.k for r in few.collect()} == {k for k in range(81, 90) if k % 4}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert "Filter" not in plan(few)  # SQLite decides all of it
    assert "Filter" in plan(S.read_table(spark, database, "t").filter("length(s) = 2"))
    assert S.read_table(spark, database, "w").count() == 5 and S.read_table(spark, database, "v").filter("k < 50").agg(F.max("k")).first()[0] == 49
    with pytest.raises(ValueError, match="nowhere"):
        S.read_table(spark, database, "t", ["nowhere"])
    # Without the option the source works in a session that has no pushdown.
    spark.conf.set(S.PUSHDOWN, "false")
    assert spark.read.format("sqlite").option("path", database).option("table", "t").load().filter("k = 7").count() == 1
