import duckdb
import pytest

import __spark_entry__ as entry
from ferrolith.plans import catalogue, oracle

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 7) if isinstance(v, float) else v
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = catalogue.QUERIES[name](spark, SF), db.sql(oracle.SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.collect(), ours.columns) == rows(theirs.fetchall(), theirs.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracle.SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_windowed_stream(spark, tmp_path):
    from ferrolith.streaming.events import windowed_totals

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM totals").first()[0] == events.count()


def test_stream_without_repeats(spark, tmp_path):
    from ferrolith.streaming.events import distinct_events

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events.limit(50)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = distinct_events(stream).select("event_id").writeStream.outputMode("append").format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == events.select("event_id").distinct().count() == events.count()
