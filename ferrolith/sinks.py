"""Tables written for later stages."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.session import path_exists


def write_features(features: DataFrame, path: str, csv: bool = False) -> None:
    """A feature table as Parquet, or as CSV with a header."""
    writer = features.write.mode("overwrite")
    writer.option("header", True).csv(path) if csv else writer.parquet(path)


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    for name, frame in sections.items():
        # One file as long as a section stays small; a larger one has several.
        frame.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", 1_000_000).csv(f"{path}/{name}")


def head_path(root: str, scope: str, property_name: str) -> Path:
    return Path(root) / f"{scope.replace('/', '__')}--{property_name}.json"


def save_head(head: dict, root: str, scope: str, property_name: str) -> Path:
    """A fitted head as JSON: no code is loaded when it is read."""
    path = head_path(root, scope, property_name)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(head), encoding="utf-8")
    return path


def load_head(root: str, scope: str, property_name: str) -> dict | None:
    path = head_path(root, scope, property_name)
    if not path.exists():
        return None
    head = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(head, dict) or not {"weights", "trees"} & set(head):
        raise TypeError(f"{path}: not a fitted head")
    return head


def fingerprint(rows: DataFrame, parts: list[Column]) -> str:
    """SHA-256 of a table's rows as a multiset, in any order: a key for cached results. Hashes are summed in each task."""
    row = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])
    quarter = lambda i: F.conv(F.substring(F.sha2(row, 256), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    sums = rows.agg(F.count("*"), *[F.coalesce(F.sum(quarter(i)), F.lit(0).cast("decimal(38,0)")) for i in range(8)]).first()
    return hashlib.sha256("\n".join(str(int(x)) for x in sums).encode()).hexdigest()


def cached(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under a key, made and written if it isn't there yet: embeddings of a frozen backbone are so computed once."""
    path = f"{root}/{key}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


MODEL_SCHEMA = "name string, version int, metric double, body string"


def save_model(spark: SparkSession, root: str, name: str, body: dict, metric: float) -> int:
    """One more version of a model in the model table, a row of JSON; its number, from 1."""
    version = 1 + max((r.version for r in model_versions(spark, root, name).select("version").collect()), default=0)
    spark.createDataFrame([(name, version, float(metric), json.dumps(body))], MODEL_SCHEMA).write.mode("append").parquet(root)
    return version


def model_versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    found = spark.read.schema(MODEL_SCHEMA).parquet(root) if path_exists(spark, root) else spark.createDataFrame([], MODEL_SCHEMA)
    return found.filter(F.col("name") == name)


def load_model(spark: SparkSession, root: str, name: str, version: int | None = None) -> dict | None:
    """A version of a model, or the one with the best metric, the earlier of equals; None if there is none."""
    rows = model_versions(spark, root, name)
    rows = rows.filter(F.col("version") == version) if version else rows
    best = rows.orderBy(F.desc("metric"), "version").limit(1).collect()
    return json.loads(best[0].body) if best else None
