"""What several corpus operators share: scratch tables and skew-safe joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy if it holds more than this share of the rows; so at most 1 / HEAVY_SHARE keys are heavy.
HEAVY_SHARE = 1 / 1000
#: Used by local sessions alone, where the driver and the executors are one process.
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees. A cluster must name it; a local session that names none gets one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINT_DIR)
        named = LOCAL_CHECKPOINT_DIR
    return named.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """All scratch tables of this application."""
    return f"{shared_dir(spark)}/ferrolith/{spark.sparkContext.applicationId}"


_folder: ContextVar[str] = ContextVar("scratch folder", default="")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_folder.get() or scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[None]:
    """Scratch tables made inside lie in one folder, which is removed at the end: write results elsewhere before."""
    path = scratch_path(spark, name)
    token = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(token)
        remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this application. Results that aren't written yet can't be read any more."""
    remove_path(spark, scratch_root(spark))


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors cost no recomputation."""
    return write_table(df, scratch_path(df.sparkSession, name), **options)


def write_table(df: DataFrame, path: str, **options: str) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a Python task takes together from a batch, so that neither side holds large batches.
PART_ROWS = 1000


def parts(batches: Iterator, rows: int = PART_ROWS) -> Iterator:
    """Arrow batches in parts. At the end the worker, which later stages use again, gives memory back."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    give_back()


#: The operator whose tasks this Python worker ran last, and what clears its caches.
_worker: dict = {"operator": None, "clear": None}


def take_worker(operator: str, clear: Callable[[], None] | None = None) -> None:
    """Called at the start of a task: a worker is used again by later stages, and holds the caches of one operator at a time."""
    if _worker["operator"] != operator and _worker["clear"]:
        _worker["clear"]()
        give_back()
    _worker.update(operator=operator, clear=clear)


def give_back() -> None:
    """Return freed memory of this Python worker to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, size: str, how: str = "left") -> DataFrame:
    """Join rows with one-row-per-key groups when a few keys may hold most rows.

    Heavy groups (more than HEAVY_SHARE of total by the column `size`) are at most 1 / HEAVY_SHARE, so they are broadcast
    whatever the input; all other keys are shuffled, none of them with more than that share of the rows. how: left, inner
    or left_semi. rows is read twice, so it should be a table. Keys mustn't be null.
    """
    bound = max(1, int(total * HEAVY_SHARE))
    if how == "left_semi":  # keys are unique, so an inner join with them alone; it stays where it is put in the plan
        groups, how = groups.select(*{*keys, size}), "inner"
        narrow = lambda df: df.drop(size)
    else:
        narrow = lambda df: df
    heavy, light = groups.filter(F.col(size) > bound), groups.filter(F.col(size) <= bound)
    hot = rows.join(F.broadcast(narrow(heavy)), keys, "inner")
    cold = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(narrow(light), keys, how)
    return hot.unionByName(cold)


#: A bit filter has FILTER_BITS_PER_KEY bits for each key, FILTER_MOST_BITS (8 MB) at most, in rows of FILTER_ROW_BITS.
FILTER_BITS_PER_KEY, FILTER_MOST_BITS, FILTER_ROW_BITS = 16, 2**26, 32768


def _filter_size(keys: DataFrame) -> int:
    wanted, bits = keys.count() * FILTER_BITS_PER_KEY, FILTER_ROW_BITS
    while bits < min(wanted, FILTER_MOST_BITS):
        bits *= 2
    return bits


def bit_filter(keys: DataFrame, place: Column) -> DataFrame:
    """filter_row, filter_bits: the bits at place, in rows; 8 MB at most."""
    row, bit = F.floor(place / FILTER_ROW_BITS).cast("int"), F.pmod(place, F.lit(FILTER_ROW_BITS))
    return keys.select(row.alias("filter_row"), bit.alias("bit")).groupBy("filter_row").agg(F.bitmap_construct_agg("bit").alias("filter_bits"))


@dataclass(frozen=True)
class BitFilter:
    """The bits of a column's values as a table in the shared folder, 8 MB at most."""

    bits: DataFrame
    size: int
    column: str

    def mark(self, rows: DataFrame, flag: str = "maybe") -> DataFrame:
        """rows with the boolean `flag`: false only if the column's value is not among the keys. Broadcasts the bits."""
        place = F.pmod(F.xxhash64(self.column), F.lit(self.size))
        row, bit = F.floor(place / FILTER_ROW_BITS).cast("int"), F.pmod(place, F.lit(FILTER_ROW_BITS))
        byte = F.conv(F.hex(F.substring(F.col("__bits.filter_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        there = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
        bits = self.bits.select(F.struct("filter_row", "filter_bits").alias("__bits"))
        return rows.join(F.broadcast(bits), row == F.col("__bits.filter_row"), "left").withColumn(flag, there).drop("__bits")


def build_filter(keys: DataFrame, column: str) -> BitFilter:
    size = _filter_size(keys)
    return BitFilter(materialize(bit_filter(keys, F.pmod(F.xxhash64(column), F.lit(size))), "bit-filter"), size, column)


def maybe_in(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """rows with `maybe`: false only if the column's value is not among keys."""
    return build_filter(keys, column).mark(rows)


def text_digest() -> Column:
    """SHA-256 of the text, null as empty."""
    return F.unhex(F.sha2(text_or_empty(), 256))


def keep_rows(docs: DataFrame, touched: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of docs with all their columns: those whose text isn't touched, and one row for each (digest, doc_id) in stay.

    touched: digest, of texts about which a decision was taken; stay: digest, doc_id, each pair once. Rows that a filter clears
    aren't moved; of the others, those that another filter lets pass are combined by pair within each task and meet their pair
    once, so that neither a text nor a pair with many rows makes a large group.
    """
    # The caller's row is one column, so that none of its names can meet those used here.
    digest = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_digest().alias("digest"), F.col("doc_id").cast("bigint").alias("pair_id"))
    marked = build_filter(touched.select("digest"), "digest").mark(digest, "touched")
    pair = F.xxhash64("digest", F.coalesce(F.col("pair_id").cast("string"), F.lit("null")))
    pairs = materialize(stay.select("digest", F.col("doc_id").cast("bigint").alias("pair_id")).withColumn("pair", pair), "pairs-that-stay")
    likely = build_filter(pairs, "pair").mark(marked.filter("touched").withColumn("pair", pair), "likely").filter("likely")
    one = likely.groupBy("digest", "pair_id").agg(F.first("row").alias("row"))
    known = pairs.select(F.col("digest").alias("known"), F.col("pair_id").alias("known_id"))
    met = one.join(known, (F.col("digest") == F.col("known")) & F.col("pair_id").eqNullSafe(F.col("known_id")), "left_semi")
    # Rows that the first filter couldn't clear although no decision was taken about their text.
    missed = marked.filter("touched").join(touched.select("digest").distinct(), "digest", "left_anti")
    return marked.filter("NOT touched").select("row.*").unionByName(missed.select("row.*")).unionByName(met.select("row.*"))


def filter_bits(keys: DataFrame, column: str):
    """The same for bigint keys and numpy: a broadcast byte array of at most 8 MB, bit key & (size - 1) set, and its size."""
    import numpy as np

    size = _filter_size(keys)
    bits = np.zeros(size // 8, np.uint8)
    for r in bit_filter(keys, F.col(column).bitwiseAND(F.lit(size - 1).cast("bigint"))).collect():
        at = r.filter_row * FILTER_ROW_BITS // 8
        bits[at : at + FILTER_ROW_BITS // 8] = np.frombuffer(bytes(r.filter_bits), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits), size
