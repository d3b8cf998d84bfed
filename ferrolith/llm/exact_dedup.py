"""Exact duplicates by a log-structured merge index over text digests (DataFrame operations only).

Every task of a flush is a memtable, written as one file of a run that is sorted by digest. Runs and the compacted level
carry a bit filter of their digests. A lookup asks the filters first and reads only what they pass; compaction merges
the level with the runs since the last one, entries that the level's filter doesn't know being added without meeting
it, and keeps the identifier that stays and the number of rows of each digest. Digests with several rows are hits; their
texts are compared byte by byte before rows count as equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm.common import BitFilter, build_filter, join_groups, keep_rows, materialize, scratch_path, text_or_empty, write_table

ENTRY_SCHEMA = "digest binary, doc_id bigint, run int, row bigint, n bigint"


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class Sorted:
    """A run or the level: entries sorted by digest within files, and their filter."""

    path: str
    entries: DataFrame
    filter: BitFilter


class DigestIndex:
    """Runs and the compacted level under one shared folder. keep: `max` or `min` of the doc_id stays, null ids last.

    Entries are digest, doc_id, run, row, n: the row that stays, by the number of its flush and its own number there, and how many rows there are.
    """

    def __init__(self, spark: SparkSession, keep: str = "max", digest=sha256_digest, path: str | None = None):
        if keep not in ("max", "min"):
            raise ValueError(f"keep must be max or min, not {keep!r}")
        self.spark, self.keep, self.digest = spark, keep, digest
        self.path = path or scratch_path(spark, "lsm")
        self.flushes = self.compactions = 0
        self.runs: list[Sorted] = []
        self.level: Sorted | None = None
        #: Paths of the runs and levels that the last lookup had to read.
        self.read: list[str] = []

    def merge(self, entries: DataFrame) -> DataFrame:
        """One entry for each digest. Entries are combined within each task before they are shuffled."""
        known = F.col("doc_id").isNotNull()
        order = F.struct((known if self.keep == "max" else ~known).alias("rank"), "doc_id", "run", "row")
        stays = F.max(order) if self.keep == "max" else F.min(order)
        return entries.groupBy("digest").agg(stays.alias("stays"), F.sum("n").alias("n")).select("digest", "stays.doc_id", "stays.run", "stays.row", "n")

    def _write(self, entries: DataFrame, name: str) -> Sorted:
        path = f"{self.path}/{name}"
        table = write_table(entries.sortWithinPartitions("digest"), path)
        return Sorted(path, table, build_filter(table, "digest"))

    def flush(self, docs: DataFrame) -> Sorted:
        """Write one more run; no shuffle."""
        entries = docs.select(
            self.digest(text_or_empty()).alias("digest"), F.col("doc_id").cast("bigint").alias("doc_id"),
            F.lit(self.flushes).alias("run"), F.monotonically_increasing_id().alias("row"), F.lit(1).cast("bigint").alias("n"),
        )
        self.runs.append(self._write(entries, f"run-{self.flushes:05d}"))
        self.flushes += 1
        return self.runs[-1]

    def compact(self) -> DataFrame:
        """Merge the runs since the last compaction into the level; one entry for each digest."""
        if not self.runs:
            return self.level.entries if self.level else self.spark.createDataFrame([], ENTRY_SCHEMA)
        fresh = self.runs[0].entries
        for run in self.runs[1:]:
            fresh = fresh.unionByName(run.entries)
        merged = self.merge(fresh)
        if self.level:
            marked = self.level.filter.mark(materialize(merged, "lsm-merged"))
            meet = marked.filter("maybe").drop("maybe").unionByName(self.level.entries)
            merged = self.merge(meet).unionByName(marked.filter("NOT maybe").drop("maybe"))
        self.level = self._write(merged, f"level-{self.compactions:05d}")
        self.compactions += 1
        self.runs = []
        return self.level.entries

    def lookup(self, digests: DataFrame) -> DataFrame:
        """The entries of these digests (column digest) over the level and all runs. A table whose filter passes none isn't read."""
        wanted = materialize(digests.select("digest").distinct(), "lsm-wanted")
        self.read, found = [], self.spark.createDataFrame([], ENTRY_SCHEMA)
        for table in [*([self.level] if self.level else []), *self.runs]:
            passed = materialize(table.filter.mark(wanted).filter("maybe").select("digest"), "lsm-passed")
            if passed.limit(1).count():
                self.read.append(table.path)
                found = found.unionByName(self.merge(table.entries).join(passed, "digest", "left_semi"))
        return self.merge(found)


def exact_groups(docs: DataFrame, keep: str = "max", digest=sha256_digest) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Equal texts form a group, of which exactly one row is kept: the one with the largest
    (keep="min": smallest) doc_id, of several such rows any one. Null doc_ids never win over others; a group with null doc_ids alone has a
    null keep_id. An empty table gives an empty result. Columns other than doc_id and text are not read. text_sha256 is
    the index's digest in hex, SHA-256 unless another digest is given.
    """
    index = DigestIndex(docs.sparkSession, keep, digest)
    rows = index.flush(docs).entries
    level = index.compact()
    total = level.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    # Byte verification: the texts of hits meet as grouping keys, combined in each task before they are shuffled.
    hits = level.filter("n > 1")
    hit_filter = build_filter(hits, "digest")
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", digest(F.col("text")))
    texts = join_groups(hit_filter.mark(texts).filter("maybe").drop("maybe"), hits.select("digest", "n"), ["digest"], total, "n", "left_semi")
    clashes = texts.groupBy("digest", "text").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1")
    clashes = materialize(clashes.select("digest"), "clashes")

    marked = hit_filter.mark(rows)
    alone = marked.filter("NOT maybe").select("digest", "doc_id", "row", F.lit(None).cast("bigint").alias("keep_id"), F.lit(None).cast("bigint").alias("keep_row"), F.lit(None).cast("bigint").alias("n"))
    groups = hits.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), "n")
    met = marked.filter("maybe").select("digest", "doc_id", "row")
    if clashes.limit(1).count():  # different texts under one digest: their rows are grouped by the text itself
        apart = materialize(texts.join(clashes, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "clashing")
        apart = apart.withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("run", F.lit(0)).withColumn("n", F.lit(1).cast("bigint"))
        by_text = index.merge(apart.select(F.col("text").alias("digest"), "doc_id", "run", "row", "n")).select(F.col("digest").alias("text"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), "n")
        met, groups = met.join(clashes, "digest", "left_anti"), groups.join(clashes, "digest", "left_anti")
        alone = alone.unionByName(join_groups(apart.select("digest", "text", "doc_id", "row"), by_text, ["text"], total, "n").drop("text"))
    found = alone.unionByName(join_groups(met, groups, ["digest"], total, "n"))
    single = F.col("n").isNull()
    columns = [
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ]
    return found.select(*columns)


def drop_exact_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with all their columns: exactly one of each group of equal texts."""
    groups = exact_groups(docs, keep).filter("group_size > 1 AND kept").select(F.unhex("text_sha256").alias("digest"), "doc_id")
    groups = materialize(groups, "exact-kept")
    return keep_rows(docs, groups, groups)
