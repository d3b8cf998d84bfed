"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. Per source, sizes are summed by hash bucket; the bucket in which the running sum crosses
the budget is cut into finer buckets, and so on, until the threshold is a hash value. A document below its source's
threshold is taken once more than the rest. Nothing is sorted, and larger budgets take supersets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Hash bits that one histogram level resolves.
LEVEL_BITS = 10
#: Most copies of a document.
MOST_COPIES = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mixing_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the document's id and text, as a bigint that is never negative."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: source, source_size, target. Works on sums per source only.

    Targets share the sum of all sizes by weight and stop at `most` times a source's size. Water filling in closed form:
    sources sorted by (cap / weight) are full until the level that the rest share falls below the next one's cap.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = sums.select("source", "source_size", rank.alias("rank")).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    full = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - full) / left
    level = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    chosen = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(Window.partitionBy())["level"]
    return level.withColumn("chosen", chosen).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("chosen") * F.col("weight"), F.col("cap"))).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target, copies (of every document), below (hashes up to it get one more copy).

    A hash value is taken or left as a whole, whichever brings the sum nearer to the budget.
    """
    spark = sized.sparkSession
    budget = F.col("target") - F.col("copies") * F.col("source_size")
    state = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_COPIES))).otherwise(F.lit(0)).cast("bigint"))
    state = materialize(state.select("source", "source_size", "target", "copies", budget.alias("left"), F.lit(0).cast("bigint").alias("prefix"), F.lit(False).alias("done")), "mix-state")
    bits, rank = 0, F.col("hash_rank")
    while bits < 60:
        # Sums by the next LEVEL_BITS bits, for documents in their source's boundary bucket only.
        here = sized.join(state.filter("not done"), sized["source"].eqNullSafe(state["source"])).drop(state["source"])
        here = here.filter(F.shiftright(rank, 60 - bits) == F.col("prefix")) if bits else here
        bits += LEVEL_BITS
        histogram = here.groupBy("source", F.shiftright(rank, 60 - bits).alias("bucket")).agg(F.sum("size").alias("sum"), F.count("*").alias("docs"))
        running = F.sum("sum").over(Window.partitionBy("source").orderBy("bucket"))
        run = histogram.withColumn("running", running)
        joined = run.join(state.filter("not done").select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
        # The boundary: the first bucket whose running sum passes the budget.
        cut = joined.filter(F.col("running") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", "running", "sum", "docs")).alias("cut"))
        cut = cut.select(F.col("source").alias("c"), F.col("cut.bucket").alias("bucket"), (F.col("cut.running") - F.col("cut.sum")).alias("before"), F.col("cut.sum").alias("sum"), F.col("cut.docs").alias("docs"))
        moved = state.join(cut, F.col("source").eqNullSafe(F.col("c")), "left")
        shift = F.lit(60 - bits)
        finest = (F.col("docs") == 1) | F.lit(bits >= 60)
        left = F.col("left") - F.col("before")
        nearer = F.when(left * 2 >= F.col("sum"), F.col("bucket") + 1).otherwise(F.col("bucket"))
        # prefix of a source that is done is a threshold in full 60 bits: hashes below it are taken.
        state = materialize(
            moved.select(
                "source", "source_size", "target", "copies",
                F.when(F.col("done") | F.col("bucket").isNull(), F.col("left")).otherwise(left).alias("left"),
                F.when(F.col("done"), F.col("prefix")).when(F.col("bucket").isNull(), F.lit(1).cast("bigint") * F.lit(2**60)).when(finest, F.shiftleft(nearer, 60 - bits)).otherwise(F.col("bucket")).cast("bigint").alias("prefix"),
                (F.col("done") | F.col("bucket").isNull() | finest).alias("done"),
            ),
            "mix-state",
        )
        if state.filter("not done").limit(1).count() == 0:
            break
    return state.select("source", "source_size", "target", "copies", F.col("prefix").alias("below"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a 60-bit hash of every document, as a table."""
    return materialize(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
            mixing_hash(F.col("doc_id"), F.col("text")).alias("hash_rank"),
        ),
        "mix-sizes",
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    size is the number of words of the text, 0 for a null text. Null sources form one source, the last. taken is
    copies x size with 0 to 3 copies. Rows that repeat a doc_id and text have one hash and share their decision; the sum of a
    source's taken words misses its target by half the size of the documents at one hash value at most. A source without
    words has target 0, and its documents 0 copies. Empty tables give an empty result. Reruns agree: only hashes decide.
    """
    sized = sized_documents(docs)
    limits = thresholds(sized, materialize(source_targets(sized, weights), "mix-targets"))
    copies = F.col("limit_copies") + (F.col("hash_rank") < F.col("below")).cast("bigint")
    copies = F.when(F.col("source_size") > 0, F.least(copies, F.lit(MOST_COPIES).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    limits = limits.withColumnsRenamed({"source": "limit_source", "copies": "limit_copies"})
    return (
        sized.join(limits, F.col("source").eqNullSafe(F.col("limit_source")))
        .select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (copies * F.col("size")).alias("taken"), copies.alias("copies"))
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns. Documents without words are left out."""
    sized = sized_documents(docs)
    limits = thresholds(sized, materialize(source_targets(sized, weights), "mix-targets"))
    limits = limits.select(F.struct(F.col("source").alias("source"), "copies", "below", "source_size").alias("limit"))
    # The caller's row is one column, so that none of its names can meet those used here.
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), mixing_hash(F.col("doc_id"), F.col("text")).alias("hash_rank"))
    joined = hashed.join(limits, F.col("source").eqNullSafe(F.col("limit.source"))).filter("limit.source_size > 0")
    times = F.least(F.col("limit.copies") + (F.col("hash_rank") < F.col("limit.below")).cast("bigint"), F.lit(MOST_COPIES).cast("bigint"))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("copy")).select("row.*")
