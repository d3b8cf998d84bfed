"""Document fingerprints by a homomorphic multiset hash of paragraphs (DataFrame operations only).

Every paragraph is hashed to a wide vector; the fingerprint is the sum of these vectors, lane by lane, modulo powers of
two. Order doesn't matter, and paragraphs can be added or taken out of a fingerprint without the rest of the text. Lanes:
the number of paragraphs and DENSE lanes that every paragraph adds to (equality), and SLOTS lanes, in one of which a paragraph
adds 1 or -1. The difference of two fingerprints' slots holds what is in one text alone, each paragraph as often as it is (likeness).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.llm.common import HEAVY_SHARE, materialize

#: Paragraphs end at line breaks; within a line, at the end of a sentence.
PARAGRAPH_ENDS = r"[\r\n]+|(?<=[.!?])\s+"
DENSE, DENSE_HEX, SLOTS, SLOT_HEX = 8, 8, 320, 4
SLOTS_AT = DENSE_HEX * (DENSE + 1)
#: Stands for a null doc_id in joins; as the least bigint it comes last in descending order, as nulls do.
NULL_KEY = -(2**63)


def big(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _hex(lane: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(lane.cast("bigint").bitwiseAND(big(16**digits - 1)))), digits, "0")


def _wrapped(n: Column) -> Column:
    """n modulo 2**16, from -2**15 up."""
    half = 16**SLOT_HEX // 2
    return (F.pmod(n + F.lit(half), F.lit(2 * half)) - F.lit(half)).cast("smallint")


def sketch(text: Column) -> Column:
    """A text's lanes: n (paragraphs), dense (in hex), slots (array of smallint). text isn't null; without paragraphs all are zero."""
    digests = F.transform(F.filter(F.split(text, PARAGRAPH_ENDS), lambda u: u != ""), lambda u: F.md5(u))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("smallint"), n)
    none = F.array().cast("array<smallint>")

    def code(digest: Column) -> Column:
        """The slot that the paragraph adds to, times two, plus one if it adds -1."""
        draw = F.xxhash64(digest)
        return (F.pmod(draw, F.lit(SLOTS)) * 2 + F.shiftrightunsigned(draw, 40).bitwiseAND(big(1))).cast("int")

    def closed(state: Column) -> Column:
        return F.concat(state["out"], F.when(state["slot"] >= 0, F.array(_wrapped(state["sum"]))).otherwise(none))

    def add(state: Column, c: Column) -> Column:
        """Codes come sorted, so that a slot's stand together; the open slot's sum is carried, those before it are listed."""
        slot, value = F.shiftright(c, 1), F.lit(1) - F.lit(2) * c.bitwiseAND(F.lit(1))
        same = state["slot"] == slot
        out = F.when(same, state["out"]).otherwise(F.concat(closed(state), zeros(slot - state["slot"] - 1)))
        return F.struct(slot.alias("slot"), F.when(same, state["sum"] + value).otherwise(value).alias("sum"), out.alias("out"))

    start = F.struct(F.lit(-1).alias("slot"), F.lit(0).alias("sum"), none.alias("out"))
    finish = lambda s: F.concat(closed(s), zeros(F.lit(SLOTS - 1) - s["slot"]))
    dense_lane = lambda d, i: F.xxhash64(d, i).bitwiseAND(big(16**DENSE_HEX - 1))

    def lanes(d: Column) -> Column:
        dense = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(DENSE - 1)), lambda i: _hex(F.aggregate(d, big(0), lambda a, u: a + dense_lane(u, i)), DENSE_HEX)), "")
        return F.struct(F.size(d).cast("bigint").alias("n"), dense.alias("dense"), F.aggregate(F.sort_array(F.transform(d, code)), start, add, finish).alias("slots"))

    return F.transform(F.array(digests), lanes)[0]  # a lambda over one element, so that digests are made once for each text


def digits(lanes: Column) -> Column:
    """The fingerprint in hex of a sketch."""
    slots = F.transform(lanes["slots"], lambda x: F.when(x == 0, "0" * SLOT_HEX).otherwise(_hex(x, SLOT_HEX)))
    return F.concat(_hex(lanes["n"], DENSE_HEX), lanes["dense"], F.array_join(slots, ""))


def fingerprint(text: Column) -> Column:
    """The fingerprint in hex; text isn't null."""
    return F.transform(F.array(sketch(text)), digits)[0]


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a's paragraphs with b's added (sign 1) or taken out (sign -1)."""
    number = lambda c, at, n: F.conv(F.substring(c, at, F.lit(n)), 16, 10).cast("bigint")
    lanes = lambda p, n, first, count: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: _hex(number(p["a"], i * n + F.lit(first), n) + F.lit(sign) * number(p["b"], i * n + F.lit(first), n), n))
    joined = lambda p: F.array_join(F.concat(lanes(p, DENSE_HEX, 1, DENSE + 1), lanes(p, SLOT_HEX, 1 + SLOTS_AT, SLOTS)), "")
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), joined)[0]


def read_digits(print_: Column) -> Column:
    """The sketch of a fingerprint in hex."""
    number = lambda at, n: F.conv(F.substring(print_, at, F.lit(n)), 16, 10).cast("bigint")
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: _wrapped(number(i * SLOT_HEX + F.lit(1 + SLOTS_AT), SLOT_HEX)))
    return F.struct(number(F.lit(1), DENSE_HEX).alias("n"), F.substring(print_, 1 + DENSE_HEX, DENSE * DENSE_HEX).alias("dense"), slots.alias("slots"))


def sketch_likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 - (paragraphs in one of the texts alone) / (paragraphs of both), repeats counted, estimated; 1 for equal sketches.

    A slot's difference is the sum of what differs there. Slots far above the median hold a paragraph that is repeated
    often, and count as they are. In the others, paragraphs with different signs take each other away: their mean size m
    stands for m * (pi / 2 * m + exp(-1.07 m)) paragraphs a slot, which for random signs is right within 4 %.
    """
    apart = F.sort_array(F.zip_with(a["slots"], b["slots"], lambda x, y: F.abs(_wrapped(x.cast("int") - y.cast("int")).cast("int"))))

    def estimate(d: Column) -> Column:
        middle = F.get(d, F.lit(SLOTS // 2))
        bound = F.when(middle > 0, 4 * F.sqrt(F.pow(middle / 0.6745, F.lit(2.0)) + 0.25) + 1).otherwise(3.0)
        often = F.filter(d, lambda x: x > bound)
        total = lambda c: F.aggregate(c, big(0), lambda s, x: s + x).cast("double")
        rest = F.lit(SLOTS) - F.size(often)  # above 0: half of the slots aren't above the median
        mean = (total(d) - total(often)) / rest
        return total(often) + rest * mean * (math.pi / 2 * mean + F.exp(mean * -1.07))

    found = F.transform(F.array(apart), estimate)[0]
    same = (a["n"] == b["n"]) & (a["dense"] == b["dense"]) & (a["slots"] == b["slots"])
    both = (a["n"] + b["n"]).cast("double")
    return F.when(same, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(found, F.abs(a["n"] - b["n"]).cast("double"), F.lit(1.0)) / F.greatest(both, F.lit(1.0))))


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two fingerprints in hex."""
    return F.transform(F.array(F.struct(read_digits(a).alias("a"), read_digits(b).alias("b"))), lambda p: sketch_likeness(p["a"], p["b"]))[0]


def next_in_order(ids: DataFrame) -> DataFrame:
    """key, next_key for distinct keys, in descending order; after the last comes the first.

    Keys are dealt out by range; only each range's ends meet in one task (as many rows as there are partitions).
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(ids.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "id-ranges")
    own = F.lead("key").over(Window.partitionBy("part").orderBy(F.desc("key")))
    tops = ranged.groupBy("part").agg(F.max("key").alias("top"))
    below = tops.select("part", F.coalesce(F.lag("top").over(Window.orderBy("part")), F.max("top").over(Window.partitionBy())).alias("below"))
    within = ranged.withColumn("own", own).join(F.broadcast(below), "part")
    return within.select(*ids.columns, F.coalesce("own", "below").alias("next_key"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half (rounded down) replaced by as many of the next document's first code points. Null texts
    count as empty. A null doc_id comes last, as if it were the least bigint. Rows that repeat a doc_id all have the same
    next document; of rows that repeat the next one's doc_id, the greatest text counts. A document alone is its own next.
    An empty table gives an empty result; columns other than doc_id and text are not read.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_KEY).cast("bigint"))
    text = F.coalesce("text", F.lit(""))
    ids = docs.select(key.alias("key"), F.length(text).alias("chars")).groupBy("key").agg(F.floor(F.max("chars") / 2).alias("half"), F.count("*").alias("n"))
    pairs = materialize(next_in_order(ids), "next-ids")
    sums = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    texts = docs.select(key.alias("key"), text.alias("text"), sketch(text).alias("sketch"))
    firsts = texts if sums.most <= 1 else texts.groupBy("key").agg(F.max(F.struct("text", "sketch")).alias("top")).select("key", "top.*")
    heads = pairs.select(F.col("key").alias("for_key"), "half", "n", F.col("next_key").alias("key")).join(firsts, "key")
    heads = heads.select(F.col("for_key").alias("key"), "n", F.expr("substring(text, 1, half)").alias("head"), F.col("sketch").alias("next_sketch"))
    bound = max(1, int(sums.total * HEAVY_SHARE))
    if sums.most > bound:  # the rows of a key that holds many are dealt out, and its head goes to each part
        parts = F.ceil(F.col("n") / bound)
        hot = pairs.filter(F.col("n") > bound).select("key", parts.alias("parts"))  # 1 / HEAVY_SHARE keys at most
        texts = texts.join(F.broadcast(hot), "key", "left").withColumn("part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), big(0))).drop("parts")
        heads = heads.withColumn("part", F.explode(F.sequence(big(0), F.when(F.col("n") > bound, parts).otherwise(1).cast("bigint") - 1)))
        joined = texts.join(heads.drop("n"), ["key", "part"])
    else:
        joined = texts.join(heads.drop("n"), "key")
    edited = joined.withColumn("n_chars", F.length("text").cast("bigint"))
    edited = edited.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(head, 1, cast(n_chars div 2 as int)))"))
    done = edited.withColumn("edited_sketch", sketch(F.col("edited")))
    own, changed, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return done.select(
        F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digits(own).alias("fingerprint"), digits(changed).alias("edited_fingerprint"),
        sketch_likeness(own, changed).alias("near_edited"), sketch_likeness(own, following).alias("near_next"),
    )
