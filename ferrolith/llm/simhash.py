"""Near duplicates by SimHash fingerprints and an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most 4 bits share at least 4 of their 8 bytes in place. The index posts a fingerprint
under sets of three positional bytes, chosen so that any four positions hold one of the sets: each qualifying pair meets,
and few others do. Pairs that meet tally the positional bytes they share; count filtering retains those that reach the
guaranteed minimum of four, which are verified bit by bit. Each posting list gives only a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.common import filter_bits, join_groups, keep_rows, materialize, parts, take_worker, text_digest, text_or_empty
from ferrolith.llm.components import components

BYTES, SEED = 8, 42
#: A posting list with more fingerprints is dealt out anew, by slices of the bytes that its key leaves open; a slice
#: with more is compared in pairs of blocks of about that size, in a task for each pair. Neither loses a pair.
SPLIT_LIST = 2000
#: Longer lists are settled from fingerprint to fingerprint in place of walking all distances.
WALK_LIST = 256
#: Texts hashed before their bits are counted.
COUNT_HASHES = 200_000


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of every shingle in order, repeats included; A-Z in lower case, words between ASCII white space."""
    split = text.encode().lower().split()
    if not split:
        return []
    joined, digest = b" ".join(split), xxhash.xxh64_intdigest
    if len(split) <= words:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[s:e], SEED) for s, e in zip(starts[: len(split) - words + 1].tolist(), ends[words - 1 :].tolist())]


def fold(hashes: list[np.ndarray]) -> list[int]:
    """The fingerprint of each array of hashes: the bits set in over half of them; 0 of an empty one."""
    out = []
    for h in hashes:
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), COUNT_HASHES):
            part = h[i : i + COUNT_HASHES]
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = 2 * ones > len(h)
        out.append(int(np.packbits(bits, bitorder="little").view("<u8")[0]) if len(h) else 0)
    return out


def simhash(text: str | None, words: int = 4) -> int:
    return fold([np.array(shingle_hashes(text or "", words), np.uint64)])[0]


def fingerprints(docs: DataFrame, words: int = 4, tagged: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number), and if tagged the text's digest, of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("simhash")
        for batch in parts(batches):
            found = pa.array(np.array([simhash(t, words) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], names=[*batch.schema.names[1:], "fp"])

    return hashable(docs, tagged).mapInArrow(hashed, "doc_id bigint, " + ("digest binary, " if tagged else "") + "fp bigint")


def hashable(docs: DataFrame, tagged: bool) -> DataFrame:
    return docs.select(text_or_empty().alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), *([text_digest().alias("digest")] if tagged else []))


def posted_places(shared: int) -> list[tuple[int, ...]]:
    """Sets of shared - 1 positions (one at least) such that any `shared` positions hold one of the sets.

    For sets of three, positions fall in three classes in turn, and a set lies in one class or has two positions in a class and
    one in the next (Turan's construction: 20 sets). Else sets are picked greedily, the most useful first.
    """
    size = max(1, shared - 1)
    sets = list(combinations(range(BYTES), size))
    if size == 3:
        held = lambda c: [sum(p % 3 == k for p in c) for k in range(3)]
        return [c for c in sets if max(n := held(c)) == 3 or (max(n) == 2 and n[(n.index(2) + 1) % 3] == 1)]
    open_ = set(combinations(range(BYTES), shared))
    chosen = []
    while open_:
        best = max(sets, key=lambda c: sum(set(c) <= set(o) for o in open_))
        chosen.append(best)
        open_ = {o for o in open_ if not set(best) <= set(o)}
    return chosen


def postings(prints: DataFrame, most_bits: int) -> DataFrame:
    """chosen, key, fp: each fingerprint under every posted set of positional bytes."""
    masks = [sum(0xFF << 8 * i for i in places) for places in posted_places(BYTES - most_bits)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    chosen = F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in signed])).alias("chosen", "mask")
    return prints.select("fp", chosen).select("chosen", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "mask")


def slices(fp, mask, most_bits: int):
    """(slice, value) keys of the bits outside mask: a pair differing in most_bits bits agrees in one of most_bits + 1 slices."""
    rest = fp.bitwiseAND(F.bitwise_not(mask))
    keys = []
    for k in range(most_bits + 1):
        bits = sum(1 << b for b in range(64) if b % (most_bits + 1) == k)
        bits = bits - 2**64 if bits >= 2**63 else bits
        keys.append(F.struct(F.lit(k + 1).alias("slice"), rest.bitwiseAND(F.lit(bits).cast("bigint")).alias("value")))
    return F.array(*keys)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the same components as the links a - b: each node with its component's smallest."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (jumped := new[new] != new).any():
            new[jumped] = new[new[jumped]]
        if (new == label).all():
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


def count_filter(differ: np.ndarray, most_bits: int) -> np.ndarray:
    """Which pairs, given by their exclusive or, share the positional bytes that a qualifying pair is sure to share."""
    return (np.ascontiguousarray(differ).view(np.uint8).reshape(-1, BYTES) == 0).sum(1) >= BYTES - most_bits


def near_pairs(fp: np.ndarray, list_id: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of the same posting list; rows are sorted by list. Walks distance after distance.

    Long lists are settled one by one: from a fingerprint on, those linked with it are reached and left out of later comparisons.
    """
    left, right = [], []
    starts = np.flatnonzero(np.concatenate(([True], list_id[1:] != list_id[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(fp)])))
    for start, size in zip(starts[sizes > WALK_LIST].tolist(), sizes[sizes > WALK_LIST].tolist()):
        a, b = reached(fp[start : start + size], most_bits)
        left.append(a)
        right.append(b)
    short = np.repeat(sizes <= WALK_LIST, sizes)
    fp, list_id, step = fp[short], list_id[short], 1
    at = np.arange(len(fp))
    while len(at := at[at + step < len(fp)]) and len(at := at[list_id[at] == list_id[at + step]]):
        differ = fp[at] ^ fp[at + step]
        tallied = np.flatnonzero(count_filter(differ, most_bits))
        near = at[tallied[np.bitwise_count(differ[tallied]) <= most_bits]]
        left.append(fp[near])
        right.append(fp[near + step])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def reached(fp: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links within the list connect."""
    left, right = [], []
    open_, frontier = fp[1:], [fp[0]]
    while len(open_):
        if not frontier:
            frontier, open_ = [open_[0]], open_[1:]
            continue
        here = frontier.pop()
        differ = open_ ^ here
        met = np.zeros(len(open_), bool)
        tallied = np.flatnonzero(count_filter(differ, most_bits))
        met[tallied[np.bitwise_count(differ[tallied]) <= most_bits]] = True
        if met.any():
            found = open_[met]
            left.append(np.full(len(found), here))
            right.append(found)
            frontier.extend(found)
            open_ = open_[~met]
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def links(prints: DataFrame, most_bits: int = 4) -> DataFrame:
    """a, b: links whose components are those of all pairs of fingerprints within most_bits bits. prints: distinct fp."""
    if not 0 <= most_bits < BYTES:
        raise ValueError("most_bits must leave a byte that both fingerprints share")
    posted = postings(prints, most_bits)
    whole = F.struct(F.lit(0).alias("slice"), F.lit(0).cast("bigint").alias("value"))
    long_lists = posted.groupBy("chosen", "key").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT_LIST)
    long_lists = materialize(long_lists.select("chosen", "key", F.lit(True).alias("long")), "long-lists")
    if long_lists.limit(1).count():
        dealt = posted.join(long_lists, ["chosen", "key"], "left")
        part = F.when(F.col("long"), slices(F.col("fp"), F.col("mask"), most_bits)).otherwise(F.array(whole))
        dealt = dealt.select("chosen", "key", "fp", F.explode(part).alias("part")).select("chosen", "key", "part.slice", "part.value", "fp")
    else:
        dealt = posted.select("chosen", "key", "fp", whole.alias("part")).select("chosen", "key", "part.slice", "part.value", "fp")
    keys = ["chosen", "slice", "key", "value"]
    long_slices = dealt.filter("slice > 0").groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT_LIST)
    long_slices = materialize(long_slices.select(*keys, F.ceil(F.col("n") / SPLIT_LIST).cast("int").alias("blocks")), "long-slices")
    if long_slices.limit(1).count():
        dealt = dealt.join(long_slices, keys, "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o))
        dealt = dealt.select(*keys, "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("block"))
    else:
        dealt = dealt.select(*keys, "fp", F.lit(0).alias("block"))
    keys.append("block")
    rows = dealt.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 6
        for batch in batches:
            kept = [np.concatenate((k, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64))) for i, k in enumerate(kept)]
            new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in kept[:5]], axis=0))) if len(kept[5]) else np.zeros(0, bool)
            last = int(np.flatnonzero(new)[-1]) if len(new) else 0  # the last list may go on in the next batch
            if last:
                yield from found(kept[5][:last], np.cumsum(new[:last]))
                kept = [k[last:] for k in kept]
        if len(kept[5]):
            yield from found(kept[5], np.zeros(len(kept[5]), np.int64))

    def found(fp: np.ndarray, list_id: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = near_pairs(fp.view(np.uint64), list_id, most_bits)
        if len(a):
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return rows.mapInArrow(linked, "a bigint, b bigint")


def first_row(tagged: bool):
    """What orders a group's rows: the smallest doc_id, null ids last, then the text's digest."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", (F.col("digest") if tagged else F.lit(None).cast("binary")).alias("digest"))


def reach_groups(prints: DataFrame, groups: DataFrame, roots: DataFrame, key: str, total: int) -> DataFrame:
    """prints with component_id, first (the digest of the component's first row) and rows (its number). groups: key, first, n; roots: node, root of linked keys."""
    member = groups.select(key, "first", "n").join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))
    member = materialize(member, "members")
    firsts = materialize(member.groupBy("root").agg(F.min("first").alias("whole"), F.count("*").alias("prints"), F.sum("n").alias("rows")), "component-ids")
    known = join_groups(member, firsts, ["root"], total, "prints", "inner").select(key, F.col("whole.doc_id").alias("component_id"), F.col("whole.digest").alias("first"), F.col("rows"), "n")
    return join_groups(prints, materialize(known, "fingerprint-components"), [key], total, "n", "inner").drop("n")


def decided(found: DataFrame) -> list:
    """digest, rows and kept of tagged rows."""
    return ["digest", "rows", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("first"))).alias("kept")]


def near_groups(docs: DataFrame, words: int = 4, most_bits: int = 4, tagged: bool = False) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, and if tagged digest (of the text), rows (of the component) and kept.

    Null texts count as empty; texts without words have the fingerprint zero and link like any other. component_id is the
    smallest doc_id that can be reached over links (null if all reached ids are null). kept is true for the component's row with
    the smallest doc_id, null ids last, of several such rows the one with the smallest digest, and for rows equal to it. Every
    row is returned, repeated ones too; an empty table gives an empty result; columns other than doc_id and text are not read.
    """
    prints = materialize(fingerprints(docs, words, tagged), "fingerprints")
    groups = materialize(prints.groupBy("fp").agg(F.min(first_row(tagged)).alias("first"), F.count("*").alias("n")), "fingerprint-groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = reach_groups(prints, groups, components(links(groups.select("fp"), most_bits)), "fp", total)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *(decided(found) if tagged else []))


def one_of_each_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs for each component of the tagged groups."""
    several = materialize(groups.filter("rows > 1").select("doc_id", "digest", "kept"), "near-decided")
    return keep_rows(docs, several.select("digest"), several.filter("kept").select("digest", "doc_id").distinct())


def one_of_each(docs: DataFrame, words: int = 5, most_bits: int = 4) -> DataFrame:
    """One row of docs for each component, that with the smallest doc_id (null ids last), with its columns."""
    return one_of_each_group(docs, near_groups(docs, words, most_bits, True))


# --- groups by similarity ------------------------------------------------------------------------

#: Bits in which fingerprints of sets differ at most that the SimHash index links. Alike sets may differ in more: they meet in lists.
MOST_BITS = 4
#: A text stands in BANDS lists, each under BAND_ROWS minima of its shingles' hashes. Two texts of similarity s share one list at
#: least with a probability of 1 - (1 - s**BAND_ROWS)**BANDS: all but three in a million at 0.8.
BANDS, BAND_ROWS = 32, 5
#: Odd multipliers and summands of the hashes whose minima are taken.
FACTORS, SUMMANDS = np.random.default_rng(20240611).integers(0, 2**63, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Of the BANDS * BAND_ROWS minima a text keeps a byte each, in place, in SIGNATURE numbers. Two texts of similarity 0.8 share 128 of
#: 160 in the mean, with a standard deviation of 5: fewer than this share of the mean are met once in some 50 million pairs.
SIGNATURE, LEAST_SHARE = BANDS * BAND_ROWS // 8, 0.78
#: Rows of a list that one task compares with as many others: a longer list is dealt out by pairs of blocks, without loss.
BLOCK = 500
#: A group with more members is described by what they differ in from what most of them have: its chief may have changes of its own.
LARGE_GROUP = 200
#: Shingles whose hashes are mixed at a time.
MIX_HASHES = 2000


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different shingles' hashes, ascending."""
    return np.unique(np.array(shingle_hashes(text or "", words), np.uint64))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED) - 2**63


def list_keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of the text's list in each band, and its signature: the low byte of every minimum, eight to a number."""
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), MIX_HASHES):
        least = np.minimum(least, (hashes[None, i : i + MIX_HASHES] * FACTORS + SUMMANDS).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for minimum in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ minimum) * FACTORS[0]
        key ^= key >> np.uint64(31)
    return key.view(np.int64), least.astype(np.uint8).view(np.int64)


def shared_bytes(a, b):
    """How many positional bytes the signatures in two columns share."""
    gather = lambda n: lambda x: x.bitwiseOR(F.shiftrightunsigned(x, n))
    bits = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    for n in (4, 2, 1):  # a byte's lowest bit gathers all its bits
        bits = F.transform(bits, gather(n))
    differing = F.aggregate(bits, F.lit(0), lambda n, x: n + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101).cast("bigint"))))
    return F.lit(8 * SIGNATURE) - differing


def set_prints(docs: DataFrame, words: int, tagged: bool = False) -> DataFrame:
    """doc_id, if tagged the text's digest, id (of the set of shingles), shingles (their number), fp (the set's SimHash), keys and marks (the signature) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("simhash")
        for batch in parts(batches):
            sets = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            found = [list_keys(h) for h in sets]
            keys, marks = (pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1))
            fps = pa.array(np.array(fold(sets), np.uint64).view(np.int64))
            columns = [*batch.columns[1:], pa.array([set_id(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), fps, keys, marks]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "id", "shingles", "fp", "keys", "marks"])

    return hashable(docs, tagged).mapInArrow(hashed, "doc_id bigint, " + ("digest binary, " if tagged else "") + "id bigint, shingles bigint, fp bigint, keys array<bigint>, marks array<bigint>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, hashes: the sets of shingles with an id of `wanted` (distinct id), each once. The others are hashed again but not moved."""
    bits, size = filter_bits(wanted, "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            ids = np.array([set_id(h) for h in sets], np.int64)
            at = ids & (size - 1)
            there = np.flatnonzero(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[there]), pa.array([sets[i].view(np.int64) for i in there], pa.list_(pa.int64()))], names=["id", "hashes"])

    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(hashed, "id bigint, hashes array<bigint>")
    return found.groupBy("id").agg(F.first("hashes").alias("hashes")).join(wanted, "id", "left_semi")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets of shingles have a Jaccard similarity of `similarity` or more."""
    pairs = materialize(pairs.distinct(), "pairs")
    total = pairs.count()
    met = pairs
    for side in ("a", "b"):
        own = pairs.groupBy(side).agg(F.count("*").alias("n")).join(sets.select(F.col("id").alias(side), F.col("hashes").alias(f"{side}_set")), side)
        met = join_groups(met, materialize(own, "pair-sets"), [side], total, "n", "inner").drop("n")
    both = F.size(F.array_intersect("a_set", "b_set"))
    return materialize(met.filter(both >= similarity * (F.size("a_set") + F.size("b_set") - both) - 1e-9).select("a", "b"), "alike")


def print_pairs(groups: DataFrame, most_bits: int) -> DataFrame:
    """id, shingles, end (id, shingles): pairs of groups (id, shingles, fp) that the SimHash index finds, one for each member of a fingerprint and each link."""
    chiefs = materialize(groups.groupBy("fp").agg(F.min(F.struct("id", "shingles")).alias("end"), F.count("*").alias("n")), "print-chiefs")
    total = chiefs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    same = join_groups(groups.select("id", "shingles", "fp"), chiefs.filter("n > 1"), ["fp"], total, "n", "inner").filter(F.col("id") != F.col("end.id"))
    near = links(chiefs.select("fp"), most_bits)
    a, b = (chiefs.select(F.col("fp").alias(c), F.col("end").alias(f"{c}_end")) for c in ("a", "b"))
    linked = near.join(a, "a").join(b, "b").select("a_end.*", F.col("b_end").alias("end"))
    return materialize(same.select("id", "shingles", "end").unionByName(linked), "print-pairs")


def ratio(similarity: float) -> tuple[int, int]:
    """similarity as a ratio of whole numbers, so that bounds are exact."""
    found = Fraction(round(similarity * 10**4), 10**4)
    if abs(found - similarity) > 1e-9 or not 0 < found < 1:
        raise ValueError("similarity must lie between 0 and 1 and have four decimals at most")
    return found.numerator, found.denominator


def frame_changes(raw: DataFrame) -> DataFrame | None:
    """around, n, gained, dropped: in what the frame of a large group differs from its chief, in shingles that over half of the group has gained or dropped."""
    kinds = F.explode(F.array(F.struct(F.lit(True).alias("new"), F.col("added").alias("own")), F.struct(F.lit(False).alias("new"), F.col("lost").alias("own"))))
    each = raw.filter(F.col("n") > LARGE_GROUP).select("around", "n", kinds.alias("kind")).select("around", "n", "kind.new", F.explode("kind.own").alias("shingle"))
    most = each.groupBy("around", "n", "new", "shingle").agg(F.count("*").alias("held")).filter(2 * F.col("held") > F.col("n"))
    gathered = lambda new: F.array_sort(F.collect_list(F.when(F.col("new") == new, F.col("shingle"))))
    changes = materialize(most.groupBy("around", "n").agg(gathered(True).alias("gained"), gathered(False).alias("dropped")), "frame-changes")
    return changes if changes.limit(1).count() else None


def differences(posts: DataFrame, chiefs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """What each of posts (around: its group, id, shingles, root) has unlike its group's frame: the chief, changed in large groups as most members are.

    excess: 0 or less if the set and the chief (pivot) are alike. central: the set is sure to be alike with the center, the member nearest to the
    frame. joined: the root after these links. outer: not central. first: those shingles unlike the frame of which an alike pair, not both
    central, shares one at least. size: all of them; over: by how much they pass the set's share of what an alike pair may differ in; reach: see below.

    Let x and y differ from the frame C in X and Y. They differ from each other in |X| + |Y| - 2 |X and Y| shingles, and are alike if that is at
    most (1 - s) / (1 + s) of |x| + |y|. Where |X| + |Y| is small enough they are alike for sure: the center has such a link, if any has. Other pairs
    need shingles in common in X and Y. With a common order of shingles, one of them stands among the first of either: in all but its least number
    of common ones, less one. Shingles that C hasn't come first: a text's own changes are rarely another's, what it lost of C often is. A pair that has
    none of the former in common needs a short y: 2 p |y| <= reach of x, and the reverse.
    """
    p, q = ratio(similarity)
    own = posts.groupBy("around").agg(F.count("*").alias("n")).join(chiefs, "around").select("around", "n", F.col("chief.id").alias("pivot"), F.col("chief.shingles").alias("pivot_shingles"))
    own = materialize(own.join(sets.select(F.col("id").alias("pivot"), F.col("hashes").alias("pivot_hashes")), "pivot"), "pivots")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    raw = join_groups(posts, own, ["around"], total, "n", "inner").filter("id <> pivot").join(sets, "id")
    raw = raw.withColumn("added", F.array_except("hashes", "pivot_hashes")).withColumn("lost", F.array_except("pivot_hashes", "hashes")).drop("hashes", "pivot_hashes")
    raw = raw.withColumn("excess", (p + q) * (F.size("added") + F.size("lost")).cast("bigint") - (q - p) * (F.col("shingles") + F.col("pivot_shingles")))
    raw = materialize(raw, "raw-differences")
    raw = raw.withColumn("frame", F.col("pivot_shingles")).withColumn("off", F.lit(0).cast("bigint"))  # off: shingles in which chief and frame differ
    if (changes := frame_changes(raw)) is not None:
        raw = join_groups(raw.drop("n"), changes, ["around"], total, "n")
        kept = lambda c: F.coalesce(c, F.array().cast("array<bigint>"))
        raw = raw.withColumn("gained", kept(F.col("gained"))).withColumn("dropped", kept(F.col("dropped"))).withColumn("was", F.col("added"))
        raw = raw.withColumn("added", F.concat(F.array_except("added", "gained"), F.array_except("dropped", "lost")))
        raw = raw.withColumn("lost", F.concat(F.array_except("lost", "dropped"), F.array_except("gained", "was")))
        raw = raw.withColumn("frame", F.col("frame") + F.size("gained") - F.size("dropped")).withColumn("off", (F.size("gained") + F.size("dropped")).cast("bigint"))
        raw = materialize(raw.drop("gained", "dropped", "was", "n"), "framed-differences")
    met = raw.withColumn("size", (F.size("added") + F.size("lost")).cast("bigint")).withColumn("over", (p + q) * F.col("size") - (q - p) * F.col("shingles"))
    chief = F.struct(((p + q) * F.col("off") - (q - p) * F.col("pivot_shingles")).alias("over"), F.col("pivot").alias("id"), F.col("around").alias("root"), F.lit(True).alias("bridge"))
    if changes is None:  # the chief is each group's frame and center
        met = met.withColumn("center", chief).withColumn("shortest", F.lit(0).cast("bigint"))
    else:
        member = F.struct("over", "id", "root", (F.col("excess") <= 0).alias("bridge"))
        centers = met.groupBy("around").agg(F.count("*").alias("n"), F.least(F.min(member), F.min(chief)).alias("center"), F.min("shingles").alias("shortest"))
        met = join_groups(met, materialize(centers, "centers"), ["around"], total, "n", "inner").drop("n")
    met = met.withColumn("central", F.col("over") + F.col("center.over") <= 0).withColumn("outer", ~F.col("central")).withColumn("reach", (p + q) * F.col("frame") - F.col("over"))
    joined = F.when(F.col("central") & ~F.col("center.bridge"), F.col("center.root")).when(F.col("central") | (F.col("excess") <= 0), F.col("around")).otherwise(F.col("root"))
    beyond = F.greatest(F.ceil((F.col("over") - (q - p) * F.col("frame")) / (2 * q)), F.ceil((F.col("over") + F.col("center.over")) / (2 * (p + q))))
    alone = F.floor((F.col("over") - F.col("center.over")) / (2 * (p + q))) + 1  # its partner is an outer one
    least = F.greatest(F.lit(1), F.when(F.col("outer"), beyond).otherwise(alone))
    short = (2 * p * F.col("shortest") <= F.col("reach")) & (2 * p * p * F.col("shingles") <= q * F.col("reach"))
    number = F.least(F.col("size") - least + 1, F.when(short, F.col("size")).otherwise(F.size("added")))
    first = F.slice(F.concat("added", "lost"), F.lit(1), F.greatest(F.lit(0), number).cast("int"))
    fields = ["around", "id", "shingles", "root", "pivot", "excess", F.col("center.id").alias("center"), "central", "outer", joined.alias("joined"), "size", "over", "reach", F.size("added").alias("own"), first.alias("first")]
    return materialize(met.select(*fields), "differences")


def differing_pairs(differ: DataFrame, similarity: float) -> DataFrame:
    """a, b: of each group (around) the pairs that are not joined yet and may be alike by what they have in common unlike the group's frame."""
    p, q = ratio(similarity)
    fields = ["id", "shingles", "root", "outer", "over", "reach"]
    posted = differ.select("id", "shingles", F.col("joined").alias("root"), "outer", "over", "reach", "size", "own", F.xxhash64("around").alias("around"), F.posexplode("first").alias("place", "shingle"))
    posted = posted.select(F.xxhash64("around", "shingle").alias("key"), *fields, (F.col("size") - F.col("place")).alias("left"), (F.col("place") >= F.col("own")).alias("loss"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("outer").alias("outer")).filter("n > 1 AND low <> high AND outer")
    shared = materialize(shared.select("key", "n"), "shared-differences")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = materialize(join_groups(posted, shared, ["key"], total, "n", "inner"), "differing")
    blocks = F.ceil(F.col("n") / BLOCK)
    own, each = F.pmod(F.xxhash64("id"), blocks), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    fields.append("left")
    one = kept.filter("outer").select("key", own.alias("block"), each.alias("other_block"), "loss", *fields)
    other = kept.select("key", each.alias("block"), own.alias("other_block"), *[F.col(c).alias(f"other_{c}") for c in fields])
    once = ~F.col("other_outer") | (F.col("id") < F.col("other_id"))
    common = F.col("over") + F.col("other_over") <= 2 * (p + q) * F.least("left", "other_left")
    short = ~F.col("loss") | ((2 * p * F.col("other_shingles") <= F.col("reach")) & (2 * p * F.col("shingles") <= F.col("other_reach")))
    able = q * F.least("shingles", "other_shingles") >= p * F.greatest("shingles", "other_shingles")
    met = one.join(other, ["key", "block", "other_block"]).filter((F.col("root") != F.col("other_root")) & once & common & short & able)
    return materialize(met.select(F.least("id", "other_id").alias("a"), F.greatest("id", "other_id").alias("b")).distinct(), "differing-pairs")


def similar_links(docs: DataFrame, groups: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b: links whose components are those of all pairs of groups (id, shingles, fp, keys) that are alike and share a list or are near by SimHash.

    Sets whose fingerprints differ in MOST_BITS bits at most are compared as the SimHash index links them. Every member of a list is compared with the one that stands in the longest lists and with the first, which connects large groups by
    few pairs. A list with members that aren't connected yet is handed to the group of its weightiest member, and the sets of all
    lists of that group are described by what they differ in from its chief, or from what most of a large group has: pairs that differ in too little of the same are left out
    without loss, the others tally the positional bytes of their signatures, and those that reach the minimum are compared.
    """
    able = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9  # noqa: E731  sets of other sizes can't be alike
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    posted = groups.select("id", "shingles", F.explode("keys").alias("key"))
    lists = materialize(posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "lists")
    total = lists.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    listed = materialize(join_groups(posted, lists, ["key"], total, "n", "inner"), "listed")
    # What stands in the longest lists lies in the middle of its group, and is alike with most of it.
    weights = materialize(listed.groupBy("id").agg(F.sum("n").alias("weight")), "weights")
    ends = listed.join(weights, "id").groupBy("key").agg(F.count("*").alias("n"), F.array(F.max(F.struct("weight", "id", "shingles")), F.min(F.struct(F.lit(0).cast("bigint").alias("weight"), "id", "shingles"))).alias("ends"))
    ends = materialize(ends, "ends")
    near = print_pairs(groups, MOST_BITS).filter(able(F.col("shingles"), F.col("end.shingles")))
    wanted = listed.select("id").unionByName(near.select("id")).unionByName(near.select("end.id")).distinct()
    sets = materialize(shingle_sets(docs, wanted, words), "shingle-sets")

    to_ends = join_groups(listed.drop("n"), ends, ["key"], total, "n", "inner").select("id", "shingles", F.explode("ends").alias("end")).filter(F.col("id") != F.col("end.id"))
    to_ends = to_ends.filter(able(F.col("shingles"), F.col("end.shingles"))).select(*pair("id", "end.id"))
    first = alike(near.select(*pair("id", "end.id")).unionByName(to_ends), sets, similarity)
    roots = materialize(components(first), "roots")
    labelled = listed.select("key", "id", "shingles").join(weights, "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    labelled = materialize(labelled, "labelled")
    apart = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("weight", "id", "root")).alias("top")).filter("low <> high")
    apart = materialize(apart.select("key", "n", F.col("top.root").alias("around")), "apart")
    posts = materialize(join_groups(labelled, apart, ["key"], total, "n", "inner").select("around", "id", "shingles", "root").distinct(), "posts")
    chiefs = labelled.groupBy("root").agg(F.max(F.struct("weight", "id", "shingles")).alias("chief")).select(F.col("root").alias("around"), "chief")
    differ = differences(posts, chiefs, sets, similarity)
    met = differing_pairs(differ, similarity).join(groups.select(F.col("id").alias("a"), F.col("marks").alias("a_marks")), "a").join(groups.select(F.col("id").alias("b"), F.col("marks").alias("b_marks")), "b")
    enough = shared_bytes("a_marks", "b_marks") >= int(LEAST_SHARE * similarity * 8 * SIGNATURE)
    rest = alike(met.filter(enough).select("a", "b"), sets, similarity)
    direct = differ.filter("excess <= 0 AND root <> around").select(*pair("id", "pivot")).unionByName(differ.filter("central AND id <> center").select(*pair("id", "center")))
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(direct).unionByName(rest)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, tagged: bool = False) -> DataFrame:
    """One row per document: doc_id, component_id: the smallest doc_id reached over links of the given similarity; if tagged as near_groups.

    The similarity of two texts is the Jaccard similarity of their sets of shingles. Nulls, empty texts, repeated rows and
    empty tables are treated as near_groups does.
    """
    prints = materialize(set_prints(docs, words, tagged), "set-prints")
    groups = prints.groupBy("id").agg(F.min(first_row(tagged)).alias("first"), F.count("*").alias("n"), F.first(F.struct("shingles", "fp", "keys", "marks")).alias("lists")).select("id", "first", "n", "lists.*")
    groups = materialize(groups, "set-groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = reach_groups(prints.drop("keys", "marks", "shingles", "fp"), groups, components(similar_links(docs, groups, words, similarity)), "id", total)
    return found.select("doc_id", "component_id", *(decided(found) if tagged else []))


def one_of_each_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each component, that with the smallest doc_id (null ids last), with its columns."""
    return one_of_each_group(docs, similar_groups(docs, words, similarity, True))
