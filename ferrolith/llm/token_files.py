"""Token ids of documents in files of byte or bit planes.

Documents are dealt by ranges of doc_id, so that each task holds a shard of neighbouring documents in order. It encodes them and
cuts the ids of the whole shard into blocks of a fixed number. A block is transposed - first all low bytes (or lowest bits), then
the next ones - and each plane is compressed with zstandard by itself. Under the folder lie `data`, a file of chunks for each shard, and `index`,
one row for each chunk: where its ids begin among all, how many there are and how long its planes are. A reader goes through a shard's
chunks in order and puts documents together again; a range of ids needs only the chunks that the index names.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrolith.llm.common import PART_ROWS, parts, take_worker

#: Ids in a chunk.
BLOCK_IDS = 65_536
#: Parts of texts that a worker remembers with their ids.
CACHE_PARTS = 800_000
#: Longer parts are not kept.
LONG_PART = 64
ZSTD_LEVEL = 3

CHUNK = "shard int, chunk int, n_ids int, width int, planes array<binary>, doc_ids array<bigint>, doc_tokens array<bigint>"


def to_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The planes of little-endian ids of `width` bytes each, lowest first, compressed."""
    import zstandard

    flat = np.ascontiguousarray(ids, f"<u{width}").view(np.uint8).reshape(len(ids), width)
    planes = np.packbits(np.unpackbits(flat, axis=1, bitorder="little").T, axis=1) if bits else np.ascontiguousarray(flat.T)
    packer = zstandard.ZstdCompressor(level=ZSTD_LEVEL, write_checksum=True)
    return [packer.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    """The ids again; whether planes are of bits or bytes shows in their number."""
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    bits = len(planes) == 8 * width and width > 0
    rows = [np.frombuffer(unpacker.decompress(p), np.uint8) for p in planes]
    if bits:
        flat = np.packbits(np.stack([np.unpackbits(r, count=n) for r in rows], axis=1), axis=1, bitorder="little")
    else:
        flat = np.stack(rows, axis=1)
    return np.ascontiguousarray(flat).view(f"<u{width}").reshape(n)


# Fixed value: how the supported files cut a normalised text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose kind is known here: printable ASCII in lower case, and the letters among U+00C0 to U+00FF in UTF-8.
_LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
PRINTABLE = re.compile(rb"[\x21-\x7e]+")
#: A text's parts: letters up to a word's end (most words, so they come first), whole words with any other character, and of all
#: other words their pre-tokens.
PARTS = re.compile(
    rb"[a-z]++(?=[.,;:!?]?(?:\s|\Z))|(?<!\S)(?:[\x21-\x7e]++|" + _LATIN + rb")*+[^\x21-\x7e\s]\S*+"
    rb"|'s|'t|'re|'ve|'m|'ll|'d|[a-z]*+(?:" + _LATIN + rb"[a-z]*+)++|[a-z]++|[0-9]|[\x21-\x2f\x3a-\x60\x7b-\x7e]++"
)


class Generations:
    """A bounded cache in two halves: when the young one is full, the old one is forgotten."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set[bytes]) -> list[bytes]:
        """The keys that are unknown; known ones of the old half become young again."""
        out = []
        for k in keys.difference(self.young):
            if (hit := self.old.get(k)) is not None:
                self.young[k] = hit
            else:
                out.append(k)
        return out

    def shrink(self) -> None:
        if len(self.young) > self.size // 2:
            self.old, self.young = self.young, {}


class WordEncoder:
    """Ids of whole texts from a tokenizers file, part by part.

    Files with PRE_TOKENS in lower case never join across white space, and case of ASCII letters is nothing to them: texts are cut
    into PARTS, and each part's ids are remembered. New pre-tokens of ASCII go to the library's model, other parts through the
    whole library, and so do whole texts that may hold a special token. With other files all whole texts do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal = (spec["normalizer"] or {}).get("normalizers", [])
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = {"type": "Split", "pattern": {"Regex": PRE_TOKENS}, "behavior": "Removed", "invert": True}
        own = [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0] == split and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"]
        self.marks = [t["content"].encode() for t in spec["added_tokens"]]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"].startswith("<|") for t in spec["added_tokens"])
        self.by_word = own and plain and not any(len(m.split()) != 1 for m in self.marks)
        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.known = Generations(CACHE_PARTS)

    def _asked(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: list[bytes]) -> None:
        other, known, width, tokenize = [], self.known.young, self.width, self.library.model.tokenize
        for p in missing:
            if PRINTABLE.fullmatch(p):
                known[p] = b"".join([t.id.to_bytes(width, "little") for t in tokenize(p.decode())])
            else:
                other.append(p)
        for i in range(0, len(other), 10_000):
            part = other[i : i + 10_000]
            known.update(zip(part, self._asked([p.decode() for p in part])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Of each text its ids as little-endian bytes, `width` for each id."""
        whole = [i for i, t in enumerate(texts) if not self.by_word or b"<|" in t]
        asked = dict(zip(whole, self._asked([texts[i].decode() for i in whole])))
        cut = [() if i in asked else PARTS.findall(t.lower()) for i, t in enumerate(texts)]
        missing = self.known.missing(set().union(*cut))
        self._learn(missing)
        known = self.known.young
        out = [asked[i] if i in asked else b"".join(map(known.__getitem__, c)) for i, c in enumerate(cut)]
        for p in missing:
            if len(p) > LONG_PART:
                del known[p]
        self.known.shrink()
        return out


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, kept from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    return WordEncoder(path)


#: Texts are encoded together up to so many bytes.
GROUP_BYTES = 4_000_000


def _grouped(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    group, size = [], 0
    for row in rows:
        group.append(row)
        size += len(row[1])
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _chunk_batch(shard: int, chunks: list[tuple]) -> pa.RecordBatch:
    numbers, counts, widths, planes, ids, tokens = zip(*chunks)
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    columns = [[shard] * len(chunks), numbers, counts, widths, planes, ids, tokens]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["shard", "chunk", "n_ids", "width", "planes", "doc_ids", "doc_tokens"])


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, block_ids: int = BLOCK_IDS, bits: bool = False) -> None:
    """Encode every whole text of docs (null: empty), put end_id behind each document, and write all ids in ascending doc_id order.

    Null doc_ids come first; rows with one doc_id are in the order of their texts' hashes. Repeated rows are written each, in
    any order as they don't differ. Columns other than doc_id and text are not read. An empty table writes files without chunks.
    Special tokens are not added; their strings in a text are encoded as the library does by default.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A number of the row itself, so that rows that share doc_id and text are still dealt to several tasks.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("token files", word_encoder.cache_clear)
        encoder, shard = word_encoder(tokenizer_path), TaskContext.get().partitionId()
        width = encoder.width if end_id < 1 << (8 * encoder.width) else 4
        end = end_id.to_bytes(width, "little")
        size, rest, chunk, ids, tokens = block_ids * width, bytearray(), 0, [], []
        texts = ((d, t) for batch in parts(batches) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
        for group in _grouped(texts):
            done = []
            for (doc_id, _), own in zip(group, encoder.encode([t for _, t in group])):
                if width != encoder.width:
                    own = np.frombuffer(own, f"<u{encoder.width}").astype(f"<u{width}").tobytes()
                ids.append(doc_id)  # a document stands in the chunk in which it begins
                tokens.append(len(own) // width + 1)
                rest += own
                rest += end
                while len(rest) >= size:
                    block = np.frombuffer(bytes(rest[:size]), f"<u{width}")
                    done.append((chunk, block_ids, width, to_planes(block, width, bits), ids, tokens))
                    del rest[:size]
                    chunk, ids, tokens = chunk + 1, [], []
            if done:
                yield _chunk_batch(shard, done)
        if rest:
            yield _chunk_batch(shard, [(chunk, len(rest) // width, width, to_planes(np.frombuffer(bytes(rest), f"<u{width}"), width, bits), ids, tokens)])

    # Planes are compressed already; a file holds a shard in order.
    ordered.mapInArrow(encoded, CHUNK).write.option("compression", "none").option("maxRecordsPerFile", 0).parquet(f"{path}/data")
    chunks = spark.read.schema(CHUNK).parquet(f"{path}/data").select("shard", "chunk", "n_ids", "width", F.size("doc_ids").alias("n_docs"), F.transform("planes", lambda p: F.length(p)).alias("plane_bytes"))
    # A number for each shard, so for each task of the writing: their prefix sums are taken on the driver.
    totals = sorted((r.shard, r.n) for r in chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    begins = itertools.accumulate((n for _, n in totals), initial=0)
    bases = spark.createDataFrame([(s, b) for (s, _), b in zip(totals, begins)], "shard int, base bigint")
    before = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    index = chunks.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.coalesce(before, F.lit(0)))  # a row for each shard
    index.select("shard", "chunk", "start", "n_ids", "n_docs", "width", "plane_bytes").write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """shard, chunk, start (ids before the chunk), n_ids, n_docs (documents that begin in it), width, plane_bytes."""
    return spark.read.parquet(f"{path}/index")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit integers) of every document.

    Shards are spread over tasks; within a task, chunks come in order and only the document that is being put together is held.
    """
    firsts = read_index(spark, path).filter("chunk = 0").select("shard", F.col("start").alias("base"))
    chunks = spark.read.schema(CHUNK).parquet(f"{path}/data").join(F.broadcast(firsts), "shard")  # a row for each shard
    ordered = chunks.repartitionByRange("shard").sortWithinPartitions("shard", "chunk")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("token files", word_encoder.cache_clear)
        waiting: list[tuple[int | None, int]] = []  # documents that have begun, in order
        have, start, shard = bytearray(), 0, None
        for batch in parts(batches, 16):
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    if waiting or have:
                        raise ValueError(f"shard {shard}: ids and documents don't match")
                    shard, start = r["shard"], r["base"]
                waiting += zip(r["doc_ids"], r["doc_tokens"])
                have += from_planes(r["planes"], r["n_ids"], r["width"]).astype("<u4").tobytes()
                done, at = [], 0
                for doc_id, n in waiting:
                    if len(have) - at < 4 * n:
                        break
                    done.append((doc_id, start, n, bytes(have[at : at + 4 * n])))
                    at, start = at + 4 * n, start + n
                del have[:at], waiting[: len(done)]
                for i in range(0, len(done), PART_ROWS):
                    columns = list(zip(*done[i : i + PART_ROWS]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])
        if waiting or have:
            raise ValueError(f"shard {shard}: ids and documents don't match")

    return ordered.mapInArrow(put_together, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_ids(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """start and ids (array of bigint) of the pieces that make up the ids numbered first to last - 1. Only the chunks that hold some are read."""
    index = read_index(spark, path).filter((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first)).select("shard", "chunk", "start")
    wanted = index.collect()  # the chunks of one range, which its reader holds anyway
    if not wanted:
        return spark.createDataFrame([], "start bigint, ids array<bigint>")
    where = F.col("shard").isin(sorted({r.shard for r in wanted})) & F.col("chunk").between(min(r.chunk for r in wanted), max(r.chunk for r in wanted))
    met = spark.read.schema(CHUNK).parquet(f"{path}/data").filter(where).join(F.broadcast(spark.createDataFrame(wanted, "shard int, chunk int, start bigint")), ["shard", "chunk"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 16):
            for r in batch.to_pylist():
                a, b = max(first - r["start"], 0), min(last - r["start"], r["n_ids"])
                own = from_planes(r["planes"], r["n_ids"], r["width"])[a:b].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["start"] + a]), pa.array([own], pa.list_(pa.int64()))], names=["start", "ids"])

    return met.mapInArrow(cut, "start bigint, ids array<bigint>")
