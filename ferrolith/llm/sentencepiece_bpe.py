"""SentencePiece encoding and decoding with merge-type (BPE) vocabularies.

Text is cut where no piece of the vocabulary can reach across, and every cut-out segment is merged by an agenda of
adjacent symbol pairs ordered by score, leftmost first among equals. The agenda's ids are the result; each Arrow batch's new
segments are checked against the sentencepiece library, one in CHECK_EVERY by its hash, and so is one whole text. What differs
takes the library's ids and is counted. Known segments come from a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.common import parts, take_worker

SPACE = "▁"
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
#: Segments that a worker remembers; beyond it the older half is forgotten.
CACHE_SEGMENTS = 300_000
#: One in so many new segments is checked, and of each group of texts one of at most so many characters.
CHECK_EVERY, CHECK_CHARS = 4, 2_000
#: Longer segments are not kept, and use a heap for their agenda.
LONG_SEGMENT = 64
NO_MERGE = 1 << 60


class BpeModel:
    """A merge-type model file, read with the library's own format."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with identity normalisation and a leading space are supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL]
        order = {s: k for k, s in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        self.ids = {piece: i for piece, i, _ in normal}
        self.ranks = {piece: order[s] for piece, _, s in normal if len(piece) > 1}
        self.pieces = {i: piece for piece, i, _ in normal}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_values = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.pattern = self._segments([piece for piece, _, _ in normal])
        #: A character that no longer piece holds; it shields a segment when the library is asked.
        self.shield = "\n" if not any("\n" in piece for piece in self.ranks) else None
        self.shield_ids = len(self.library.encode(self.shield)) if self.shield else 0

    @staticmethod
    def _segments(pieces: list[str]) -> re.Pattern:
        """Cuts before spaces after other characters, and between word and other characters if no piece joins these."""
        pairs = {a + b for p in pieces for a, b in zip(p, p[1:])}
        if any(b == SPACE and a != SPACE for a, b in pairs):
            return re.compile("(?s).+")
        pairs = {x for x in pairs if SPACE not in x}
        others: set[str] = set()  # word characters that pieces join with others
        word = lambda c: c not in others and re.match(r"\w", c) is not None
        while crossing := {c for x in pairs if word(x[0]) != word(x[1]) for c in x if word(c)}:
            others |= crossing
        if not all(word(c) for c in "etaoin"):
            return re.compile(" *[^ ]+| +")
        held = "".join(map(re.escape, sorted(others)))
        return re.compile(rf" *(?:[^\W{held}]+|[^\w ]+(?:[^\w ]|[{held}])*|[{held}](?:[^\w ]|[{held}])*)| +" if held else r" *(?:\w+|[^\w ]+)| +")

    def merge(self, segment: str) -> list[str]:
        """The segment's symbols after all merges."""
        if len(segment) > LONG_SEGMENT:
            return self._merge_long(segment)
        symbols, rank = list(segment), self.ranks.get
        agenda = [rank(a + b, NO_MERGE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NO_MERGE:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            agenda.pop(i)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], NO_MERGE)
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], NO_MERGE)
        return symbols

    def _merge_long(self, segment: str) -> list[str]:
        """The same with a heap and linked neighbours: O(n log n)."""
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n:
                pair = symbols[left] + symbols[right]
                if (rank := self.ranks.get(pair)) is not None:
                    heap.append((rank, left, pair)) if not started else heapq.heappush(heap, (rank, left, pair))

        started = False
        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(heap)
        started = True
        while heap:
            _, left, pair = heapq.heappop(heap)
            if symbols[left] is None or (right := after[left]) >= n or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s is not None]

    def segment_ids(self, segment: str) -> list[int]:
        ids: list[int] = []
        for symbol in self.merge(segment.replace(" ", SPACE)):
            if (i := self.ids.get(symbol)) is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in symbol.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def segments(self, text: str) -> list[str]:
        """The text's segments with plain spaces: most are ASCII then, and take half the memory of those with the pieces' own sign."""
        return self.pattern.findall(" " + text.replace(SPACE, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.segment_ids(s)]

    def decode_raw(self, ids: list[int]) -> str:
        """Pieces and byte runs put together, spaces restored, the leading space still there."""
        out = b"".join(bytes((self.byte_values[i],)) if i in self.byte_values else self.pieces[i].encode() if i in self.pieces else " ⁇ ".encode() for i in ids)
        return out.decode("utf-8", errors="replace").replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        text = self.decode_raw(ids)
        return text[1:] if text.startswith(" ") else text

    def asked(self, segments: list[str]) -> list[list[int]]:
        """The library's ids of segments: each stands after the shield, whose ids are cut off."""
        if self.shield is None:
            found = self.library.encode([s[1:] if s.startswith((" ", SPACE)) else s for s in segments], num_threads=1)
            return [list(x) for x in found]
        return [list(x[self.shield_ids :]) for x in self.library.encode([self.shield + s for s in segments], num_threads=1)]


@lru_cache(maxsize=2)
def load_model(path: str) -> BpeModel:
    return BpeModel(path)


class SegmentCache:
    """segment -> ids joined by commas, in two generations of bounded size.

    A segment's decoded text is the segment with its spaces back, but for the few in `odd`.
    """

    def __init__(self, model: BpeModel):
        self.model, self.young, self.old, self.odd = model, {}, {}, {}
        #: Segments in whose check agenda and library disagreed; they have the library's ids.
        self.unlike: set[str] = set()

    def learn(self, missing: list[str]) -> None:
        found = {s: self.model.segment_ids(s) for s in missing}
        sample = [s for s in missing if zlib.crc32(s.encode()) % CHECK_EVERY == 0]
        for s, theirs in zip(sample, self.model.asked(sample)):
            if found[s] != theirs:
                self.unlike.add(s)
                found[s] = theirs
        for s, ids in found.items():
            self.young[s] = ",".join(map(str, ids))
            if (raw := self.model.decode_raw(ids)) != s.replace(SPACE, " "):
                self.odd[s] = raw

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        """Of each text the number of ids, the ids joined by commas, the decoded text, and how many of its checks failed.

        One short text of the batch is checked as a whole, so that a wrong cut is seen as well.
        """
        split = [self.model.segments(t) for t in texts]
        young, old, odd, missing = self.young, self.old, self.odd, {}
        for segments in split:
            for s in segments:
                if s not in young:
                    if (hit := old.get(s)) is not None:
                        young[s] = hit
                    else:
                        missing[s] = None
        if missing:
            self.learn(list(missing))
        out = []
        whole = next((i for i, t in enumerate(texts) if 0 < len(t) <= CHECK_CHARS), None)
        for i, segments in enumerate(split):
            failed = len(self.unlike.intersection(segments)) if self.unlike else 0
            ids = ",".join(map(young.__getitem__, segments))
            if odd and not odd.keys().isdisjoint(segments):
                raw = "".join([odd[s] if s in odd else s.replace(SPACE, " ") for s in segments])
            else:
                raw = "".join(segments).replace(SPACE, " ")
            text = raw[1:] if raw.startswith(" ") else raw
            if i == whole and (theirs := ",".join(map(str, self.model.library.encode(texts[i])))) != ids:
                failed, ids, text = failed + 1, theirs, self.model.library.decode(self.model.library.encode(texts[i]))
            out.append((ids.count(",") + 1 if ids else 0, ids, text, failed))
        for s in missing:
            if len(s) > LONG_SEGMENT:
                del young[s]
                odd.pop(s, None)
        if len(young) > CACHE_SEGMENTS // 2:
            self.old, self.young = young, {}
            self.odd = {s: raw for s, raw in odd.items() if s in young}
        return out


@lru_cache(maxsize=2)
def segment_cache(path: str) -> SegmentCache:
    """One for each Python worker, kept from task to task."""
    return SegmentCache(load_model(path))


#: Texts are taken in groups of about this many characters, so that a batch of long texts stays small.
GROUP_CHARS = 250_000


def grouped(texts: list[str]) -> Iterator[list[str]]:
    group, chars = [], 0
    for t in texts:
        group.append(t)
        chars += len(t)
        if chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, failed_checks (0 where agenda and library agree), and with with_ids also ids and decoded.

    Whole texts are encoded without begin and end ids; null texts count as empty, which have no ids and decode to an
    empty text. Every row is encoded, repeated ones too. Columns other than doc_id and text are not read. Empty tables
    give an empty result.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("sentencepiece", segment_cache.cache_clear)
        cache = segment_cache(model_path)
        for batch in parts(batches):
            rows: list[tuple] = []
            for group in grouped(batch.column("text").to_pylist()):
                for n, ids, text, failed in cache.encode_batch(group):
                    row = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), failed)
                    rows.append((*row, [int(i) for i in ids.split(",")] if ids else [], text) if with_ids else row)
            columns = list(zip(*rows)) or [()] * (6 if with_ids else 4)
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.string()]
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "failed_checks", "ids", "decoded"]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *names[: len(arrays)]])

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    more = ", ids array<int>, decoded string" if with_ids else ""
    return chosen.mapInArrow(encoded, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, failed_checks bigint" + more)
