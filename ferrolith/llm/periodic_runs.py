"""Runs of periodic repetition in word sequences, by Main-Lorentz divide and conquer on interned word ids.

The words of many documents lie in one array, with a separator between documents that equals nothing. Segments of 16, 32, ...
words are halved at their midpoints. Every maximal run lies whole in the smallest such segment that holds it, crosses its
midpoint, and has at least one period on one side of it; so the Z values of the midpoint - how far the words behind and before
it equal those at each shift - give its ends. A level's Z values are taken for all midpoints and shifts at once: few shifts
agree in three words, and these are followed to the segment's ends. Midpoints with many agreeing shifts get their Z-functions in
linear time instead, so that no text is worse than n log n. Runs cut by a segment's end are left to the larger segment;
intervals found with several periods keep the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.common import parts, take_worker

#: A run has at least so many words and two periods.
LEAST_LENGTH = 12
#: Midpoints with more agreeing shifts than this get whole Z-functions.
MANY_SHIFTS = 32
#: Words that are compared one by one for all candidates together, before each is followed alone.
STEPS = 8
#: Documents are searched together up to so many words; a longer one is searched alone.
GROUP_WORDS = 200_000


def z_function(s: list[int]) -> list[int]:
    """z[i]: how many words from i on equal the first ones; z[0] is the length."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _by_z_functions(words: list[int], most: int) -> tuple[list[int], list[int], list[int]]:
    """(start, end, period) of all repetitions that cross the midpoint of a segment, each cut at the segment's ends."""
    half = len(words) // 2
    behind, before = words[half:], words[half - 1 :: -1]
    forward, backward = z_function(behind), z_function(before)
    at_shift, before_shift = z_function([*behind, -1, *words]), z_function([*before, -1, *words[::-1]])
    starts, ends, periods = [], [], []
    for p in range(1, most + 1):
        a, b = forward[p] if p < half else 0, before_shift[2 * half + 1 - p]
        if a + b >= p:
            starts.append(half - b)
            ends.append(half + p + a)
            periods.append(p)
        a, b = at_shift[2 * half + 1 - p], backward[p] if p < half else 0
        if a + b >= p:
            starts.append(half - p - b)
            ends.append(half + a)
            periods.append(p)
    return starts, ends, periods


def _steps(s: np.ndarray, x: np.ndarray, p: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
    """Of how many neighbouring places from x on (way 1) or back (way -1) the words equal those p places on, up to STEPS and room."""
    d = np.arange(STEPS)
    at = x[:, None] + way * d
    inside = d < room[:, None]
    at = np.where(inside, at, 0)
    same = inside & (s[at] == s[at + p[:, None]])
    return np.where(same.all(axis=1), STEPS, same.argmin(axis=1))


def _follow(s: np.ndarray, x: int, p: int, done: int, room: int, way: int) -> int:
    """The same without an end, but for room; done places are known to be equal. Steps double, so the work is in what is equal."""
    step = 64
    while done < room:
        n = min(step, room - done)
        a = x + done if way > 0 else x - done - n + 1
        differ = s[a : a + n] != s[a + p : a + p + n]
        if differ.any():
            return done + int(differ.argmax() if way > 0 else differ[::-1].argmax())
        done += n
        step *= 2
    return done


def _crossing(s: np.ndarray, size: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repetitions that cross the midpoints of all segments of a size, cut at their segments' ends: start, end, period."""
    half, rows = size // 2, s.reshape(-1, size)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    hot: set[int] = set()
    # right: words from the midpoint m on against those from m + p on; otherwise words from m - p on against those from m on.
    for right in (True, False):
        keys = []
        for way in (1, -1):  # a run has six equal places around the midpoint or more, so three on one side
            d = 0 if way > 0 else -1
            k = most if right == (way < 0) else min(most, half - 1)
            other = rows[:, half + d + 1 : half + d + 1 + k] if right else rows[:, half + d - k : half + d][:, ::-1]
            r, c = np.nonzero(other == rows[:, half + d, None])
            p = c + 1
            x = r * size + half - (0 if right else p)
            room = half - p if right == (way > 0) else np.full(len(p), half)
            for step in (1, 2):
                alive = room > step
                r, x, p, room = r[alive], x[alive], p[alive], room[alive]
                at = x + step if way > 0 else x - 1 - step
                same = s[at] == s[at + p]
                r, x, p, room = r[same], x[same], p[same], room[same]
            keys.append(r * (most + 1) + p)
        key = np.unique(np.concatenate(keys))
        r, p = key // (most + 1), key % (most + 1)
        many = np.bincount(r, minlength=len(rows)) > MANY_SHIFTS
        hot.update(np.flatnonzero(many).tolist())
        p, x = p[~many[r]], (r * size + half - (0 if right else p))[~many[r]]
        if not len(p):
            continue
        ahead, back = (half - p, np.full(len(p), half)) if right else (np.full(len(p), half), half - p)
        a, b = _steps(s, x, p, ahead, 1), _steps(s, x - 1, p, back, -1)
        maybe = (a == STEPS) | (b == STEPS) | (a + b >= np.maximum(LEAST_LENGTH - p, p))
        x, p, a, b, ahead, back = (v[maybe] for v in (x, p, a, b, ahead, back))
        for i in np.flatnonzero(a == STEPS):
            a[i] = _follow(s, int(x[i]), int(p[i]), STEPS, int(ahead[i]), 1)
        for i in np.flatnonzero(b == STEPS):
            b[i] = _follow(s, int(x[i]) - 1, int(p[i]), STEPS, int(back[i]), -1)
        found.append((x - b, x + p + a, p))
    for r in hot:
        starts, ends, periods = (np.array(v, np.int64) for v in _by_z_functions(rows[r].tolist(), most))
        found.append((starts + r * size, ends + r * size, periods))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(v) for v in zip(*found))


def find_runs(s: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs in an array of word ids >= 0, by start, then period.

    Separators between documents are negative and all different, -1 is not used; longest: words of the longest document. A run is a
    stretch of neighbouring words with smallest period p and at least max(LEAST_LENGTH, 2 p) words that no neighbour extends.
    """
    n, found = len(s), []
    if longest >= LEAST_LENGTH:
        top = max(16, 1 << (n - 1).bit_length())
        # Beyond the end nothing is equal to anything either.
        padded = np.concatenate([s, np.iinfo(s.dtype).min + 1 + np.arange(top - n + 1, dtype=s.dtype)])
        size = 16
        while size <= top:
            start, end, period = _crossing(padded[: -(-n // size) * size], size, min(size // 2, longest // 2))
            long = end - start >= np.maximum(LEAST_LENGTH, 2 * period)
            start, end, period = start[long], end[long], period[long]
            whole = ((start == 0) | (padded[start - 1] != padded[start - 1 + period])) & (padded[end] != padded[end - period])
            found.append(np.stack([start[whole], end[whole] - start[whole], period[whole]], axis=1))
            size *= 2
    if not found or not sum(map(len, found)):
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Of n words, those in no run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def search(texts: list[bytes]) -> list[tuple[np.ndarray, bytes]]:
    """Of each text the runs (start, length, period in words) and the words that stay, joined by spaces.

    Words are what stands between blanks (space, tab, line feed, vertical tab, form feed, carriage return).
    """
    ids: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    s = np.empty(begins[-1], np.int32)
    for k, words in enumerate(split):
        s[begins[k] : begins[k + 1] - 1] = [ids.setdefault(w, len(ids)) for w in words]
        s[begins[k + 1] - 1] = -2 - k
    runs = find_runs(s, int(lengths.max(initial=0)))
    cuts = np.searchsorted(runs[:, 0], begins)
    out = []
    for k, words in enumerate(split):
        own = runs[cuts[k] : cuts[k + 1]] - np.array([begins[k], 0, 0])
        if len(own):
            stay = kept_words(len(words), own)
            words = [w for w, keep in zip(words, stay.tolist()) if keep]
        out.append((own, b" ".join(words)))
    return out


def _grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in groups of about GROUP_WORDS words at most, by their bytes: a word has two with its blank."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > 6 * GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs (an array of start, length, period in words, by start, then period) and collapsed.

    collapsed is the text with all words of a run behind its first period dropped, words joined by one space. Whole texts are
    searched, null ones count as empty: no words, no runs, an empty text. Every row is searched, repeated ones too. Columns other than
    doc_id and text are not read. Empty tables give an empty result.
    """

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("periodic runs")
        for batch in parts(batches):
            done = 0
            for group in _grouped(batch.column("text").to_pylist()):
                found = search(group)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r, _ in found])]).astype(np.int32)
                flat = np.concatenate([r for r, _ in found])
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(RUN)))
                texts = pa.array([t for _, t in found], pa.binary())
                collapsed = pa.StringArray.from_buffers(len(texts), texts.buffers()[1], texts.buffers()[2])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(group)), runs, collapsed], names=["doc_id", "runs", "collapsed"])
                done += len(group)

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return chosen.mapInArrow(searched, "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
