"""Toxicity by maximum-scoring segments of token log-odds.

Tokens score by the log-odds of standing in a toxic document, under Dirichlet priors drawn from the pooled counts. A
linear-time scan finds every maximal-scoring segment of a text; each segment's score has an extreme-value (Karlin-Altschul)
expectation in clean text of that length, and a document's evidence, summed over its segments, is turned into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.common import give_back, materialize, parts, take_worker

WORD = re.compile(r"[^\W\d_]+")
#: The classifier is fitted on about this many labelled rows at most, drawn by a hash of doc_id.
TRAIN_ROWS = 24_000
#: Rows are calibrated in FOLDS parts, each scored by the tokens of the others alone.
FOLDS = 5
#: Tokens that the model keeps, those with the largest z-scores.
MODEL_TOKENS = 50_000
#: Besides whole words, their beginnings of these lengths are tokens, so that inflected and compounded forms count.
STEM_LENGTHS = (4, 5, 6)
#: The Dirichlet prior of a token: LEAST_PRIOR plus its pooled share of PRIOR_DOCS documents. DRIFT lowers each log-odds.
LEAST_PRIOR, PRIOR_DOCS, DRIFT = 0.5, 2.0, 0.7
#: A token whose log-odds is fewer standard deviations from zero scores 0 before DRIFT.
LEAST_Z = 2.6
#: predicted is 1 from this score on.
THRESHOLD = 0.3
#: Words whose scores a model remembers; a fold's model serves few rows, and forgets them after each batch.
CACHED_WORDS = 100_000
#: Rows that a task takes together.
COUNT_ROWS = 500


def pieces(word: str) -> set[str]:
    return {word} | {word[:n] + "*" for n in STEM_LENGTHS if len(word) >= n}


@dataclass
class ToxicityModel:
    scores: dict[str, tuple[float, float]]  # token -> (log-odds, z)
    decay: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # its K
    weights: tuple[float, float, float] = (-3.0, 1.0, 0.0)  # of 1, evidence, and the best segment's evidence
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def word_score(self, word: str) -> float:
        """Of the word and its stems, the token with the largest z-score decides."""
        known = [self.scores[p] for p in pieces(word) if p in self.scores]
        return (max(known, key=lambda x: abs(x[1]))[0] if known else 0.0) - DRIFT

    def token_scores(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = self.word_score(w)
        found = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        if len(cache) > CACHED_WORDS:
            cache.clear()
        return found

    def segment_evidence(self, score: float, n_tokens: int) -> float:
        """-log10 of the probability that clean text of this length holds a segment with such a score."""
        expected = self.scale * max(n_tokens, 1) * math.exp(-min(self.decay * score, 700.0))
        return max(0.0, -math.log10(-math.expm1(-expected))) if expected > 1e-300 else 300.0

    def features(self, text: str) -> tuple[float, float, int, float]:
        """Summed evidence, the best segment's, the number of significant segments, and the best segment's score."""
        scores = self.token_scores(text)
        total = best = top = 0.0
        significant = 0
        for start, end, score in maximal_segments(scores):
            evidence = self.segment_evidence(score, len(scores))
            total, best, top = total + evidence, max(best, evidence), max(top, score)
            significant += evidence >= 2.0
        return total, best, significant, top

    def probability(self, text: str) -> tuple[float, int]:
        total, best, significant, _ = self.features(text)
        a, b, c = self.weights
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, a + b * math.log1p(total) + c * math.log1p(best))))), significant


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in linear time, left to right.

    Only runs of positive scores can begin or end one, so the scan steps from run to run. Each candidate keeps the running
    sums before and after it; a new one joins those before it while that lengthens them with gain.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    starts = positive[np.concatenate(([True], np.diff(positive) > 1))]
    ends = positive[np.concatenate((np.diff(positive) > 1, [True]))] + 1
    stack: list[list] = []  # start, end, sum before, sum after, index of the nearest earlier one with a smaller sum before
    for start, end, low, high in zip(starts.tolist(), ends.tolist(), sums[starts].tolist(), sums[ends].tolist()):
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append([start, end, low, high, j])
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, hi - lo) for s, e, lo, hi, _ in stack]


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic and fold of labelled rows that aren't held out, about `most` of them, chosen by a hash of doc_id.

    A document labelled twice counts as toxic if any label says so; null labels and null doc_ids are left out. Equal texts
    of one class would lend their words false weight, so that the one with the smallest doc_id is taken.
    """
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    marks = marks.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most / max(marks.count(), 1))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(2**20))
    marks = marks.filter(draw < int(share * 2**20)).withColumn("fold", F.pmod(draw, F.lit(FOLDS)).cast("int"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(marks), "doc_id")  # marks: about `most` rows of two numbers
    once = found.groupBy(F.sha2("text", 256).alias("digest"), "toxic").agg(F.min(F.struct("doc_id", "fold", "text")).alias("row"))
    return once.select("row.text", "toxic", "row.fold")


def count_tokens(rows: DataFrame) -> DataFrame:
    """token, fold, n_clean, n_toxic: documents of each class that hold the token; counted per task, then summed."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("toxicity")
        for batch in parts(batches, COUNT_ROWS):
            counts: dict[tuple[str, int], list[int]] = {}
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                for token in {p for w in set(WORD.findall(text.lower())) for p in pieces(w)}:
                    counts.setdefault((token, fold), [0, 0])[1 if toxic else 0] += 1
            columns = [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))], names=["token", "fold", "n_clean", "n_toxic"])

    return rows.mapInArrow(counted, "token string, fold int, n_clean bigint, n_toxic bigint").groupBy("token", "fold").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_toxic").alias("n_toxic"))


def token_log_odds(counts: DataFrame, clean_docs: int, toxic_docs: int, most: int = MODEL_TOKENS) -> dict[str, tuple[float, float]]:
    """The `most` tokens with the largest absolute z-scores of the log-odds under an informative Dirichlet prior."""
    share = (F.col("n_clean") + F.col("n_toxic")) / F.lit(float(max(clean_docs + toxic_docs, 1)))
    prior = share * PRIOR_DOCS + LEAST_PRIOR
    odds = lambda n, docs: F.log((F.col(n) + prior) / F.greatest(F.lit(docs + PRIOR_DOCS) - F.col(n) - prior, F.lit(0.01)))
    delta = odds("n_toxic", float(toxic_docs)) - odds("n_clean", float(clean_docs))
    z = delta / F.sqrt(1 / (F.col("n_toxic") + prior) + 1 / (F.col("n_clean") + prior))
    ranked = counts.select("token", delta.alias("delta"), z.alias("z")).filter(F.abs("z") >= LEAST_Z)
    kept = ranked.orderBy(F.abs("z").desc(), "token").limit(most).collect()
    return {r.token: (float(r.delta), float(r.z)) for r in kept}


def karlin_altschul(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(lambda * score)] = 1 over clean tokens' scores and their counts; the mean is negative."""
    if not len(values) or values.max() <= 0:
        return 1.0
    share = counts / counts.sum()
    low, high = 1e-6, 1.0
    while float(share @ np.exp(np.minimum(values * high, 600))) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if float(share @ np.exp(np.minimum(values * mid, 600))) < 1 else (low, mid)
    return max(low, 0.05)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method; the ridge keeps separable data finite."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> ToxicityModel:
    """The model, from a bounded sample of labelled rows. Without labelled rows of both classes every text scores alike and low.

    Every row is measured by a model of the other folds' tokens; the extreme-value law and the weights come from these measurements,
    the tokens in the end from all rows.
    """
    rows = materialize(training_rows(docs, labels, most), "toxicity-training")
    sizes = {(r.fold, r.y): r.n for r in rows.groupBy("fold", (F.col("toxic") != 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    held = lambda y, left=None: sum(n for (f, label), n in sizes.items() if label == y and f != left)
    if not held(0) or not held(1):
        return ToxicityModel({})
    of_fold = lambda c, f: F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(f"{c}_{f}")
    counts = materialize(count_tokens(rows).groupBy("token").agg(*[of_fold(c, f) for c in ("n_clean", "n_toxic") for f in range(FOLDS)]), "toxicity-counts")
    sums = lambda left=None: counts.select("token", *[sum(F.col(f"{c}_{f}") for f in range(FOLDS) if f != left).alias(c) for c in ("n_clean", "n_toxic")]).filter("n_clean + n_toxic > 0")
    folds = {f: ToxicityModel(token_log_odds(sums(f), held(0, f), held(1, f))) for f in range(FOLDS)}

    def forget() -> None:
        for m in folds.values():
            m.cache.clear()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per clean row: its tokens, their scores with counts, and the best segment's score."""
        for batch in parts(batches, COUNT_ROWS):
            out = []
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist()):
                scores = folds[fold].token_scores(text)
                values, times = np.unique(np.round(scores, 2), return_counts=True)
                out.append((len(scores), values.tolist(), times.tolist(), max((s for _, _, s in maximal_segments(scores)), default=0.0)))
            forget()
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.float64()))], names=["n", "v", "c", "top"])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class and the features that score_documents uses, of every row."""
        for batch in parts(batches, COUNT_ROWS):
            found = [folds[fold].features(text) for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())]
            forget()
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int64()), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=["toxic", "total", "best"])

    law = materialize(rows.filter("toxic = 0").select("text", "fold").mapInArrow(measured, "n bigint, v array<double>, c array<bigint>, top double"), "toxicity-law")
    spread = law.select(F.explode(F.map_from_arrays("v", "c")).alias("v", "c")).groupBy("v").agg(F.sum("c").alias("c")).orderBy("v").collect()
    decay = karlin_altschul(np.array([r.v for r in spread]), np.array([r.c for r in spread], float)) if spread else 1.0
    tops = law.filter("n > 0").agg(F.count("*").alias("rows"), F.sum(F.col("n") * F.exp(-F.least(F.col("top") * decay, F.lit(700.0)))).alias("mass")).first()
    scale = float(np.clip(tops.rows / tops.mass, 1e-4, 10.0)) if tops.rows else 1.0  # K from the mean over clean texts of exp(-lambda * best) against length
    for m in folds.values():
        m.decay, m.scale = decay, scale
    seen = rows.select("text", "toxic", "fold").mapInArrow(featured, "toxic bigint, total double, best double").collect()  # about `most` rows of three numbers
    y = np.array([r.toxic != 0 for r in seen], float)
    features = np.array([(1.0, math.log1p(r.total), math.log1p(r.best)) for r in seen])
    order = np.lexsort((y, features[:, 2], features[:, 1]))  # a fixed order of summing
    weights = tuple(float(x) for x in logistic(features[order], y[order]))
    return ToxicityModel(token_log_odds(sums(), held(0), held(1)), decay, scale, weights)


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_segments (significant toxic passages).

    Whole texts are scanned; null texts count as empty and get the score of a text without evidence. Only the text decides a score.
    A null doc_id is not held out. Repeated rows score alike. Empty tables give an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_TOKENS tokens

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("toxicity")
        own = shared.value
        for batch in parts(batches):
            found = [own.probability(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([p for p, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "held_out", "score", "n_segments"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    result = rows.mapInArrow(scored, "doc_id bigint, held_out boolean, score double, n_segments bigint")
    return result.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_segments")


def toxic_passages(text: str | None, model: ToxicityModel, least_evidence: float = 2.0) -> list[tuple[int, int, float]]:
    """(first character, one past the last, evidence) of every significant passage of a text."""
    words = list(WORD.finditer((text or "").lower()))
    scores = model.token_scores(text or "")
    found = [(words[s].start(), words[e - 1].end(), model.segment_evidence(x, len(scores))) for s, e, x in maximal_segments(scores)]
    return [f for f in found if f[2] >= least_evidence]


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns: each row by its own text, whatever its doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        take_worker("toxicity")
        own = shared.value
        for texts in batches:
            yield pa.array([own.probability(text)[0] < threshold for i in range(0, len(texts), COUNT_ROWS) for text in texts.slice(i, COUNT_ROWS).to_pylist()], pa.bool_())
        own.cache.clear()  # workers outlive the stage; what they hold is the next one's loss
        give_back()

    return docs.filter(clean(F.coalesce(F.col("text"), F.lit(""))))
