"""Toxicity by maximum-scoring segments.

From labelled documents each word gets a log-odds score, toxic against clean, shrunken by ``PRIOR``
occurrences that are divided between the classes as all words are; that damps rare words, so that no bound on significance is needed. A linear scan (Ruzzo and Tompa) then
finds all maximal segments of a text, and extreme-value statistics (Karlin and Altschul)
tell how many segments of such a score a clean text of that length would have by chance. The segments of a
document are aggregated into one p-value by the sum statistic.

In toxic documents a word counts once for each distinct context (the words beside it), so that many near
copies of one don't make its rare words look toxic; in clean ones each occurrence counts. Exact copies count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textarrays as ta
from .workspace import mark, release, written

#: At most so many labelled documents of either class are used to fit, chosen by the hash of their doc_id.
MAX_LABELLED = 10_000
PRIOR, LEAST_LOG_ODDS, P_DOC, E_PASSAGE = 2.0, 2.0, 0.002, 0.05
_NULL_HITS = 200_000


@dataclass
class Model:
    """Words' hashes in ascending order with their scores, the score of any other word, and lambda and K of the null."""

    words: np.ndarray
    scores: np.ndarray
    other: float
    lam: float
    k: float

    def __post_init__(self):
        self.filter = np.zeros(1 << max(16, int(len(self.words) * 16).bit_length()), bool)
        self.filter[self._slot(self.words)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.filter) - 1)).astype(np.int64)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the words that have a score of their own."""
        at = np.flatnonzero(self.filter[self._slot(hashes)])
        if not len(at) or not len(self.words):
            return at[:0], self.scores[:0]
        place = np.minimum(np.searchsorted(self.words, hashes[at]), len(self.words) - 1)
        same = self.words[place] == hashes[at]
        return at[same], self.scores[place[same]]


def segments(positions: list[int], scores: list[float], other: float) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal-scoring segments, where every word between the hits scores ``other`` < 0.

    Ruzzo and Tompa's algorithm on the hits alone; linear in their number.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum up to the end
    total, before = 0.0, None
    for at, score in zip(positions, scores):
        if before is not None:
            total += other * (at - before - 1)
        first, left, total = at, total, total + score
        before, right = at, total
        while True:
            j = len(stack) - 1
            aside = []
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            aside = stack[j]
            del stack[j:]
            first, left = aside[0], aside[2]
        stack.append((first, at, left, right))
    return [(first, last, right - left) for first, last, left, right in stack]


def p_value(sums: list[float], n: int, lam: float, k: float) -> float:
    """The chance that a clean text of ``n`` words has segments as good as these.

    The least, over the r best segments, of Karlin and Altschul's sum statistic, times 2**r for having tried r.
    """
    best, total = 1.0, 0.0
    for r, score in enumerate(sorted(sums, reverse=True), 1):
        total += lam * score - math.log(max(k * n, 1e-300))
        if total <= r:
            break
        log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
        best = min(best, 1 - math.exp(-2 * math.exp(-total)) if r == 1 else math.exp(log_p))
    return best


def null_lambda(p: np.ndarray, scores: np.ndarray, other: float) -> float:
    """The positive root of E[exp(lambda * score)] = 1 under the clean words' rates ``p``."""
    rest = 1 - p.sum()
    excess = lambda x: float((p * np.exp(x * scores)).sum() + rest * math.exp(x * other) - 1)
    lo, hi = 1e-6, 1.0
    while excess(hi) < 0:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def null_k(p: np.ndarray, scores: np.ndarray, other: float, lam: float) -> float:
    """K from a simulated clean text of ``_NULL_HITS`` scored words: segments of at least the median score, by word of text."""
    rng = np.random.default_rng(20)
    rate = float(p.sum())
    draws = rng.choice(scores, _NULL_HITS, p=p / rate)
    gaps = rng.geometric(min(rate, 1.0), _NULL_HITS)
    least, value, peak, found = float(np.median(scores)), 0.0, 0.0, 0
    for gap, score in zip(gaps.tolist(), draws.tolist()):
        value += other * (gap - 1)
        if value <= 0:
            found += peak >= least
            value = peak = 0.0
        value += score
        peak = max(peak, value)
    return max(1, found) * math.exp(lam * least) / float(gaps.sum())


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, prior: float = PRIOR, least_log_odds: float = LEAST_LOG_ODDS) -> Model:
    """The model, from at most ``max_labelled`` toxic and as many clean labelled documents.

    A word of shrunken log-odds below ``least_log_odds`` counts like any other. Labels other than 0 and 1, null ids and labels without a document are passed over; of conflicting labels toxic wins.
    Without both classes, or if no word stands out, the model has no words and rejects nothing.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for c in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("toxic", "text").dropDuplicates()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            for lo, hi in ta.groups(batch.column(1)):
                hashes, counts = ta.words(batch.column(1).slice(lo, hi - lo))
                if not len(hashes):
                    continue
                near = np.zeros(len(hashes), np.uint64)
                near[1:] += hashes[:-1]
                near[:-1] += hashes[1:] * np.uint64(3)
                context, kind = ta.mix(near), np.repeat(toxic[lo:hi], counts)
                order = np.lexsort((context, hashes, kind))
                h, x, c = hashes[order], context[order], kind[order]
                # a clean word needs no contexts of its own, all count as one
                x[c == 0] = 0
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (c[1:] != c[:-1])))
                n = np.diff(np.append(new, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(x[new].view(np.int64)), pa.array(c[new].astype(np.int32)), pa.array(n)], names=["word", "context", "toxic", "n"])

    of = lambda c, x: F.sum(F.when(F.col("toxic") == c, x).otherwise(0.0))
    by_word = (
        sample.mapInArrow(contexts, "word long, context long, toxic int, n long")
        .groupBy("word", "toxic", "context").agg(F.sum("n").cast("double").alias("n"))
        .groupBy("word").agg(of(1, F.lit(1.0)).alias("t"), of(1, F.col("n")).alias("all_t"), of(0, F.col("n")).alias("c"))
    )
    begun = mark()
    by_word = written(by_word, "toxic-words")
    try:
        return _model(by_word, prior, least_log_odds)
    finally:
        release(docs.sparkSession, begun)


def _model(by_word: DataFrame, prior: float, least_log_odds: float) -> Model:
    """The model from ``by_word``: word, its distinct contexts t and occurrences all_t in toxic documents, its occurrences c in clean ones."""
    n_t, n_c, n_words = (float(x or 0) for x in by_word.agg(F.sum("all_t"), F.sum("c"), F.count("*")).first())
    if not n_t or not n_c:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 1.0, 1.0)
    a_t, a_c = prior * n_t / (n_t + n_c), prior * n_c / (n_t + n_c)
    odds = F.log((F.col("t") + a_t) / a_t) - F.log((F.col("c") + a_c) / a_c)
    rate = (F.col("c") + a_c) / (n_c + a_c * n_words)
    rows = by_word.select("word", "t", odds.alias("score"), rate.alias("p")).filter(F.col("score") >= least_log_odds).collect()
    if not rows:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 1.0, 1.0)
    rows.sort(key=lambda r: r["word"] % (1 << 64))
    words = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    scores, p = np.array([r["score"] for r in rows]), np.array([r["p"] for r in rows])
    share = min(0.5, sum(r["t"] for r in rows) / n_t)
    other = math.log((1 - share) / (1 - min(0.5 * share, float(p.sum()))))
    lam = null_lambda(p, scores, other)
    return Model(words, scores, other, lam, null_k(p, scores, other, lam))


def _judge(model: Model, column: pa.Array, p_doc: float, e_passage: float) -> Iterator[tuple[int, int, list, float, float]]:
    """(row, words, significant segments, best score, p-value) of the rows that have a scored word; and the words of all rows last."""
    hashes, counts = ta.words(column)
    at, scores = model.hits(hashes)
    ends = np.cumsum(counts)
    row = np.searchsorted(ends, at, "right")
    for r in np.unique(row):
        mine = slice(*np.searchsorted(row, [r, r + 1]))
        start, n = int(ends[r] - counts[r]), int(counts[r])
        found = segments((at[mine] - start).tolist(), scores[mine].tolist(), model.other)
        good = [s for s in found if model.k * n * math.exp(-model.lam * s[2]) <= e_passage]
        yield int(r), n, good, max(s[2] for s in found), p_value([s[2] for s in found], n, model.lam, model.k)
    yield -1, 0, [counts], 0.0, 1.0


def toxicity(docs: DataFrame, labels: DataFrame, p_doc: float = P_DOC, e_passage: float = E_PASSAGE, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, n_words, score, p_value, toxic, n_passages, passages: a row for each row of ``docs``.

    passages holds (first word, last word, score) of each segment of which clean text of that length would have at most ``e_passage``
    by chance; toxic: p_value is at most ``p_doc``. A null or empty text has no words, p-value 1 and isn't
    toxic. Null ids and repeated rows are judged like any other; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        *(T.StructField(n, k) for n, k in (("n_words", T.LongType()), ("score", T.DoubleType()), ("p_value", T.DoubleType()), ("toxic", T.BooleanType()), ("n_passages", T.LongType()))),
        T.StructField("passages", T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("score", T.DoubleType())]))),
    ])
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ta.groups(batch.column(1)):
                score, p, passages, counts = np.zeros(hi - lo), np.ones(hi - lo), [[] for _ in range(hi - lo)], None
                for r, _, good, best, chance in _judge(model.value, batch.column(1).slice(lo, hi - lo), p_doc, e_passage):
                    if r < 0:
                        counts = good[0]
                    else:
                        score[r], p[r] = best, chance
                        passages[r] = [{"first_word": a, "last_word": b, "score": s} for a, b, s in good]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts), pa.array(score), pa.array(p), pa.array(p <= p_doc), pa.array([len(x) for x in passages], pa.int64()), pa.array(passages, kind)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, labels: DataFrame, p_doc: float = P_DOC, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`toxicity` doesn't call toxic; null and empty texts stay."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ta.groups(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                clean = np.ones(hi - lo, bool)
                for r, _, _, _, chance in _judge(model.value, part.column(at), p_doc, 0.0):
                    if r >= 0 and chance <= p_doc:
                        clean[r] = False
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
