"""Toxic passages as maximum-scoring segments of token log-odds.

Token scores are log-odds between toxic and other labelled texts under a
Dirichlet prior that follows the background, shrunk by their standard error. A
linear-time scan finds all maximal segments of a text. Scores of best segments
follow an extreme-value distribution on clean text; it gives every segment the
number of segments of that score expected by chance, which is comparable
between short and long texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Slice, byte_values, letter_bytes, per_text_windows, prefix_hash, range_hash, small_batches, text_slices, word_hashes, word_spans
from .tables import cut, id_remainder

#: A word is known as a whole and by its first bytes, which inflected and compound words share.
PREFIXES = (7, 5)
FAMILIES = 1 + len(PREFIXES)
#: Each kind of token has 2**18 hashed counters, so the model has one size for any vocabulary.
BUCKET_BITS = 18
TOKENS = FAMILIES << BUCKET_BITS
#: Width of the bins in which token scores of clean text are counted.
BIN = 0.05
#: The classifier is fitted on at most this many labelled rows, taken by hash of their id.
TRAIN_ROWS = 20_000
#: The prior counts as so many occurrences of every token, in both kinds of text by their shares of all words.
PRIOR = 4.0
#: Log-odds are lowered by so many standard errors, and what is left below the least counts as none.
SHRINK = 2.0
LEAST = 2.0
DRIFT = 0.03
#: A passage is significant if fewer than this many of its score are expected by chance.
EXPECTED = 0.01
_GAPS = letter_bytes()
_VALUES = byte_values(fold_case=True)


def tokens_of(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Counter of each word's tokens, one row per kind of token, and the first word of each text."""
    start, end, first = word_spans(part, _GAPS)
    running = prefix_hash(part.data, _VALUES)
    ends = [end, *(np.minimum(end, start + k) for k in PREFIXES)]
    return np.stack([(range_hash(running, start, e) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + (k << BUCKET_BITS) for k, e in enumerate(ends)]), first


def word_scores(tokens: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The score of each word: that of its token that says most, less the drift."""
    own = scores[tokens]
    return np.take_along_axis(own, np.abs(own).argmax(axis=0)[None, :], axis=0)[0].astype(np.float64) - DRIFT


def labelled_sample(labels: DataFrame, modulus: int, held: int, rows: int, label: str = "toxic", id: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out fold; an id labelled twice counts as toxic if one label says so."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("label_id")).agg((F.max(label) > 0).alias("is_toxic"))
    return known.where(id_remainder(F.col("label_id"), modulus) != held).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)


def one_per_family(taught: DataFrame) -> DataFrame:
    """Of taught texts (label_id, text, is_toxic) the ids to learn from: one per least word shingle and label.

    Copies and near copies mostly share their least shingle hash; counted once
    each, they would pass for evidence of all their words.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            for part in text_slices(batch.column(2)):
                words, first = word_hashes(part, _GAPS, _VALUES)
                hashes, _, owner = per_text_windows(words, first, 5)
                own = np.zeros(part.count, dtype=np.uint64)
                opens = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
                if len(opens):
                    own[owner[opens]] = np.minimum.reduceat(hashes, opens)
                out.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], names=["label_id", "is_toxic", "least"])

    kind = dict(taught.dtypes)["label_id"]
    return (taught.select("label_id", "is_toxic", "text").mapInArrow(least, f"label_id {kind}, is_toxic boolean, least long")
            .groupBy("is_toxic", "least").agg(F.min("label_id").alias("label_id")).select("label_id", "is_toxic").distinct())


def token_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Counts of tokens in other and in toxic texts, and the number of words of both, from (text, is_toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words_seen = np.zeros((2, TOKENS), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in small_batches(batches):
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in text_slices(batch.column(0)):
                tokens, first = tokens_of(part)
                kind = np.repeat(toxic[part.first : part.first + part.count], np.diff(first))
                words_seen += np.bincount(kind, minlength=2)
                total += np.bincount((tokens + kind[None, :] * TOKENS).ravel(), minlength=2 * TOKENS).reshape(2, -1)
        seen = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, seen]), pa.array(np.r_[words_seen[0], total[0, seen]]), pa.array(np.r_[words_seen[1], total[1, seen]])], names=["bucket", "other", "toxic"])

    sums = texts.select("text", "is_toxic").mapInArrow(count, "bucket long, other long, toxic long").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toPandas()
    out = np.zeros((2, TOKENS + 1))  # the last place takes bucket -1
    out[0, sums.bucket.to_numpy(dtype=np.int64)] = sums.other.to_numpy(dtype=float)
    out[1, sums.bucket.to_numpy(dtype=np.int64)] = sums.toxic.to_numpy(dtype=float)
    return out[0, :-1], out[1, :-1], (int(out[0, -1]), int(out[1, -1]))


@dataclass
class Model:
    """Token scores, the extreme-value parameters of clean text, and the fit from surprise to probability."""

    scores: np.ndarray
    decay: float = 1.0  # lambda: chance segments of score s are exp(-lambda s) as frequent
    scale: float = 1.0  # K: chance segments per word
    weights: tuple[float, float, float] | None = None  # of score, length and 1; without both kinds of labels every probability is 0

    @classmethod
    def fit(cls, other: np.ndarray, toxic: np.ndarray, words: tuple[int, int]) -> Model:
        if not other.sum() or not toxic.sum():
            return cls(np.zeros(len(other)))
        share = np.array(words) / sum(words)
        a, b = toxic + PRIOR * share[1], other + PRIOR * share[0]
        ratio = np.log(a / (words[1] + PRIOR * share[1])) - np.log(b / (words[0] + PRIOR * share[0]))
        error = np.sqrt(1 / a + 1 / b)
        shrunk = np.sign(ratio) * np.maximum(np.abs(ratio) - SHRINK * error, 0)
        return cls(np.where(np.abs(shrunk) >= LEAST, np.clip(shrunk, -4.0, 12.0), 0.0))

    def calibrated(self, words: np.ndarray, best: np.ndarray, toxic: np.ndarray, bins: np.ndarray, counts: np.ndarray) -> Model:
        """With lambda from the word scores of clean text (``bins``, ``counts``), K from its best segments, and the probability fitted to all rows."""
        if len(counts):
            self = replace(self, decay=self.decay_of(counts / counts.sum(), bins * BIN))
        clean = (toxic == 0) & (words > 0)
        # On clean text, n K exp(-lambda best) is exponential with mean 1, which gives K.
        mean = float(np.mean(words[clean] * np.exp(-self.decay * best[clean]))) if clean.any() else 1.0
        out = replace(self, scale=1 / max(mean, 1e-12))
        if 0 < toxic.sum() < len(toxic):
            out = replace(out, weights=tuple(logistic(out.surprise(words, best), toxic).tolist()))
        return out

    def log_expected(self, words, score):
        """Log of the number of segments of this score that chance gives in a text of so many words."""
        return np.log(np.maximum(words, 1) * self.scale) - self.decay * score

    def surprise(self, words: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Both parts of the log of the expected number: of the score and of the length; and 1."""
        return np.stack([np.clip(self.decay * best, 0, 30), np.log(np.maximum(words, 1) * self.scale), np.ones(len(words))], axis=1)

    def probability(self, words: np.ndarray, best: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(words))
        return 1 / (1 + np.exp(-np.clip(self.surprise(words, best) @ np.array(self.weights), -30, 30)))

    @staticmethod
    def decay_of(share: np.ndarray, scores: np.ndarray) -> float:
        """The positive root of sum(share * exp(x * score)) = 1, by bisection."""
        share, scores = share[share > 0], scores[share > 0]
        if scores.max() <= 0 or share @ scores >= 0:
            return 1.0
        low, high = 0.0, 1.0
        while share @ np.exp(high * scores) < 1 and high < 64:
            low, high = high, high * 2
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if share @ np.exp(middle * scores) < 1 else (low, middle)
        return max(high, 1e-3)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Each candidate keeps the running total before (left) and after (right) it. A
    new positive score joins the nearest earlier candidate with a smaller left
    total, unless that one already ends as high.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # start, end, left, right
    for k in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = k, k + 1, float(total[k]), float(total[k + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]  # all between have larger left totals still
            if j < 0 or stack[j][3] >= right:
                stack.append([start, end, left, right, j])
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - q) for s, e, q, r, _ in stack]


def scan_slices(column: pa.Array, scores: np.ndarray) -> Iterator[tuple[np.ndarray, list[list[tuple[int, int, float]]], np.ndarray]]:
    """For each slice of a text column: words per text, each text's maximal segments, and all word scores."""
    for part in text_slices(column):
        tokens, first = tokens_of(part)
        own = word_scores(tokens, scores)
        segments: list[list[tuple[int, int, float]]] = [[] for _ in range(part.count)]
        for t in np.unique(np.searchsorted(first, np.flatnonzero(own > 0), side="right") - 1).tolist():
            segments[t] = maximal_segments(own[first[t] : first[t + 1]])
        yield np.diff(first), segments, own


def best_scores(segments: list[list[tuple[int, int, float]]]) -> np.ndarray:
    return np.array([max((s for _, _, s in own), default=0.0) for own in segments])


def logistic(z: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Weights of a logistic fit to the columns of ``z``, with a weak pull to zero."""
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), z.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_model(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", modulus: int = 5, held: int = 0, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``train_rows`` labelled rows outside the held-out fold, whole texts."""
    sample = cut(labelled_sample(labels, modulus, held, train_rows))
    own = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    sampled = own.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))  # at most train_rows ids
    learned = cut(one_per_family(sampled))
    taught = own.join(F.broadcast(learned), F.col("doc_id") == F.col("label_id")).select("text", "is_toxic")
    model = Model.fit(*token_counts(taught))
    shared = docs.sparkSession.sparkContext.broadcast(model.scores.astype(np.float32))  # TOKENS numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: dict[int, int] = {}
        for batch in small_batches(batches):
            words, best, at = [np.zeros(0, np.int64)], [np.zeros(0)], 0
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lengths, segments, own in scan_slices(batch.column(0), shared.value):
                words.append(lengths)
                best.append(best_scores(segments))
                clean = ~np.repeat(toxic[at : at + len(lengths)].astype(bool), lengths)
                at += len(lengths)
                for value, n in zip(*(x.tolist() for x in np.unique(np.round(own[clean] / BIN).astype(np.int64), return_counts=True)), strict=True):
                    bins[value] = bins.get(value, 0) + n
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.concatenate(words).astype(np.int64)), pa.array(np.concatenate(best)), pa.nulls(batch.num_rows, pa.int64())], names=["is_toxic", "n_words", "best", "bin"])
        if bins:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(bins), pa.bool_()), pa.array(list(bins.values()), pa.int64()), pa.nulls(len(bins), pa.float64()), pa.array(list(bins), pa.int64())], names=["is_toxic", "n_words", "best", "bin"])

    seen = taught.mapInArrow(scan, "is_toxic boolean, n_words long, best double, bin long").toPandas()  # a row per taught text; some 300 bins per task
    texts, bins = seen[seen["bin"].isna()], seen[seen["bin"].notna()].groupby("bin")["n_words"].sum()
    return model.calibrated(texts.n_words.to_numpy(dtype=float), texts.best.to_numpy(dtype=float), texts.is_toxic.to_numpy(dtype=float), bins.index.to_numpy(dtype=float), bins.to_numpy(dtype=float))


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", modulus: int = 5, held: int = 0,
                   train_rows: int = TRAIN_ROWS, expected: float = EXPECTED) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_passages, passages.

    The model learns from at most ``train_rows`` labelled ids outside the
    held-out fold; every whole text is scored, from its words alone. Null and
    empty texts, and texts without letters or digits, have no segment and the
    lowest score. A null id is scored and not learned from; rows that repeat are
    scored alike; labels without a match or with nulls teach nothing; without
    labels of both kinds all scores are 0. An empty table gives no rows; other
    columns are not read. ``passages`` holds word positions of every segment of
    which fewer than ``expected`` are due to chance in such a text.
    """
    model = fit_model(docs, labels, text, id, modulus, held, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, scores=model.scores.astype(np.float32)))
    limit = math.log(expected)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in small_batches(batches):
            scores, found = [np.zeros(0)], []
            for words, segments, _ in scan_slices(batch.column(1), fitted.scores):
                scores.append(fitted.probability(words, best_scores(segments)))
                found += [[{"start": a, "end": b, "score": s} for a, b, s in own if fitted.log_expected(n, s) < limit] for n, own in zip(words.tolist(), segments, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores)), pa.array(found, kind)], names=["doc_id", "score", "passages"])

    kind = dict(docs.dtypes)[id]
    scored = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        score, f"doc_id {kind}, score double, passages array<struct<start: long, end: long, score: double>>")
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns as they were, and no shuffle."""
    model = fit_model(docs, labels, text, id, train_rows=train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, scores=model.scores.astype(np.float32)))
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in small_batches(batches):
            scores = [np.zeros(0)] + [fitted.probability(words, best_scores(segments)) for words, segments, _ in scan_slices(batch.column(at), fitted.scores)]
            yield batch.filter(pa.array(np.concatenate(scores) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
