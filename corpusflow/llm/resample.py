"""Importance resampling towards a target distribution of hashed features.

Features of texts are hashed into buckets; a bucket's gain is the smoothed log
ratio of its share in the target and in the corpus. A text's weight is the mean
gain of its features, read from an array of gains; Gumbel noise from a hash of
the id makes the highest scores a draw without replacement by weight. Scores
are ranked by a distributed radix sort over the digits of (score, id).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Slice, letter_bytes, small_batches, text_slices, word_spans
from .radix import radix_ranks
from .tables import cut

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Longer features are hashed one by one.
SHORT_BYTES = 64
_GAPS = letter_bytes()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@lru_cache(maxsize=1)
def crc_table() -> np.ndarray:
    """The remainders of single bytes, from the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def crc32_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each byte range."""
    table, state, length = crc_table(), np.full(len(start), 0xFFFFFFFF, dtype=np.uint32), end - start
    live = np.flatnonzero(length <= SHORT_BYTES)
    step = 0
    while len(live := live[length[live] > step]):
        own = state[live]
        state[live] = table[(own ^ data[start[live] + step]) & 0xFF] ^ (own >> 8)
        step += 1
    out = (state ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    for k in np.flatnonzero(length > SHORT_BYTES).tolist():
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes())
    return out


def joined_words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded words of a slice, one space after each: bytes, starts, ends, and the first word of each text."""
    start, end, first = word_spans(part, _GAPS)
    length = end - start + 1
    new = np.r_[0, np.cumsum(length)]
    body = np.full(new[-1], 0x20, dtype=np.uint8)
    inside = np.ones(len(body), dtype=bool)
    inside[new[1:] - 1] = False
    body[inside] = _FOLD[part.data[~_GAPS[part.data]]]
    return body, new[:-1], new[1:] - 1, first


def feature_buckets(part: Slice, buckets: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``run`` words of a slice, the text of each, and the words of each text."""
    body, start, end, first = joined_words(part)
    words = np.diff(first)
    owner = np.repeat(np.arange(part.count), words)
    found, texts = [], []
    for n in range(1, run + 1):
        at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, np.int64)
        found.append(crc32_ranges(body, start[at], end[at + n - 1]) % buckets)
        texts.append(owner[at])
    return np.concatenate(found), np.concatenate(texts), words


def bucket_counts(df: DataFrame, text: str, buckets: int, run: int) -> np.ndarray:
    """Features per bucket over all texts of ``df``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in small_batches(batches):
            for part in text_slices(batch.column(0)):
                total += np.bincount(feature_buckets(part, buckets, run)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    rows = df.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in rows.collect():  # a row per bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, floored."""
    s, t, buckets = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, text: str, id: str, run: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in small_batches(batches):
            words, features, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for part in text_slices(batch.column(1)):
                bucket, owner, own = feature_buckets(part, len(gain), run)
                at = slice(part.first, part.first + part.count)
                words[at] = own
                features[at] = np.bincount(owner, minlength=part.count)
                np.add.at(total[at], owner, gain[bucket])
            weight = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return rows.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))))


def cut_score(rows: DataFrame, least_words: int, percent: int) -> tuple[int, int | None, int]:
    """How many are drawn, the score from which on they are found, and the highest score.

    Scores are whole numbers within some hundred thousand, whatever the corpus:
    a gain lies within 1000 times the log of the number of features, noise
    between -3,200 and 22,900. So there is a bounded number of rows to read here.
    """
    counts = dict(rows.where(F.col("n_words") >= least_words).groupBy("score").count().collect())
    drawn = sum(counts.values()) * percent // 100
    seen = 0
    for score in sorted(counts, reverse=True):
        seen += counts[score]
        if drawn and seen >= drawn:
            return drawn, score, max(counts)
    return drawn, None, 0


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", id: str = "doc_id", target_text: str = "text", buckets: int = BUCKETS,
    run: int = RUN, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank, all long.

    Words are runs of letters and digits of ASCII and of all other characters,
    A-Z folded; features are all runs of 1 to ``run`` of them. ``weight`` is the
    floored mean gain of a text's features, 0 without any (null, empty). Of the
    rows with ``least_words`` words or more, ``percent`` in a hundred are drawn,
    rounded down: the highest scores, equal scores by the lesser id, a null id
    last. ``rank`` counts them from 1 and is null for the rest. Rows that repeat
    an id and a score tie and are ranked in the order they are read. Empty
    tables draw nothing; an empty target leaves the corpus's shares alone to
    decide. Other columns are not read. Ids are whole numbers.
    """
    gain = gains(bucket_counts(docs, text, buckets, run), bucket_counts(target, target_text, buckets, run))
    rows = cut(scored(docs, gain, text, id, run, seed))
    drawn, least, highest = cut_score(rows, least_words, percent)
    out = ["doc_id", "n_features", "weight", "score"]
    nothing = F.lit(None).cast("long").alias("rank")
    if least is None:
        return rows.select(*out, nothing)
    sortable = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    chosen = rows.where(sortable)
    low, high = chosen.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0  # both None where all ids are null
    # Two keys that rise: how far below the best score, null ids after all others; then the id.
    keyed = chosen.select(
        ((F.lit(highest) - F.col("score")) * 2 + F.col("doc_id").isNull().cast("long")).alias("below"), F.coalesce("doc_id", F.lit(low)).alias("id"),
        "n_features", "weight", "score")
    ranked = radix_ranks(keyed, [("below", 0, 2 * (highest - least) + 1), ("id", low, high)])
    in_order = ranked.select(
        F.when(F.col("below") % 2 == 0, F.col("id")).alias("doc_id"), "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return in_order.unionByName(rows.where(~sortable).select(*out, nothing))
