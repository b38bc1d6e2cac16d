"""Exact deduplication by counting quotient filters and byte verification.

Every Spark partition builds one counting quotient filter of its texts'
64-bit fingerprints: the upper bits (quotient) name a bucket, the rest
(remainder) is kept sorted inside it, with a counter. A filter is sent as one
small row per range of quotients; ranges of all partitions are merged by their
sorted remainders, adding counters, which loses nothing. Only fingerprints
with a count above one go on: their texts are grouped by their bytes.

A hot text is one remainder with a large counter, in the partition's filter and
after the merge, so no task sees its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, fresh, partitions

FILTER = "block int, quotients binary, lengths binary, remainders binary, counts binary"
RANGE_ROWS = 1 << 20
SALTS = 16


def range_bits(df: DataFrame) -> int:
    """Bits of the quotient that name a range: four ranges per shuffle partition."""
    return max(4, (4 * partitions(df.sparkSession) - 1).bit_length())


class QuotientFilter:
    """Sorted remainders and counters of the quotients of one range."""

    def __init__(self, prints: np.ndarray, counts: np.ndarray, quotient_bits: int):
        """``prints`` are sorted and distinct."""
        self.shift = np.uint64(64 - quotient_bits)
        quotient = prints >> self.shift
        opens = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]]) if len(prints) else np.zeros(0, dtype=np.int64)
        self.quotients = quotient[opens]
        self.lengths = np.diff(np.r_[opens, len(prints)]).astype(np.uint32)
        self.remainders = prints & ((np.uint64(1) << self.shift) - np.uint64(1))
        self.counts = counts.astype(np.int64)

    def prints(self) -> np.ndarray:
        """The fingerprints again: quotient and remainder joined, sorted."""
        return (np.repeat(self.quotients, self.lengths) << self.shift) | self.remainders

    def fields(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.quotients.tobytes(), self.lengths.tobytes(), self.remainders.tobytes(), self.counts.tobytes()

    @classmethod
    def read(cls, row, quotient_bits: int) -> QuotientFilter:
        out = cls.__new__(cls)
        out.shift = np.uint64(64 - quotient_bits)
        out.quotients = np.frombuffer(row.quotients, dtype=np.uint64)
        out.lengths = np.frombuffer(row.lengths, dtype=np.uint32)
        out.remainders = np.frombuffer(row.remainders, dtype=np.uint64)
        out.counts = np.frombuffer(row.counts, dtype=np.int64)
        return out

    def merge(self, other: QuotientFilter, quotient_bits: int) -> QuotientFilter:
        """Both filters in one: equal remainders of a quotient add their counters."""
        return merged([self.prints(), other.prints()], [self.counts, other.counts], quotient_bits)


def merged(prints: list[np.ndarray], counts: list[np.ndarray], quotient_bits: int) -> QuotientFilter:
    every, times = np.concatenate(prints), np.concatenate(counts)
    order = np.argsort(every, kind="stable")  # runs are sorted already: the sort merges them
    every, times = every[order], times[order]
    opens = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, dtype=np.int64)
    return QuotientFilter(every[opens], np.add.reduceat(times, opens) if len(opens) else times, quotient_bits)


def partition_filters(prints: DataFrame, bits: int, quotient_bits: int) -> DataFrame:
    """One row per partition and quotient range, from a frame with a long ``print``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = QuotientFilter(np.zeros(0, np.uint64), np.zeros(0, np.int64), quotient_bits), 0
        waiting: list[np.ndarray] = []

        def add() -> None:
            nonlocal held
            if waiting:
                seen, times = np.unique(np.concatenate(waiting), return_counts=True)
                held = merged([held.prints(), seen], [held.counts, times], quotient_bits)
                waiting.clear()

        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            rows += batch.num_rows
            if rows >= RANGE_ROWS:
                add()
                rows = 0
        add()
        every = held.prints()
        block = (every >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.searchsorted(block, np.arange((1 << bits) + 1))
        out = [(b, *QuotientFilter(every[i:j], held.counts[i:j], quotient_bits).fields())
               for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if j > i]
        names = [f.split()[0] for f in FILTER.split(", ")]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return prints.mapInArrow(build, FILTER)


def repeated_prints(prints: DataFrame, quotient_bits: int = 40) -> DataFrame:
    """Fingerprints that occur more than once in ``print``, with their exact counts."""
    bits = min(range_bits(prints), quotient_bits)

    def merge(_, filters: pd.DataFrame) -> pd.DataFrame:
        parts = [QuotientFilter.read(row, quotient_bits) for row in filters.itertuples()]
        whole = merged([p.prints() for p in parts], [p.counts for p in parts], quotient_bits)
        twice = whole.counts > 1
        return pd.DataFrame({"print": whole.prints()[twice].view(np.int64), "times": whole.counts[twice]})

    return partition_filters(prints, bits, quotient_bits).groupBy("block").applyInPandas(merge, "print long, times long")


def exact_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", normalise=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after ``normalise`` (a function of a
    column; none by default). Null counts as the empty text. The row with the
    largest id stays; rows that repeat that id and text tie and all stay. A
    null id loses against any id; in a group of null ids only, all stay. An
    empty table gives no rows. Other columns are not read.
    """
    body: Column = F.coalesce(F.col(text), F.lit(""))
    body = normalise(body) if normalise else body
    rows = docs.select(F.col(id).alias("doc_id"), body.alias("body")).withColumn("print", F.xxhash64("body"))
    repeated = cut(repeated_prints(rows.select("print")))
    # Byte verification. Salted, so the copies of a hot text are read by many tasks; grouping by the
    # body alone then needs a shuffle of its own, which takes one row per task and distinct text.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    routed = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(
        repeated.select("print", salts.alias("salt")), ["print", "salt"], "left_semi")
    groups = (routed.groupBy("body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
              .where("group_size > 1").select(F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size"))
    named = rows.select("doc_id", F.sha2("body", 256).alias("text_sha256"))
    return (
        named.join(groups, "text_sha256", "left")
        .select(
            "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def keep_one_copy(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose text a kept row repeats; all columns as they were.

    Rows that repeat an id and its text tie and all stay.
    """
    gone, sha = fresh(docs, "dropped", "sha")
    dropped = exact_groups(docs, text, id).where("NOT kept").select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(sha)).distinct()
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return docs.join(dropped, F.col(id).eqNullSafe(F.col(gone)) & (digest == F.col(sha)), "left_anti")
