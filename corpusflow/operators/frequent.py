"""Exact most frequent values without a shuffle of all distinct values.

Every task keeps a summary of a bounded number of counters (Misra-Gries). A
counter falls short of the true count by at most what the task took off all
counters, and so does a value that has none. Summed over tasks this proves which
values can be among the first ``k``; only they are counted exactly. Where the
proof fails, summaries get wider, and beyond a bound all values are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Counters per task at first, the factor by which they grow, and the most there are.
LEAST_COUNTERS, WIDER, MOST_COUNTERS = 1 << 12, 16, 1 << 20
#: Candidates that are sent to the tasks of the recount.
SENT_VALUES = 100_000
_HELD = 1 << 18


def summaries(rows: DataFrame, value: str, counters: int) -> DataFrame:
    """(value, n, off): a task's counters, and a row with a null value that says how much was taken off each of them."""

    def reduce(values: np.ndarray, counts: np.ndarray, off: int) -> tuple[np.ndarray, np.ndarray, int]:
        if len(values) <= counters:
            return values, counts, off
        cut_at = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
        keep = counts > cut_at
        return values[keep], counts[keep] - cut_at, off + cut_at

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, off = [], 0, 0
        values, counts = np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64)

        def add() -> None:
            nonlocal values, counts, off, size
            fresh = pa.chunked_array(held, pa.string()).value_counts()
            every = pa.concat_arrays([pa.array(values, pa.string()), fresh.field(0).cast(pa.string())])
            table = pa.table({"v": every, "n": np.concatenate([counts, np.asarray(fresh.field(1))])}).group_by("v").aggregate([("n", "sum")])
            values, counts, off = reduce(table.column("v").to_numpy(), table.column("n_sum").to_numpy(), off)
            held.clear()
            size = 0

        for batch in batches:
            held.append(batch.column(0))
            size += batch.num_rows
            if size >= _HELD:
                add()
        if held:
            add()
        yield pa.RecordBatch.from_arrays([pa.array([*values, None], pa.string()), pa.array([*counts.tolist(), 0], pa.int64()), pa.array([0] * len(values) + [off], pa.int64())], names=["value", "n", "off"])

    known = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("value"))
    return known.mapInArrow(summarise, "value string, n bigint, off bigint")


def top_values(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(value, n) of the ``k`` most frequent strings of a column, equal counts by value; nulls are not counted."""
    counters = max(LEAST_COUNTERS, 4 * k)
    order = [F.desc("n"), F.asc("value")]
    while counters <= MOST_COUNTERS:
        told = cut(summaries(rows, value, counters))
        error = told.agg(F.sum("off")).first()[0] or 0
        lower = told.where(F.col("value").isNotNull()).groupBy("value").agg(F.sum("n").alias("n"))
        if error == 0:  # nothing was taken off: the sums are the counts
            return lower.orderBy(*order).limit(k)
        least = lower.orderBy(F.desc("n")).limit(k).agg(F.min("n"), F.count("*")).first()
        # k values have at least ``least`` occurrences each; a value without a counter has ``error`` at most.
        if least[1] == k and least[0] > error:
            possible = lower.where(F.col("n") + error >= least[0]).select("value")
            if possible.count() <= SENT_VALUES:
                counted = rows.select(F.col(value).alias("value")).join(F.broadcast(possible), "value", "left_semi")  # SENT_VALUES at most
                return counted.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(*order).limit(k)
        counters *= WIDER
    return rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(*order).limit(k)
