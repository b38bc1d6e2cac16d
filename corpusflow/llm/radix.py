"""Ranks by a distributed least-significant-digit radix sort.

Rows are packed: a block is one Spark row that holds some thousand records as
arrays. A pass takes one digit of the key. Every block counts its records per
digit; prefix sums over (digit, block) give the place at which a block's records
of a digit begin; a record's destination is that place plus its own stable rank
inside the block. Records move to the block of their destination as contiguous
pieces, so every new block is full whatever the keys are: a digit value that
nearly all records share is spread like any other.

Passes go from the lowest digit of the last key to the highest digit of the
first. Each is stable, so after the last one the place is the rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, partitions

DIGIT = 11
#: Records per block: as many as give each shuffle partition one, within these bounds.
LEAST_BLOCK, MOST_BLOCK = 1 << 10, 1 << 20
PACK = "block long, data binary"


def _pack(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(block, data) from long columns: blocks of at most ``most`` records, numbered in the order of their tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 32, [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.concatenate(held, axis=1).tobytes()], pa.binary())], names=["block", "data"])

        for batch in batches:
            records = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            for k in range(0, records.shape[1], most):
                piece = records[:, k : k + most]
                if count + piece.shape[1] > most:
                    yield full()
                    number, held, count = number + 1, [], 0
                held.append(piece)
                count += piece.shape[1]
        if count:
            yield full()

    return rows.select(*columns).mapInArrow(pack, PACK)


def _digit(records: np.ndarray, column: int, low: int, shift: int) -> np.ndarray:
    above = records[column].view(np.uint64) - np.uint64(low % (1 << 64))  # modulo 2^64, so no range of longs is too wide
    return ((above >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)


def _destinations(blocks: DataFrame, width: int, column: int, low: int, shift: int) -> DataFrame:
    """(block, digits, starts): for each digit of a block the place of its first record after the pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digits, times = np.unique(_digit(np.frombuffer(data, dtype=np.int64).reshape(width, -1), column, low, shift), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(digits), block)), pa.array(digits), pa.array(times)], names=["block", "digit", "n"])

    counts = blocks.mapInArrow(count, "block long, digit long, n long")
    # A row per digit value: 2^DIGIT at most.
    below = counts.groupBy("digit").agg(F.sum("n").alias("n")).select(
        "digit", (F.sum("n").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("below"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)  # a row per block
    placed = counts.withColumn("before", F.sum("n").over(earlier) - F.col("n")).join(F.broadcast(below), "digit")
    pairs = F.sort_array(F.collect_list(F.struct("digit", (F.col("below") + F.col("before")).alias("start"))))
    return placed.groupBy("block").agg(pairs.alias("own")).select("block", F.col("own.digit").alias("digits"), F.col("own.start").alias("starts"))


def _pass(blocks: DataFrame, width: int, column: int, low: int, shift: int, size: int) -> DataFrame:
    """One stable counting-sort pass: new blocks of ``size`` records, the last one smaller."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, digits, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records = np.frombuffer(data, dtype=np.int64).reshape(width, -1)
                own = _digit(records, column, low, shift)
                order = np.argsort(own, kind="stable")
                first = np.searchsorted(own[order], digits)
                place = np.arange(len(own)) + np.repeat(np.array(starts) - first, np.diff(np.r_[first, len(own)]))
                records = records[:, order]
                cuts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | (place[1:] // size != place[:-1] // size)])
                pieces = [records[:, i:j].tobytes() for i, j in zip(cuts, np.r_[cuts[1:], len(own)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(place[cuts] // size), pa.array(place[cuts] % size), pa.array(pieces, pa.binary())], names=["block", "at", "data"])

    def gather(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("at")
        records = np.concatenate([np.frombuffer(d, dtype=np.int64).reshape(width, -1) for d in pieces["data"]], axis=1)
        return pd.DataFrame({"block": pieces["block"].iloc[:1], "data": [records.tobytes()]})

    moved = blocks.join(_destinations(blocks, width, column, low, shift), "block").select("data", "digits", "starts").mapInArrow(scatter, "block long, at long, data binary")
    return moved.groupBy("block").applyInPandas(gather, PACK)


def radix_ranks(rows: DataFrame, keys: list[tuple[str, int, int]], name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3 ... in rising order of the keys.

    All columns are whole numbers that are not null. ``keys`` are columns with
    their least and greatest value, the most significant key first. Rows with
    equal keys keep the order in which they are read.
    """
    columns = rows.columns
    count = rows.count()
    size = min(MOST_BLOCK, max(LEAST_BLOCK, math.ceil(count / partitions(rows.sparkSession))))
    blocks = cut(_pack(rows, columns, size))
    for key, low, high in reversed(keys):
        for shift in range(0, (high - low).bit_length(), DIGIT):
            blocks = cut(_pass(blocks, len(columns), columns.index(key), low, shift, size))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                records = np.frombuffer(data, dtype=np.int64).reshape(len(columns), -1)
                rank = block * size + 1 + np.arange(records.shape[1])
                yield pa.RecordBatch.from_arrays([*(pa.array(r) for r in records), pa.array(rank)], names=[*columns, name])

    return blocks.mapInArrow(unpack, ", ".join(f"{c} long" for c in [*columns, name]))
