"""Paired bootstrap over stored per-row statistics.

Texts are scored once. A resample only sums statistics, so its cost does not
depend on the length of the texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .metrics import GroupedMetric, final_exprs, stat_names, with_stats
from .ordinal import attach_row, exact_percentiles, with_global_index

RESAMPLES = 1000
CI = {"ci95_low": 0.025, "ci95_high": 0.975}
# Pairs per block, and tasks per core while there are few blocks.
BLOCK, TASKS_PER_CORE = 8192, 2
_GOLDEN = 0x9E3779B97F4A7C15


def in_order(stats: DataFrame, id_col: str, columns: list[str]) -> tuple[DataFrame, int]:
    """The columns with ``idx``, the place of a row's id, and how many rows there are."""
    indexed = with_global_index(stats.select(id_col, *columns), id_col).drop(id_col)
    n = indexed.count()
    if n == 0:
        raise ValueError("no pairs to resample")
    return indexed, n


def resample_sums(stats: DataFrame, id_col: str, columns: list[str], resamples: int = RESAMPLES, seed: int = 42,
                  block: int = BLOCK) -> tuple[DataFrame, int]:
    """``(resample, sums of the columns)`` of n draws with replacement, and n."""
    indexed, n = in_order(stats, id_col, columns)
    return drawn_sums(indexed, n, columns, resamples, seed, block), n


def drawn_sums(indexed: DataFrame, n: int, columns: list[str], resamples: int, seed: int, block: int = BLOCK) -> DataFrame:
    """``(resample, sums of the columns)`` over rows with ``idx`` 0 .. n-1.

    Rows stand in blocks by the order of their ids. How many of a resample's n
    draws fall into a block is found by halving: at every node of a tree over
    the blocks a seeded binomial draw splits the node's draws between its
    halves. A task needs the nodes above its block only. Draws inside a block
    are numbers of a keyed counter generator; a task takes one block and a range
    of resamples, so few blocks still keep all cores at work, and gives one row
    of sums per resample. No draw is shuffled, and neither the ranges nor a
    second attempt change a draw. A row with NaN or an infinity counts in the
    resamples that draw it; a null leaves its block out of the sums of its column.
    """
    blocks = -(-n // block)
    cores = indexed.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, min(resamples, -(-TASKS_PER_CORE * cores // blocks)))
    edges = np.linspace(0, resamples, ranges + 1).astype(int).tolist()

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:  # Arrow keeps NaN and null apart
        number, part = (k.as_py() for k in key)
        rows = rows.sort_by("idx")
        values = np.column_stack([rows[c].cast(pa.float64(), safe=False).to_numpy() for c in columns])
        even = np.where(np.isfinite(values), values, 0.0)  # 0 times NaN would be NaN
        odd = np.flatnonzero((even != values).any(axis=1))
        rest = (values - even)[odd]
        low, high = edges[part], edges[part + 1]
        counts = block_draws(n, block, number, resamples, seed)
        out = np.empty((high - low, len(columns)))
        for r in range(low, high):
            times = np.bincount(draws_in_block(seed, r, number, int(counts[r]), len(values)), minlength=len(values))
            out[r - low] = times @ even
            if (drawn := times[odd] > 0).any():
                out[r - low] += times[odd][drawn] @ rest[drawn]
        unknown = [rows[c].null_count > 0 for c in columns]
        sums = [pa.nulls(high - low, pa.float64()) if u else pa.array(out[:, i]) for i, u in enumerate(unknown)]
        return pa.table([*sums, pa.array(np.arange(low, high))], names=[*columns, "resample"])

    schema = ", ".join(f"`{c}` double" for c in columns) + ", resample bigint"
    placed = indexed.withColumn("_block", F.expr(f"idx div {block}")).withColumn("_range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    if ranges > 1:  # few and small groups, which adaptive execution would put into one task
        placed = placed.repartition(blocks * ranges, "_block", "_range")
    sums = placed.groupBy("_block", "_range").applyInArrow(run, schema)
    return sums.groupBy("resample").agg(*[F.sum(c).alias(c) for c in columns])


def block_draws(n: int, block: int, number: int, resamples: int, seed: int) -> np.ndarray:
    """Draws of every resample that fall into one block."""
    low, high = 0, -(-n // block)
    counts = np.full(resamples, n, dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rows, left = min(high * block, n) - low * block, middle * block - low * block
        first = np.random.default_rng([seed, low, high]).binomial(counts, left / rows)
        low, high, counts = (low, middle, first) if number < middle else (middle, high, counts - first)
    return counts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream_key(seed: int, resample: int, number: int) -> np.ndarray:
    """The 64-bit key of the draws of a resample in a block."""
    key = np.zeros(1, dtype=np.uint64)
    for part in (seed, resample, number):
        key = mix64(key + np.uint64(_GOLDEN) ^ np.uint64(part % (1 << 64)))
    return key


def draws_in_block(seed: int, resample: int, number: int, count: int, size: int) -> np.ndarray:
    """Places of the draws inside a block of ``size`` rows.

    Draw ``t`` is a hash of the key and of the hashed counter. A key is joined
    by exclusive or before the last hash, so no stream is a shifted part of
    another.
    """
    counter = mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_GOLDEN))
    return (mix64(counter ^ stream_key(seed, resample, number)) % np.uint64(size)).astype(np.int64)


def _summary(deltas: DataFrame, observed: DataFrame, n: int, resamples: int) -> DataFrame:
    deltas = cut(deltas)  # one row per resample; the draws behind them are made once
    below = deltas.agg(F.count_if(F.col("delta") <= 0).alias("_below"))
    bounds = exact_percentiles(deltas.select(F.col("delta").alias("_d")), [], "_d", CI)
    return attach_row(attach_row(observed, below), bounds).select(
        "delta", "ci95_low", "ci95_high",
        ((F.col("_below") + 1) / F.lit(resamples + 1)).alias("p_value"),
        (F.col("ci95_low") > 0).alias("significant"),
        F.lit(n).cast("bigint").alias("n"), F.lit(resamples).cast("bigint").alias("n_resamples"),
    )


def paired_bootstrap_mean(pairs: DataFrame, id_col: str, current: Column, baseline: Column,
                          resamples: int = RESAMPLES, seed: int = 42, **limits) -> DataFrame:
    """Mean difference of two per-pair scores with interval, p value and verdict."""
    diffs = pairs.select(id_col, (current - baseline).cast("double").alias("diff"))
    indexed, n = in_order(diffs, id_col, ["diff"])
    sums = drawn_sums(indexed, n, ["diff"], resamples, seed, **limits)
    observed = indexed.agg((F.sum("diff") / F.lit(n)).alias("delta"))
    return _summary(sums.select((F.col("diff") / F.lit(n)).alias("delta")), observed, n, resamples)


def paired_bootstrap_corpus(pairs: DataFrame, id_col: str, metric: GroupedMetric, key: str,
                            current: str = "prediction", baseline: str = "baseline_prediction",
                            reference: str = "reference", resamples: int = RESAMPLES, seed: int = 42,
                            normalise: Callable[[Column], Column] | None = None, **limits) -> DataFrame:
    """Difference of a corpus score, recomputed per resample from summed statistics."""
    one = [metric]
    stats = with_stats(pairs.select(id_col, current, baseline, reference), one, current, reference, normalise, "c_")
    stats = with_stats(stats, one, baseline, reference, normalise, "b_").drop(current, baseline, reference)
    columns = [*stat_names(one, "c_"), *stat_names(one, "b_")]
    indexed, n = in_order(stats, id_col, columns)  # texts are scored once
    sums = drawn_sums(indexed, n, columns, resamples, seed, **limits)

    def delta(df: DataFrame) -> DataFrame:
        count = F.lit(n)
        return df.select((final_exprs(one, count, "c_")[key] - final_exprs(one, count, "b_")[key]).alias("delta"))

    observed = delta(indexed.agg(*[F.sum(c).alias(c) for c in columns]))
    return _summary(delta(sums), observed, n, resamples)
