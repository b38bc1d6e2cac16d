"""Chains of accepted records followed by pointer doubling.

A fold that accepts a value only if it beats the last accepted one by a margin
is sequential as written. But what a record is followed by, once accepted, is
fixed: the first later record beyond its margin. These pointers are found by one
ordered pass over values, shortened inside chunks, and doubled by joins, so a
chain of any length takes a logarithmic number of rounds and no task holds a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .ordinal import _ranged, join_groups, with_carried

#: Records that one step of a task shortens together.
CHUNK = 4096
_HOPS = "pos bigint, to bigint, n bigint, end_pos bigint, end_v double"


def placed_records(evals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (run, step, v): all rows with ``pos`` (1, 2, 3 ... by step), and those whose ``v`` beats every earlier one of the run.

    Rows are range-partitioned once; a table of one row per partition and run in
    it carries counts and maxima from earlier partitions.
    """
    ranged = _ranged(evals, ["run", "step"])
    per_part = ranged.groupBy("_part", "run").agg(F.count(F.lit(1)).alias("_n"), F.max("v").alias("_m"), F.min("_mid").alias("_first"))
    earlier = Window.partitionBy("run").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition that the run spans
    carried = per_part.select("_part", "run", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.max("_m").over(earlier).alias("_high"))
    inside = Window.partitionBy("_part", "run").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        join_groups(ranged, carried, ["_part", "run"])
        .withColumn("pos", F.col("_before") + F.col("_mid") - F.col("_first") + 1)
        .withColumn("_over", F.greatest("_high", F.max("v").over(inside)))
    )
    record = F.coalesce(F.col("v").isNotNull() & (F.col("_over").isNull() | (F.col("v") > F.col("_over"))), F.lit(False))
    placed = cut(placed.select("run", "step", "pos", "v", record.alias("_record")))
    return placed.select("run", "step", "pos"), placed.where("_record").select("run", "pos", "v")


def least_beyond(values: np.ndarray, margin: float) -> np.ndarray:
    """For every value the least double whose difference to it, as computed, exceeds ``margin``; NaN if there is none.

    Doubles are searched in their order as bit patterns, so rounding of the
    difference is met exactly.
    """

    def ordered(x: np.ndarray) -> np.ndarray:
        bits = x.view(np.uint64)
        return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))

    def double(u: np.ndarray) -> np.ndarray:
        return np.where(u >> np.uint64(63) == 1, u & np.uint64((1 << 63) - 1), ~u).view(np.float64)

    values = np.ascontiguousarray(values, dtype=np.float64)
    low, high = ordered(values), ordered(np.full(len(values), np.inf))
    with np.errstate(invalid="ignore", over="ignore"):
        for _ in range(64):
            middle = low + ((high - low) >> np.uint64(1))
            beyond = double(middle) - values > margin
            high = np.where(beyond, middle, high)
            low = np.where(beyond, low, np.minimum(middle + np.uint64(1), high))
        found = double(high)
        return np.where(found - values > margin, found, np.nan)


def _pointers(records: DataFrame, margin: float, patience: int) -> DataFrame:
    """(run, pos, v, to): the position of the next accepted record, null where there is none within ``patience``."""

    @F.pandas_udf(T.DoubleType())
    def needed(v: pd.Series) -> pd.Series:
        least = least_beyond(v.to_numpy(), margin)
        return pd.Series(np.where(np.isnan(least), None, least), dtype="object")

    hit = F.struct(F.col("run").alias("of"), F.col("pos").alias("at"))
    known = records.select("run", F.col("v").alias("key"), F.lit(0).alias("kind"), "pos", "v", hit.alias("hit"))
    asked = records.select("run", needed("v").alias("key"), F.lit(1).alias("kind"), "pos", "v", F.lit(None).cast(known.schema["hit"].dataType).alias("hit"))
    # Among values of a run from the highest down, the last one at or above the asked is the least such, and the first in time.
    found = with_carried(known.unionByName(asked), ["run", F.desc_nulls_last("key"), "kind", "pos"], "hit", "found")
    to = F.when(F.col("found.of").eqNullSafe(F.col("run")) & F.col("key").isNotNull(), F.col("found.at"))
    return found.where("kind = 1").select("run", "pos", "v", F.when(to - F.col("pos") <= patience, to).alias("to"))


def _shortened(nodes: DataFrame) -> DataFrame:
    """(run, pos, to, n, end_pos, end_v): what a record's chain leaves its chunk for, after ``n`` records, the last of them ``end``."""
    run_type = dict(nodes.dtypes)["run"]

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)  # below a chunk and a batch
            while len(rest) >= CHUNK:
                yield one(rest.iloc[:CHUNK])
                rest = rest.iloc[CHUNK:]
        if rest is not None and len(rest):
            yield one(rest)

    def one(chunk: pd.DataFrame) -> pd.DataFrame:
        runs, pos, v, to = (chunk[c].tolist() for c in ("run", "pos", "v", "to"))
        to = [None if pd.isna(t) else int(t) for t in to]
        place = {(r, p): k for k, (r, p) in enumerate(zip(runs, pos, strict=True))}
        out: list[tuple] = [()] * len(pos)
        for k in range(len(pos) - 1, -1, -1):
            j = place.get((runs[k], to[k])) if to[k] is not None else None
            out[k] = (runs[k], pos[k], to[k], 1, pos[k], v[k]) if j is None else (runs[k], pos[k], out[j][2], out[j][3] + 1, *out[j][4:])
        return pd.DataFrame(out, columns=["run", "pos", "to", "n", "end_pos", "end_v"]).astype({"to": "Int64"})

    return nodes.repartitionByRange("run", "pos").sortWithinPartitions("run", "pos").mapInPandas(shorten, f"run {run_type}, {_HOPS}")


def followed(records: DataFrame, margin: float, patience: int) -> DataFrame:
    """(run, best_pos, best_value, n_improved) where a run's chain of accepted records ends; runs that accept none are left out.

    The first record is accepted if it comes within ``patience``.
    """
    hops = cut(_shortened(_pointers(records, margin, patience)))
    starts = hops.groupBy("run").agg(F.min("pos").alias("pos")).where(F.col("pos") <= patience)
    chain, leaving = hops, hops.where("to IS NOT NULL")
    if not leaving.isEmpty():
        entered = leaving.select("run", F.col("to").alias("pos")).unionByName(starts).distinct()
        chain = cut(join_groups(hops, entered, ["run", "pos"]))
    while chain is not hops and not chain.where("to IS NOT NULL").isEmpty():
        onward = chain.select("run", F.col("pos").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("end_pos").alias("_end_pos"), F.col("end_v").alias("_end_v"))
        chain = cut(join_groups(chain, onward, ["run", "to"], "left").select(
            "run", "pos", F.col("_to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
            F.coalesce("_end_pos", "end_pos").alias("end_pos"), F.coalesce("_end_v", "end_v").alias("end_v")))
    return join_groups(chain, starts, ["run", "pos"]).select("run", F.col("end_pos").alias("best_pos"), F.col("end_v").alias("best_value"), F.col("n").alias("n_improved"))
