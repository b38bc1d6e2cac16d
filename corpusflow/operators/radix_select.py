"""Exact percentiles by radix selection: no sort, and no value is written.

A double's bits, with the negative half turned round, are a whole number in the
order of the values. A pass counts, per group, the next 16 bits of the values
that share the bits known so far with a wanted rank, and finds the digit in
which each rank lies. Four passes know all bits. All ranks of all groups go
through a pass together; a pass shuffles counts, at most 65,536 per group and
open prefix.

Values are read once per pass. A frame that is dear to compute is better served
by ``ordinal.exact_percentiles``, which reads it once and sorts what is distinct.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordinal import attach_row, join_groups

DIGIT, BITS = 16, 64
_SIGN = np.int64(0x7FFFFFFFFFFFFFFF)


@F.arrow_udf("bigint")
def _ordered_bits(values: pa.Array) -> pa.Array:
    """Whole numbers in the order of the doubles; -0.0 is 0.0, NaN the greatest."""
    known = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    known = np.where(np.isnan(known), np.nan, known + 0.0)
    bits = np.ascontiguousarray(known).view(np.int64)
    return pa.array(bits ^ ((bits >> np.int64(63)) & _SIGN), pa.int64())


@F.arrow_udf("double")
def _of_ordered_bits(keys: pa.Array) -> pa.Array:
    known = keys.fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array((known ^ ((known >> np.int64(63)) & _SIGN)).view(np.float64), pa.float64())


def _found(counts: DataFrame, by: list[str], prefix: str, wanted: Column) -> DataFrame:
    """Of counts per digit below a prefix, the digits in which the wanted ranks lie: (by, _digit, _ranks)."""
    order = Window.partitionBy(*by, prefix).orderBy("_digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 2^DIGIT rows at most
    placed = counts.withColumn("_upto", F.sum("_n").over(order)).withColumn("_before", F.col("_upto") - F.col("_n")).withColumn("_all", wanted)
    inside = F.filter("_all", lambda w: (w.rank >= F.col("_before")) & (w.rank < F.col("_upto")))
    left = F.transform(inside, lambda w: F.struct(w.slot.alias("slot"), (w.rank - F.col("_before")).alias("rank")))
    return placed.where(F.size(inside) > 0).select(*by, F.col("_digit").alias("_prefix"), left.alias("_ranks"))


def percentiles_by_digits(df: DataFrame, by: list[str], value: str, points: dict[str, float], upper_median: str | None = None) -> DataFrame:
    """As ``ordinal.exact_percentiles``: linear interpolation at rank (n-1)*p per group; nulls do not count."""
    number = F.col(value).cast("double")
    keyed = df.where(F.col(value).isNotNull()).select(*by, _ordered_bits(number).alias("_key"))
    slots = [f for k in range(len(points)) for f in (f"{k}a", f"{k}b")] + (["m"] if upper_median else [])

    def ranks(n: Column) -> Column:
        """The places of all slots among ``n`` values."""
        out = []
        for k, p in enumerate(points.values()):
            at = (n - 1) * F.lit(float(p))
            out += [(f"{k}a", F.floor(at)), (f"{k}b", F.ceil(at))]
        if upper_median:
            out.append(("m", F.floor(n / 2)))
        return F.array(*[F.struct(F.lit(s).alias("slot"), r.cast("bigint").alias("rank")) for s, r in out])

    def digit(shift: int) -> Column:
        return F.shiftright("_key", shift)

    top = keyed.groupBy(*by, digit(BITS - DIGIT).alias("_digit")).agg(F.count(F.lit(1)).alias("_n"))
    top = cut(top.withColumn("_prefix", F.lit(0)))
    totals = cut(top.groupBy(*by).agg(F.sum("_n").alias("_total")))
    with_total = join_groups(top, totals, by) if by else attach_row(top, totals)
    open_ranks = cut(_found(with_total, by, "_prefix", ranks(F.col("_total"))))
    for shift in range(BITS - 2 * DIGIT, -1, -DIGIT):
        placed = keyed.withColumn("_prefix", digit(shift + DIGIT))
        counts = join_groups(placed, open_ranks.select(*by, "_prefix").distinct(), [*by, "_prefix"], "left_semi").groupBy(
            *by, "_prefix", digit(shift).alias("_digit")).agg(F.count(F.lit(1)).alias("_n"))
        wanted = open_ranks.groupBy(*by, "_prefix").agg(F.flatten(F.collect_list("_ranks")).alias("_wanted"))  # the slots of a group
        open_ranks = cut(_found(join_groups(counts, wanted, [*by, "_prefix"]), by, "_prefix", F.col("_wanted")))
    known = open_ranks.select(*by, _of_ordered_bits("_prefix").alias("_v"), F.explode("_ranks.slot").alias("_slot"))
    wide = known.groupBy(*by).agg(*[F.max(F.when(F.col("_slot") == s, F.col("_v"))).alias(f"_{s}") for s in slots])
    joined = join_groups(wide, totals, by) if by else attach_row(wide, totals)
    outs = []
    for k, (name, p) in enumerate(points.items()):
        at = (F.col("_total") - 1) * F.lit(float(p))
        outs.append((F.col(f"_{k}a") + (F.col(f"_{k}b") - F.col(f"_{k}a")) * (at - F.floor(at))).alias(name))
    if upper_median:
        outs.append(F.col("_m").alias(upper_median))
    if not by:  # no values at all: 0, as for every summary of an empty run
        outs = [F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(outs, [*points, *([upper_median] if upper_median else [])], strict=True)]
    return joined.select(*by, *outs)
