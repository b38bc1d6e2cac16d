"""Positions, running totals and exact ranks that no single task has to hold.

A window over one hot partition would sort that partition in one task. Here
rows are range-partitioned by the whole order instead, written once, and a
small table with one row per partition carries the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _ranged(df: DataFrame, order: list) -> DataFrame:
    fixed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    return fixed.withColumn("_mid", F.monotonically_increasing_id()).withColumn(
        "_part", F.shiftright("_mid", _LOCAL_BITS)
    )


def _offsets(ranged: DataFrame, amount: Column) -> DataFrame:
    """Exclusive prefix sums over partitions: one row per partition."""
    per_part = ranged.groupBy("_part").agg(amount.alias("_amount"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("_offset"))


def with_global_index(df: DataFrame, *order, name: str = "idx") -> DataFrame:
    """Zero-based position of every row; the order must have no ties."""
    ranged = _ranged(df, list(order))
    offsets = F.broadcast(_offsets(ranged, F.count(F.lit(1))))  # one row per partition
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        ranged.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_mid", "_part", "_offset")
    )


def with_running_total(df: DataFrame, order: list, weight: str, name: str = "lo") -> DataFrame:
    """Sum of ``weight`` over all earlier rows; the order must have no ties."""
    ranged = _ranged(df, order)
    offsets = F.broadcast(_offsets(ranged, F.sum(weight)))  # one row per partition
    before = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(weight).over(before), F.lit(0))
    return (
        ranged.withColumn("_inside", inside)
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_mid", "_part", "_offset", "_inside")
    )


def with_carried(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """The last ``value`` that is not null at or before each row; the order must have no ties."""
    ranged = _ranged(df, order)
    known = F.col(value).isNotNull()
    per_part = ranged.groupBy("_part").agg(F.max_by(value, F.when(known, F.col("_mid"))).alias("_last"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(per_part.select("_part", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")))  # one row per partition
    so_far = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_inside", F.last(value, ignorenulls=True).over(so_far))
        .join(carried, "_part")
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_mid", "_part", "_inside", "_carried")
    )


def number_within(df: DataFrame, part: list[str], order: list, name: str = "rn") -> DataFrame:
    """One-based position within a group, also for a group that holds most rows."""
    indexed = with_global_index(df, *part, *order, name="_idx")
    starts = indexed.groupBy(*part).agg(F.min("_idx").alias("_start"))
    return join_groups(indexed, starts, part).select(
        *df.columns, (F.col("_idx") - F.col("_start") + 1).alias(name)
    )


def _placed_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _lo): how many rows stand before the first one with these keys. Only keys are written."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return with_running_total(counts, list(keys), "_n", name="_lo").drop("_n")


def _at_place(df: DataFrame, placed: DataFrame, keys: list[str], place: Column, name: str) -> DataFrame:
    ties = Window.partitionBy(*keys).orderBy(*keys)
    numbered = join_groups(df, placed, keys).withColumn(name, place + F.row_number().over(ties))
    return numbered.select(*df.columns, name)


def index_by_key(df: DataFrame, keys: list[str], name: str = "idx") -> DataFrame:
    """Zero-based position of every row by ``keys``, for rows with a payload: it is joined to the numbered keys, not written.

    Rows with equal keys follow each other in any order.
    """
    return _at_place(df, _placed_keys(df, keys), keys, F.col("_lo") - 1, name)


def number_by_key(df: DataFrame, part: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """``number_within`` for rows with a payload, which is joined to the numbered keys, not written."""
    keys = [*part, *order]
    placed = _placed_keys(df, keys)
    starts = placed.groupBy(*part).agg(F.min("_lo").alias("_start"))
    return _at_place(df, join_groups(placed, starts, part), keys, F.col("_lo") - F.col("_start"), name)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_row", packed).select(*df.columns, "_row.*")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of their group; a null key is a group like any other."""
    renamed = groups.withColumnsRenamed({k: f"_group_{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, key in enumerate(keys):
        on = on & F.col(key).eqNullSafe(F.col(f"_group_{i}"))
    return rows.join(renamed, on, how).drop(*[f"_group_{i}" for i in range(len(keys))])


def exact_percentiles(
    df: DataFrame, by: list[str], value: str, points: dict[str, float], upper_median: str | None = None
) -> DataFrame:
    """Exact percentiles per group by linear interpolation at rank (n-1)*p.

    ``points`` maps output names to p in 0..1. ``upper_median`` names an extra
    output holding the value at rank n div 2. Equal values are counted before
    the sort, so neither a hot group nor a hot value ends up in one task.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .select(*by, F.col(value).cast("double").alias("_v"))
        .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = with_running_total(counts, [*by, "_v"], "_n", name="_lo")
    totals = placed.groupBy(*by).agg(F.min("_lo").alias("_start"), F.sum("_n").alias("_total"))
    joined = (join_groups(placed, totals, by) if by else attach_row(placed, totals)).withColumn(
        "_lo", F.col("_lo") - F.col("_start")
    )
    first, last = F.col("_lo"), F.col("_lo") + F.col("_n") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank <= last), F.col("_v")))

    aggs, outs = [], []
    for i, (name, p) in enumerate(points.items()):
        rank = (F.col("_total") - 1) * F.lit(float(p))
        aggs += [
            at(F.floor(rank)).alias(f"_a{i}"), at(F.ceil(rank)).alias(f"_b{i}"),
            F.max(rank - F.floor(rank)).alias(f"_f{i}"),
        ]
        outs.append((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(name))
    if upper_median:
        aggs.append(at(F.floor(F.col("_total") / 2)).alias(upper_median))
        outs.append(F.col(upper_median))
    if not by:  # no values at all: 0, as for every summary of an empty run
        outs = [F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(outs, [*points, *([upper_median] if upper_median else [])], strict=True)]
    return joined.groupBy(*by).agg(*aggs).select(*by, *outs)
