"""Numbers, seeded draws and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite_or_null(c: Column) -> Column:
    """NaN and infinities become null."""
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), c)


def finite_frame(df: DataFrame) -> DataFrame:
    fractional = (T.DoubleType, T.FloatType)
    return df.withColumns(
        {f.name: finite_or_null(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, fractional)}
    )


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """``a / b``, or ``otherwise`` where ``b`` is zero."""
    fallback = F.lit(otherwise).cast("double")
    return F.when(b != 0, a.cast("double") / b).otherwise(fallback)


def float_ratio(a: Column, b: Column) -> Column:
    """``a / b`` as floating point has it: NaN for 0 / 0, else an infinity where ``b`` is zero; null stays null."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def draw(seed: int | str, *parts: Column) -> Column:
    """A number in 0 .. 2**60-1 that depends on the seed and the parts alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def parse_iso(c: Column) -> Column:
    return F.try_to_timestamp(c)


def hours_between(start: Column, end: Column) -> Column:
    """Hours between two timestamps of the same kind, with or without a time zone."""
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("double") / 3600.0


def epoch_bucket(epoch: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(epoch.cast("double"))).cast("bigint")
