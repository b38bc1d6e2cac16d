"""Differences and symmetry of pixel rows held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import let



def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def vector_diff(a: Column, b: Column) -> Column:
    """``struct(max_abs, mean_abs, pct_different)``; null for unequal lengths."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    size = F.size(a)
    fits = (size == F.size(b)) & (size > 0)
    differing = F.size(F.filter(gaps, lambda g: g != 0))
    return F.when(
        fits,
        F.struct(
            F.array_max(gaps).alias("max_abs"),
            F.round(_sum(gaps) / size, 6).alias("mean_abs"),
            F.round(differing * 100.0 / size, 6).alias("pct_different"),
        ),
    )


def mirror_symmetry(values: Column, width: int) -> Column:
    """Mean product of the standardised image with its left-right mirror.

    ``values`` is the image row by row, ``width`` values each.
    """
    numbers = F.transform(values, lambda x: x.cast("double"))

    def centre(v: Column) -> Column:
        return let(lambda m: score(m.d), d=F.transform(v.x, lambda x: x - v.mean))

    def score(d: Column) -> Column:
        size = F.size(d)
        spread = F.sqrt(_sum(F.transform(d, lambda x: x * x)) / size) + F.lit(1e-6)
        rows = F.sequence(F.lit(0), (size / width).cast("int") - 1)
        mirrored = F.flatten(F.transform(rows, lambda r: F.reverse(F.slice(d, r * width + 1, width))))
        return _sum(F.zip_with(d, mirrored, lambda x, y: x * y)) / size / (spread * spread)

    return let(lambda v: let(centre, x=v.x, mean=_sum(v.x) / F.size(v.x)), x=numbers)


def scored_by_key(images: DataFrame, key: str, score: Column, table: DataFrame) -> DataFrame:
    """``(key, score, fresh)``: scores kept in ``table`` (key, score), and computed ones for keys it lacks.

    Append the fresh rows to the table, and the next call computes them no more.
    """
    kept = images.select(key).distinct().join(table.select(key, "score"), key).withColumn("fresh", F.lit(False))
    new = images.join(table.select(key), key, "left_anti").select(key, score.alias("score")).dropDuplicates([key])
    return kept.unionByName(new.withColumn("fresh", F.lit(True)))


def symmetry_flags(score: Column, threshold: float) -> tuple[Column, Column]:
    """Aggregates (frontal, lateral) of a study: any score at or above, any below the threshold."""
    return F.bool_or(score >= threshold), F.bool_or(score < threshold)


def compare_sets(a: Column, b: Column) -> Column:
    """``struct(status, detail)`` of two digest lists.

    A digest starting with ``!`` marks a file that could not be read:
    ``!FILE_MISSING`` or ``!UNREADABLE``.
    """
    bad = F.filter(F.concat(a, b), lambda d: d.startswith("!"))
    positions = F.sequence(F.lit(0), F.size(a) - 1)
    differing = F.filter(positions, lambda i: F.get(a, i) != F.get(b, i))
    permutation = F.transform(b, lambda d: F.array_position(a, d) - 1)
    status = (
        F.when(F.size(a) != F.size(b), "COUNT_MISMATCH")
        .when(
            F.size(bad) > 0,
            F.when(F.forall(bad, lambda d: d == "!FILE_MISSING"), "FILE_MISSING").otherwise("UNREADABLE"),
        )
        .when(a == b, "IDENTICAL")
        .when(F.array_sort(a) == F.array_sort(b), "PERMUTED")
        .otherwise("CONTENT_MISMATCH")
    )
    detail = (
        F.when(status == "PERMUTED", F.array_join(permutation.cast("array<string>"), ","))
        .when(status == "CONTENT_MISMATCH", F.array_join(differing.cast("array<string>"), ","))
        .when(status.isin("FILE_MISSING", "UNREADABLE"), F.array_join(bad, ";"))
        .otherwise("")
    )
    return F.struct(status.alias("status"), F.coalesce(detail, F.lit("")).alias("detail"))
