"""Sorts, limits, top-k, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import lit_strings
from ..functions.scalars import draw, ratio
from ..functions.text import file_stem
from ..session import cut
from .ordinal import attach_row


def top_k(counts: DataFrame, value: str, n: str, k: int) -> DataFrame:
    return counts.orderBy(F.desc(n), F.asc(value)).limit(k)


def leaderboard(rows: DataFrame, name: str, key: str, baseline: str | None = None) -> DataFrame:
    """Rows by the chosen column, best first, nulls last; by name if it is absent."""
    if key not in rows.columns:
        return rows.orderBy(name)
    out = rows
    if baseline and baseline in rows.columns:
        out = out.withColumn("ratio_to_baseline", ratio(F.col(key), F.col(baseline), None))
    return out.orderBy(F.col(key).desc_nulls_last(), F.col(name).asc())


# Report order of models, modes and datasets.
MODELS = ("2B", "8B", "32B")
MODES = ("lora", "qlora")
DATASETS = ("F-F", "FL-F", "F-FI", "FL-FI")


def experiment_order(name: Column, models=MODELS, modes=MODES, datasets=DATASETS) -> list[Column]:
    """Sort keys (model, mode, dataset, name) of ``lang_model_mode_dataset``; unknown last."""
    parts = F.split(name, "_")

    def rank(values, i: int) -> Column:
        at = F.array_position(lit_strings(values), F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
        return F.when(at > 0, at - 1).otherwise(99)

    return [rank(models, 1), rank(modes, 2), rank(datasets, 3), name]


def numeric_stem(path: Column) -> Column:
    """File stem as a number; a stem that is none counts as 0."""
    return F.coalesce(F.when(file_stem(path).rlike(r"^\d+\z"), file_stem(path).try_cast("bigint")), F.lit(0).cast("bigint"))


def first_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """First n rows in the given order; n must lie in 1 .. size."""
    if n <= 0:
        raise ValueError("n must be greater than zero")
    out = df.orderBy(*order).limit(n)
    if df.count() < n:
        raise ValueError(f"n = {n} is more than there are rows")
    return out


def limit_records(df: DataFrame, order: list, n: int | None) -> DataFrame:
    return df.orderBy(*order).limit(n) if n else df


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """The n rows first in a seeded order that depends on the ids alone."""
    return df.orderBy(draw(seed, F.col(id_col)), id_col).limit(n)


# Most cases a probe may hold and the share with several labels.
MAX_PROBE = 30
MULTI_SHARE = 0.4


def select_probe(df: DataFrame, id_col: str, labels: str, n_healthy: int, n_sick: int, seed: int,
                 healthy: str = "No Finding", ignored: tuple[str, ...] = ("No Finding", "Other", "Unlabeled", "Support Devices")) -> DataFrame:
    """A probe of at most 30 cases: healthy ones at random, pathological ones for variety.

    Variety is reached case by case. Every step is one distributed maximum over
    the label sets' best cases; the driver keeps the ids taken so far and how
    often each of their labels was.
    """
    if min(n_healthy, n_sick) < 0 or n_healthy + n_sick == 0 or n_healthy + n_sick > MAX_PROBE:
        raise ValueError(f"a probe holds 1 to {MAX_PROBE} cases")
    rows = df.select(
        F.col(id_col).cast("string").alias("id"),
        (F.col(labels) == F.array(F.lit(healthy))).alias("_well"),
        F.array_sort(F.array_distinct(F.filter(labels, lambda l: ~l.isin(*ignored)))).alias("_path"),
    )
    well = seeded_sample(rows.where("_well"), "id", n_healthy, seed).select("id", F.lit("healthy").alias("kind"))
    sick = rows.where(F.size("_path") > 0).select(
        "id", "_path", F.when(F.size("_path") > 1, "multi").otherwise("single").alias("kind"), draw(seed, F.col("id")).alias("_tie")
    )
    # A label set can give no more cases than the probe holds; its others differ by their tie-break alone.
    best = Window.partitionBy("kind", "_path").orderBy(F.desc("_tie"), F.desc("id"))
    heads = sick.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= MAX_PROBE).drop("_r")
    frequency = sick.select("kind", F.explode("_path").alias("label")).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))
    rarity = (1.0 / F.sqrt(F.col("n"))).alias("rarity")
    weighed = heads.select("*", F.posexplode("_path").alias("_place", "label")).join(frequency.select("kind", "label", rarity), ["kind", "label"])
    cases = cut(weighed.groupBy("kind", "id", "_tie", "_path").agg(
        F.array_sort(F.collect_list(F.struct("_place", "label", "rarity"))).alias("_rare")))  # one entry per label of the case
    sizes = {r["kind"]: r["n"] for r in sick.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # two kinds
    single, multi = sizes.get("single", 0), sizes.get("multi", 0)
    n_single = min(single, n_sick - min(multi, round(n_sick * MULTI_SHARE)))
    wanted = {"single": n_single, "multi": min(multi, n_sick - n_single)}
    chosen = [(i, kind) for kind, n in wanted.items() for i in _varied_cases(cases.where(F.col("kind") == kind), n)]
    return well.unionByName(df.sparkSession.createDataFrame(chosen, "id string, kind string"))


def _varied_cases(cases: DataFrame, n: int) -> list[str]:
    """n ids, each the one whose labels are rarest and least taken by those before it."""
    chosen: list[str] = []
    taken: dict[str, int] = {}
    for _ in range(n):
        uses = F.create_map(*[F.lit(x) for pair in taken.items() for x in pair]) if taken else F.create_map().cast("map<string,int>")
        gain = F.aggregate("_rare", F.lit(0.0), lambda total, x: total + x["rarity"] / (F.coalesce(uses[x["label"]], F.lit(0)) + 1))
        open_cases = cases.where(~F.col("id").isin(chosen)) if chosen else cases
        top = open_cases.agg(F.max_by(F.struct("id", "_path"), F.struct(gain, F.col("_tie"), F.col("id"))).alias("top")).first()["top"]
        chosen.append(top["id"])
        for label in top["_path"]:
            taken[label] = taken.get(label, 0) + 1
    return chosen


def unpivot_metrics(runs: DataFrame, id_cols: list[str], metrics: str, prefix: str = "", drop: tuple[str, ...] = ("num_examples",)) -> DataFrame:
    """Rows ``(ids.., metric, value)`` of a map or struct of numbers, count fields left out."""
    kind = runs.schema[metrics].dataType
    if isinstance(kind, T.StructType):
        names = [f.name for f in kind.fields if isinstance(f.dataType, T.NumericType)]
        cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"{metrics}.{n}").cast("double").alias("value")) for n in names])
        rows = runs.select(*id_cols, F.inline(cells))
    else:
        rows = runs.select(*id_cols, F.explode(metrics).alias("metric", "value")).withColumn("value", F.col("value").cast("double"))
    return rows.where(F.col("value").isNotNull() & ~F.col("metric").isin(*drop)).withColumn(
        "metric", F.concat(F.lit(prefix), F.col("metric"))
    )


def union_long(*points: DataFrame) -> DataFrame:
    """Curve points with differing columns under one another."""
    out = points[0]
    for p in points[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def missing_metrics(expected: DataFrame, logged: DataFrame) -> DataFrame:
    return expected.select("metric").distinct().exceptAll(logged.select("metric").distinct())


def except_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def intersect_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def symmetric_diff(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Ids of one side only, with the side."""
    flags = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    sides = flags.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).where(F.col("_a") != F.col("_b"))
    return sides.select(key, F.when(F.col("_a") == 1, "left").otherwise("right").alias("side"))


def dedupe_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; rows merge on the map side."""
    packed = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return packed.select("_r.*")


def flatten_columns(df: DataFrame, separator: str = ".", arrays: str = "join") -> DataFrame:
    """Nested structs as dotted columns; arrays as ``; `` lists or as JSON."""

    def walk(schema: T.StructType, path: list[str]):
        for f in schema.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, here)
                continue
            col = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, (T.ArrayType, T.MapType)):
                simple = isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType))
                col = F.array_join(col.cast("array<string>"), "; ") if arrays == "join" and simple else F.to_json(col)
            yield col.alias(separator.join(here))

    return df.select(*walk(df.schema, []))


def varying_keys(runs: DataFrame, config: str, run: str, core: tuple[str, ...] = ()) -> DataFrame:
    """Config keys with more than one value over the runs, core keys first.

    A run without the key counts as one more value, found by comparing the
    number of runs that have the key with the number of runs.
    """
    entries = runs.select(F.col(run).alias("_run"), F.explode(config).alias("key", "value"))
    per_key = entries.groupBy("key").agg(
        F.min(F.coalesce("value", F.lit(""))).alias("_lo"), F.max(F.coalesce("value", F.lit(""))).alias("_hi"),
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("value").isNull()).alias("_nulls"),
    )
    total = runs.agg(F.count(F.lit(1)).alias("_total"))
    absent = F.col("_total") - F.col("_n") + F.col("_nulls")
    varies = (F.col("_lo") != F.col("_hi")) | ((absent > 0) & (absent < F.col("_total")))
    place = F.array_position(lit_strings(core), F.col("key"))
    return attach_row(per_key, total).where(varies).select(
        "key", (F.col("_n") - F.col("_nulls")).alias("n_set"),
        F.when(place > 0, place).otherwise(F.lit(len(core) + 1)).cast("bigint").alias("position"),
    )


def allocate(shares: DataFrame, total: int, by: list[str] | None = None) -> DataFrame:
    """Largest-remainder counts per name for ``(by.., name, ratio)``; they sum to the total.

    Holds one row per stratum, so the window is small.
    """
    by = by or []
    raw = F.col("ratio") * F.lit(total)
    base = shares.select(*by, "name", "ratio", F.floor(raw).cast("bigint").alias("_floor"), (raw - F.floor(raw)).alias("_frac"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    rank = F.row_number().over(group.orderBy(F.desc("_frac"), F.desc("name")))
    spare = F.lit(total) - F.sum("_floor").over(group)
    placed = base.withColumns({"_rank": rank, "_spare": spare})
    return placed.select(*by, "name", "ratio", (F.col("_floor") + (F.col("_rank") <= F.col("_spare")).cast("bigint")).alias("n"))


def parse_json_field(c: Column, schema: str) -> Column:
    """Struct of a JSON string; malformed text gives null."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})
