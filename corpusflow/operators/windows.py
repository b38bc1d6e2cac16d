"""Ordered operators: numbering, folds, first, last and best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_stem
from ..session import cut
from .ordinal import index_by_key, join_groups, number_by_key, with_global_index
from .pointers import followed, placed_records


def natural_order(name: Column) -> list[Column]:
    """Sort keys that put whole-number file stems first, in number order."""
    stem = file_stem(name)
    number = F.when(stem.rlike(r"^\d+\z"), stem.try_cast("decimal(38,0)"))
    return [number.isNull(), F.coalesce(number, F.lit(0).cast("decimal(38,0)")), F.when(number.isNull(), name).otherwise("")]


def new_names(df: DataFrame, study: str, label: str, file: str, extension: str = ".png") -> DataFrame:
    """``new_name``: the label for the first file of its kind in a study, then label_2, label_3."""
    keys = dict(zip(("_k0", "_k1", "_k2"), natural_order(F.col(file))))
    numbered = number_by_key(df.withColumns(keys), [study, label], ["_k0", "_k1", "_k2", file])
    suffix = F.when(F.col("rn") == 1, "").otherwise(F.concat(F.lit("_"), F.col("rn").cast("string")))
    return numbered.withColumn("new_name", F.concat(F.col(label), suffix, F.lit(extension))).drop(*keys, "rn")


def apply_renames(paths: Column, names: Column) -> Column:
    """Paths with their base names replaced where the map (old to new) has them."""

    def one(path: Column) -> Column:
        name = F.regexp_extract(path, r"([^/]*)\z", 1)
        folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
        return F.concat(folder, F.coalesce(F.try_element_at(names, name), name))

    return F.transform(paths, one)


def reverse_map(names: Column) -> Column:
    return F.map_from_arrays(F.map_values(names), F.map_keys(names))


def early_stop_fold(evals: DataFrame, run: str, step: str, value: str, mode: str = "max",
                    min_delta: float = 0.0, patience: int = 3) -> DataFrame:
    """Per run: best accepted value and step, evaluations since, and the stop step if any.

    An evaluation improves if it beats the last accepted best by more than
    ``min_delta``, which is not negative; a null or NaN never does. The fold
    ends at the first stop. Only strict record values can be accepted, so the
    accepted ones are a chain of pointers from record to record, followed by
    doubling (``pointers``).
    """
    sign = 1.0 if mode == "max" else -1.0
    number = F.col(value).cast("double")
    slim = evals.select(F.col(run).alias("run"), F.col(step).alias("step"), F.when(~F.isnan(number), number * sign).alias("v"))
    placed, records = placed_records(slim)
    sizes = placed.groupBy("run").agg(F.max("pos").alias("n"))
    best = F.coalesce("best_pos", F.lit(0).cast("bigint"))
    out = (
        join_groups(sizes, followed(records, min_delta, patience), ["run"], "left")
        .withColumn("_stop", F.when(F.col("n") - best >= patience, best + patience))
        .withColumn("since_improved", F.coalesce("_stop", "n") - best)
    )
    for name, pos in (("best_step", "best_pos"), ("stop_step", "_stop")):
        look = placed.select("run", F.col("pos").alias(pos), F.col("step").alias(name))
        out = join_groups(out, look, ["run", pos], "left")
    return out.select(
        F.col("run").alias(run), F.col("n").alias("n_evals"), "best_step",
        (F.col("best_value") * sign).alias("best_value"),
        F.coalesce("n_improved", F.lit(0).cast("bigint")).alias("n_improved"),
        "since_improved", F.col("_stop").isNotNull().alias("stopped"), "stop_step",
    )


def best_step(evals: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    """First step that attains the maximum, per group."""
    row = F.struct(F.col(step).alias("best_step"), F.col(value).alias("best_value"))
    order = F.struct(F.col(value), -F.col(step))
    known = evals.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(F.max_by(row, order).alias("_b")).select(*by, "_b.*")


def best_agreement(evals: DataFrame, run: str, step: str, overall: str, subgroup: str) -> DataFrame:
    """Best step overall and by subgroup score, and whether they agree."""
    a = best_step(evals, [run], step, overall).select(run, F.col("best_step").alias("step_overall"), F.col("best_value").alias("value_overall"))
    b = best_step(evals, [run], step, subgroup).select(run, F.col("best_step").alias("step_subgroup"), F.col("best_value").alias("value_subgroup"))
    return a.join(b, run).withColumn("agree", F.col("step_overall") == F.col("step_subgroup"))


def last_point(curve: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """First and last value of a curve and the last position."""
    key = F.struct(*order)
    return curve.groupBy(*by).agg(
        F.min_by(value, key).alias("first_value"), F.max_by(value, key).alias("last_value"),
        F.max(key).alias("_k"), F.count(F.lit(1)).alias("n"),
    ).select(*by, "n", "first_value", "last_value", F.col(f"_k.{order[0]}").alias(f"last_{order[0]}"))


def per_item_latency(marks: DataFrame, by: list[str], order: str, done: str, seconds: str) -> DataFrame:
    """Latency per finished item between progress marks, one row per item.

    The previous mark comes from a join on the position, so one long run is
    spread over all tasks. The first mark counts from zero.
    """
    slim = marks.select(*by, F.col(order).alias("_o"), F.col(done).alias("_d"), F.col(seconds).cast("double").alias("_t"))
    placed = with_global_index(slim, *by, "_o", name="_i")
    before = placed.select(
        (F.col("_i") + 1).alias("_i"), *[F.col(b).alias(f"_p_{b}") for b in by], F.col("_d").alias("_pd"), F.col("_t").alias("_pt")
    )
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_p_{b}"))
    gaps = placed.join(before, "_i", "left").withColumn("_same", F.coalesce(same & F.col("_pd").isNotNull(), F.lit(False)))
    d = F.col("_d") - F.when(F.col("_same"), F.col("_pd")).otherwise(0)
    t = F.col("_t") - F.when(F.col("_same"), F.col("_pt")).otherwise(0.0)
    return (
        gaps.select(*by, F.col("_o").alias(order), d.alias("_n"), (t / F.greatest(d, F.lit(1))).alias("latency"))
        .where(F.col("_n") >= 1)
        .withColumn("item", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n").cast("bigint")))).drop("_n")
    )


def examples_per_status(df: DataFrame, status: str, order: list, k: int) -> DataFrame:
    """First k rows of each status; k = 0 keeps all.

    The rank limit runs before the shuffle, so a hot status sends k rows per task.
    """
    if k == 0:
        return df
    w = Window.partitionBy(status).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def round_robin_panel(df: DataFrame, id_col: str, labels: str, text: Column, pattern: str, n_healthy: int,
                      n_sick: int, healthy: str = "No Finding", ignored: tuple[str, ...] = ("No Finding", "Unlabeled")) -> DataFrame:
    """First healthy rows by id, then one row per category and round until ``n_sick``.

    The first row whose text matches the pattern goes before the rounds.
    Categories go by descending size, then name; a round that adds nothing
    ends the panel. Each category keeps at most ``n_sick`` + 1 candidates,
    cut off before the shuffle.
    """
    base = cut(df.select(F.col(id_col).alias("id"), F.col(labels).alias("_l"), text.rlike(f"(?iU){pattern}").alias("_hit")))  # texts are read once
    is_well = F.col("_l") == F.array(F.lit(healthy))
    well = base.where(is_well).select("id").orderBy("id").limit(n_healthy).select(
        F.lit("healthy").alias("kind"), F.lit("").alias("category"), F.lit(0).alias("round"), "id"
    )
    category = F.array_min(F.filter("_l", lambda l: ~l.isin(*ignored)))
    sick = base.withColumn("category", category).where(F.col("category").isNotNull())
    sizes = sick.groupBy("category").agg(F.count(F.lit(1)).alias("size"))
    rank = Window.partitionBy("category").orderBy("id")
    head = sick.select("category", "id").withColumn("round", F.row_number().over(rank)).where(F.col("round") <= n_sick + 1)
    first = base.where(F.col("_hit") & ~is_well).agg(F.min("id").alias("_first")).scalar()
    rows = head.join(sizes, "category").withColumn("_dup", F.coalesce(F.col("id") == first, F.lit(False)))
    live = rows.groupBy("round").agg(F.count_if(~F.col("_dup")).alias("_added"))
    dead = live.where(F.col("_added") == 0).agg(F.coalesce(F.min("round"), F.lit(2**31 - 1))).scalar()
    picked = rows.where(~F.col("_dup") & (F.col("round") < dead)).select(
        F.lit("pathological").alias("kind"), "category", "round", "id", "size"
    )
    lead = base.where(F.col("_hit") & ~is_well).orderBy("id").limit(1).select(
        F.lit("pathological").alias("kind"), F.lit("").alias("category"), F.lit(0).alias("round"), "id",
        F.lit(0).cast("bigint").alias("size"),
    )
    chosen = lead.unionByName(picked).orderBy("round", F.desc("size"), "category").limit(n_sick)
    return well.unionByName(chosen.drop("size"))


def run_index(archives: DataFrame, live: DataFrame, run_id: str, started: str) -> DataFrame:
    """Archived runs numbered by start time, then live runs not archived yet."""
    new = live.join(archives.select(run_id), run_id, "left_anti").withColumn("_live", F.lit(True))
    both = archives.withColumn("_live", F.lit(False)).unionByName(new, allowMissingColumns=True)
    placed = index_by_key(both, ["_live", started, run_id])
    return placed.withColumn("run_idx", F.col("idx") + 1).drop("idx", "_live")
