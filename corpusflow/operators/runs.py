"""Experiment runs: identity, curves, summaries and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import lit_map
from .aggregates import epoch_mean
from .ordinal import exact_percentiles, join_groups
from .selection import union_long, unpivot_metrics

# What the parts of a dataset code mean.
VIEWS_BY_CODE = {"FL": "frontal_lateral", "F": "frontal"}
TARGET_BY_CODE = {"F": "findings", "FI": "findings_impression"}
BASELINE_MODE = "baseline"


def experiment_identity(path: Column, root: str = "training") -> Column:
    """Identity of a run folder: the four folders after the last ``root`` component."""
    tail = F.regexp_extract(path, rf"^(?:.*/)?{root}/([^/]+)/([^/]+)/([^/]+)/([^/]+)", 0)
    parts = F.split(F.regexp_replace(tail, rf"^(?:.*/)?{root}/", ""), "/")
    lang, model, mode, data = (F.get(parts, F.lit(i)) for i in range(4))
    code = F.element_at(F.split(data, "_"), -1)
    short = F.coalesce(F.get(F.split(model, "-"), F.lit(3)), model)
    views = F.try_element_at(lit_map(VIEWS_BY_CODE), F.split_part(code, F.lit("-"), F.lit(1)))
    target = F.try_element_at(lit_map(TARGET_BY_CODE), F.split_part(code, F.lit("-"), F.lit(2)))
    base_name = F.concat_ws("_", lang, short, code)
    is_base = mode == BASELINE_MODE
    ident = F.struct(
        lang.alias("lang"), model.alias("model"), short.alias("model_short"), mode.alias("mode"), data.alias("dataset"),
        code.alias("code"), views.alias("views"), target.alias("target"),
        F.when(is_base, base_name).otherwise(F.concat_ws("_", lang, short, mode, code)).alias("name"),
        is_base.alias("is_baseline"),
        F.concat_ws("/", F.lit(root), lang, model, F.lit(BASELINE_MODE), data).alias("baseline_path"),
    )
    return F.when(tail != "", ident)


USABLE = ("completed", "early_stopped")


def usable_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin(*USABLE) & F.col("best_value").isNotNull())


def run_summary(runs: DataFrame, by: str = "model") -> DataFrame:
    """Per model: hours of all its runs, best values and stop counts of its usable runs (mean, median, extremes)."""
    ok = F.col("status").isin(*USABLE) & F.col("best_value").isNotNull()
    value = F.when(ok, F.col("best_value"))
    margin = F.col("epochs") - F.col("best_epoch")
    base = runs.groupBy(by).agg(
        F.count_if(ok).alias("n"),
        F.sum("hours").alias("hours_total"), F.avg("hours").alias("hours_mean"),
        F.min("hours").alias("hours_min"), F.max("hours").alias("hours_max"),
        F.avg(value).alias("value_mean"), F.min(value).alias("value_min"), F.max(value).alias("value_max"),
        F.count_if(ok & F.col("early_stopped")).alias("n_early_stopped"), F.count_if(ok & ~F.col("early_stopped")).alias("n_at_limit"),
        F.count_if(ok & (F.col("epochs") != 0) & (margin < 1.5)).alias("n_still_improving"),
    )
    hours = exact_percentiles(runs, [by], "hours", {"hours_median": 0.5})
    values = exact_percentiles(usable_runs(runs), [by], "best_value", {"value_median": 0.5})
    return join_groups(join_groups(base, hours, [by], "left"), values, [by], "left")


def metric_pivot(runs: DataFrame, row: str, column: str, values: list[str], metric: str = "best_value") -> DataFrame:
    return usable_runs(runs).groupBy(row).pivot(column, values).agg(F.avg(metric))


# What a baseline has to reach.
EXPECTED_EXAMPLES, MIN_ROUGE, MIN_SEPARATOR = 590, 0.02, 0.5


def acceptance_rules(baselines: DataFrame, expected: int | Column = EXPECTED_EXAMPLES) -> DataFrame:
    """Typed warnings ``(experiment, warning)`` about baseline runs."""
    n = expected if isinstance(expected, Column) else F.lit(expected)

    def plain(c: str) -> Column:
        return F.lower(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("-"), F.lit("")))

    checks = F.array_compact(F.array(
        F.when(~F.col("n").eqNullSafe(n), "example_count"),
        F.when(F.coalesce(F.col("rouge_l"), F.lit(0.0)) < MIN_ROUGE, "score_near_zero"),
        F.when((F.col("target") == "findings_impression") & (F.coalesce(F.col("sep_ratio"), F.lit(0.0)) < MIN_SEPARATOR), "separator_ratio"),
        F.when(F.coalesce(F.col("tracking_id"), F.lit("")) == "", "untracked"),
        F.when(~F.contains(plain("model_loaded"), plain("model_folder")), "model_mismatch"),
    ))
    return baselines.select("experiment", F.explode(checks).alias("warning"))


def curve_with_train_loss(validation: DataFrame, train: DataFrame, by: list[str]) -> DataFrame:
    """Evaluation rows with the mean train loss of their epoch bucket."""
    means = epoch_mean(train, by).withColumnRenamed("epoch", "_bucket")
    bucket = F.greatest(F.lit(1), F.ceil(F.col("epoch"))).cast("bigint")
    return validation.withColumn("_bucket", bucket).join(means, [*by, "_bucket"], "left").drop("_bucket")


TRAIN_METRICS = ("loss", "learning_rate")


def curve_points(train: DataFrame, validation: DataFrame, identity: list[str], sections: list[str]) -> DataFrame:
    """Tidy curve points of train rows and validation rows.

    ``train``: identity, step, epoch, elapsed_s, loss, learning_rate.
    ``validation``: identity, step, epoch, elapsed_s, val_loss, metrics (map)
    and one map column per section.
    """
    keys = [*identity, "step", "epoch", "elapsed_s"]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in TRAIN_METRICS])
    points = [train.select(*keys, F.inline(cells)).withColumn("curve", F.lit("train"))]
    loss = validation.select(*keys, F.lit("val_loss").alias("metric"), F.col("val_loss").cast("double").alias("value"))
    parts = [loss, unpivot_metrics(validation, keys, "metrics")]
    parts += [unpivot_metrics(validation, keys, s, prefix=f"{s}.") for s in sections]
    points += [p.withColumn("curve", F.lit("validation")) for p in parts]
    return union_long(*points).where(F.col("value").isNotNull())


def run_window(runs: DataFrame, by: list[str]) -> DataFrame:
    """First start, last end and total hours of the runs of a group."""
    return runs.groupBy(*by).agg(
        F.min("started_at").alias("first_start"), F.max("finished_at").alias("last_end"),
        F.sum("wall_clock_s").alias("_s"), F.count(F.lit(1)).alias("n"),
    ).withColumn("hours", F.col("_s") / 3600.0).drop("_s")
