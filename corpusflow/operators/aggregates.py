"""Counts, shares and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_bucket, ratio
from ..functions.text import alnum_key, is_blank, word_count
from .ordinal import attach_row, exact_percentiles, join_groups


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def dataset_stats(records: DataFrame, lists: dict[str, str], scalars: dict[str, str]) -> DataFrame:
    """Long counts ``(kind, split, value, n)``: rows per split and occurrences per value.

    A row counts once for each distinct value of a list column.
    """
    facts = [F.struct(F.lit("rows").alias("kind"), F.lit("").alias("value"))]

    def facts_of(kind: str, column: str) -> Column:
        return F.transform(F.array_distinct(column), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    listed = [facts_of(kind, c) for kind, c in lists.items()]
    single = [F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in scalars.items()]
    every = F.concat(F.array(*facts, *single), *listed)
    return (
        records.select("split", F.explode(every).alias("f")).select("split", "f.kind", "f.value")
        .where(F.col("value").isNotNull())
        .groupBy("kind", "split", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def status_summary(df: DataFrame, by: str, status: str = "status") -> DataFrame:
    """Counts and shares per ``by`` and status with TOTAL rows, from one grouping pass."""
    rolled = df.rollup(by, status).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    cells = rolled.select(
        F.when(F.col("_g") == 3, "TOTAL").otherwise(F.col(by)).alias(by),
        F.when(F.col("_g") >= 1, "TOTAL").otherwise(F.col(status)).alias(status),
        "n",
    )
    whole = F.max(F.when(F.col(status) == "TOTAL", F.col("n"))).over(Window.partitionBy(by))
    return cells.withColumn("pct", F.col("n") * 100.0 / whole)


def match_rate(df: DataFrame, by: str, good: list[str], status: str = "status") -> DataFrame:
    hit = F.col(status).isin(good)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_match"), F.avg(hit.cast("double")).alias("match_rate")
    )


def tally(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """present / absent / unknown of nullable flags, with shares."""
    by = by or []
    cells = F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("value")) for c in columns])
    counted = (
        df.select(*by, F.inline(cells)).groupBy(*by, "flag")
        .agg(
            F.count_if(F.col("value")).alias("present"),
            F.count_if(~F.col("value")).alias("absent"),
            F.count_if(F.col("value").isNull()).alias("unknown"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return counted.withColumns({f"{c}_pct": F.col(c) * 100.0 / F.col("n") for c in ("present", "absent", "unknown")})


def joint_state(a: Column, b: Column) -> Column:
    """both / only_a / only_b / neither / undetermined of two nullable flags."""
    return (
        F.when(a.isNull() | b.isNull(), "undetermined")
        .when(a & b, "both").when(a, "only_a").when(b, "only_b").otherwise("neither")
    )


def combination_counts(df: DataFrame, views: tuple[str, str], sections: tuple[str, str], n_files: str) -> DataFrame:
    """Joint view states, joint section states, complete studies and files per study, long."""
    complete = reduce(lambda x, y: x & y, [F.coalesce(F.col(c), F.lit(False)) for c in (*views, *sections)])
    cells = F.array(
        F.struct(F.lit("views").alias("kind"), joint_state(F.col(views[0]), F.col(views[1])).alias("value")),
        F.struct(F.lit("sections").alias("kind"), joint_state(F.col(sections[0]), F.col(sections[1])).alias("value")),
        F.struct(F.lit("complete").alias("kind"), F.when(complete, "yes").otherwise("no").alias("value")),
        F.struct(F.lit("files").alias("kind"), F.col(n_files).cast("string").alias("value")),
    )
    return df.select(F.inline(cells)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def joint_cube(df: DataFrame, a: str, b: str) -> DataFrame:
    """All margins of two category columns; ALL marks a margin."""
    rolled = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    return rolled.select(
        F.when(F.col("_a") == 1, "ALL").otherwise(F.col(a)).alias(a),
        F.when(F.col("_b") == 1, "ALL").otherwise(F.col(b)).alias(b),
        "n",
    )


def selection_audit(all_rows: DataFrame, used: DataFrame, key: str, predicates: dict[str, Column], rule: Column, reason: Column) -> DataFrame:
    """Long audit ``(kind, name, included, excluded)`` of which rows a selection took."""
    marked = all_rows.withColumn("_rule", rule).withColumn("_reason", reason)
    marked = marked.withColumns({f"_p{i}": p for i, p in enumerate(predicates.values())})
    marked = marked.join(used.select(key, F.lit(True).alias("_u")).distinct(), key, "left")
    u = F.coalesce(F.col("_u"), F.lit(False))

    def cell(kind: str, name: Column, inc: Column, exc: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), inc.alias("included"), exc.alias("excluded"))

    on, off = F.when(u, 1.0), F.when(~u, 1.0)
    shares = marked.agg(
        *[F.avg(on * F.col(f"_p{i}").cast("double")).alias(f"i{i}") for i in range(len(predicates))],
        *[F.avg(off * F.col(f"_p{i}").cast("double")).alias(f"e{i}") for i in range(len(predicates))],
        F.count_if(u).alias("n_used"), F.count_if(~u).alias("n_unused"),
        F.count_if(F.col("_rule")).alias("n_rule"),
        F.count_if(F.col("_rule") & ~u).alias("fp"), F.count_if(~F.col("_rule") & u).alias("fn"),
    )
    cells = [cell("share", F.lit(name), F.col(f"i{i}"), F.col(f"e{i}")) for i, name in enumerate(predicates)]
    cells += [
        cell("size", F.lit("rows"), F.col("n_used").cast("double"), F.col("n_unused").cast("double")),
        cell("rule", F.lit("size"), F.col("n_rule").cast("double"), F.lit(None).cast("double")),
        cell("rule", F.lit("false_positive"), F.lit(None).cast("double"), F.col("fp").cast("double")),
        cell("rule", F.lit("false_negative"), F.col("fn").cast("double"), F.lit(None).cast("double")),
        cell("rule", F.lit("exact"), ((F.col("fp") == 0) & (F.col("fn") == 0)).cast("double"), F.lit(None).cast("double")),
    ]
    reasons = marked.where(~u).groupBy("_reason").agg(F.count(F.lit(1)).cast("double").alias("_n")).select(
        F.lit("reason").alias("kind"), F.col("_reason").alias("name"),
        F.lit(None).cast("double").alias("included"), F.col("_n").alias("excluded"),
    )
    return shares.select(F.inline(F.array(*cells))).unionByName(reasons)


def status_by_split(df: DataFrame, statuses: list[str], splits: list[str]) -> DataFrame:
    """One row per status, one count column per split, zero where none."""
    return (
        df.groupBy("status").pivot("split", splits).agg(F.count(F.lit(1))).na.fill(0)
        .where(F.col("status").isin(statuses))
    )


def equality_rate(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    same = alnum_key(F.col(a)) == alnum_key(F.col(b))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_equal"), F.avg(same.cast("double")).alias("equal_rate")
    )


MISSES = ("BAD_ID", "SOURCE_MISSING", "NO_SOURCE")


def similarity_stats(matched: DataFrame, key: str, value: str = "jaccard") -> DataFrame:
    """Mean and upper median of the similarity of matched rows, and distinct keys used."""
    scored = matched.where(~F.col("status").isin(*MISSES))
    median = exact_percentiles(scored, [], value, {}, upper_median="median")
    summary = scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.count_distinct(F.col(key)).alias("n_keys")
    )
    return attach_row(summary, median)


def mean_with_zeros(df: DataFrame, score: Column, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Mean over all pairs where a pair with a blank side counts as zero."""
    usable = ~is_blank(F.col(a)) & ~is_blank(F.col(b))
    total = F.coalesce(F.sum(F.when(usable, score)), F.lit(0.0))
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(usable).alias("n_scored"),
        ratio(total, F.count(F.lit(1))).alias("score"),
    )


LATENCY_POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_summary(df: DataFrame, by: list[str], seconds: str = "seconds") -> DataFrame:
    """Percentiles, mean, extremes, sample deviation and throughput per group."""
    basic = df.where(F.col(seconds).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(seconds).alias("mean"), F.min(seconds).alias("min"), F.max(seconds).alias("max"),
        F.stddev_samp(seconds).alias("stdev"), F.sum(seconds).alias("_total"),
    ).withColumn("throughput", ratio(F.col("n"), F.col("_total"))).drop("_total")
    points = exact_percentiles(df, by, seconds, LATENCY_POINTS)
    return join_groups(basic, points, by) if by else attach_row(basic, points)


def load_curve(df: DataFrame, size: str = "batch_size", seconds: str = "seconds", tokens: str = "tokens") -> DataFrame:
    """Per batch size: batch times, throughput, token rate and time per request; failures counted."""
    ok = F.col(seconds).isNotNull()
    total = F.sum(seconds)
    return df.groupBy(size).agg(
        F.count(F.lit(1)).alias("n_batches"), F.count_if(~ok).alias("n_failed"),
        F.avg(seconds).alias("mean"), F.min(seconds).alias("min"), F.max(seconds).alias("max"),
        ratio(F.sum(F.when(ok, F.col(size))), total).alias("throughput"),
        ratio(F.sum(F.when(ok, F.col(tokens))), total).alias("tokens_per_s"),
        (F.avg(seconds) / F.max(size)).alias("amortised"),
    )


def compare_metrics(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Long ``(metric, value)`` frames side by side; relative change null for a zero base."""
    base = baseline.select("metric", F.col("value").alias("baseline"))
    delta = F.col("value") - F.col("baseline")
    return (
        current.where(F.col("value").isNotNull()).join(base.where(F.col("baseline").isNotNull()), "metric")
        .select(
            "metric", F.col("value").alias("current"), "baseline", delta.alias("delta"),
            (delta / F.nullif(F.col("baseline"), F.lit(0.0)) * 100.0).alias("rel_pct"),
            (delta > 0).alias("beats"),
        )
    )


def format_compliance(df: DataFrame, has_format: Column, expected: bool, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Share of outputs in the expected format, and the ids that are not; nulls if none is expected."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(has_format).alias("_ok"))
    null = F.lit(None)
    summary = counts.select(
        "total",
        (F.col("_ok") if expected else null.cast("bigint")).alias("compliant"),
        ((F.col("total") - F.col("_ok")) if expected else null.cast("bigint")).alias("missing"),
        (F.bround(F.col("_ok") / F.greatest(F.col("total"), F.lit(1)), 4) if expected else null.cast("double")).alias("ratio"),
    )
    return summary, df.where(~has_format if expected else F.lit(False)).select(id_col)


def reference_violations(df: DataFrame, has_format: Column, expected: bool, id_col: str = "id") -> DataFrame:
    """References that break the format they are expected to have; any of them makes the scores meaningless."""
    broken = df.where(~F.coalesce(has_format, F.lit(False))) if expected else df.limit(0)
    return broken.select(F.lit("reference_format").alias("rule"), F.col(id_col).cast("string").alias("id"))


def label_weights(records: DataFrame, labels: str, vocab: tuple[str, ...], cap: float) -> DataFrame:
    """``(label, n, weight)``: inverse root frequency over its median, at most ``cap``.

    One row per vocabulary label that occurs.
    """
    counts = (
        records.select(F.explode(labels).alias("label")).where(F.col("label").isin(*vocab))
        .groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    )
    raw = counts.withColumn("raw", 1.0 / F.sqrt("n"))
    # At most one row per vocabulary label, so the built-in exact percentile is bounded.
    middle = raw.agg(F.percentile("raw", 0.5).alias("_mid"))
    return attach_row(raw, middle).select(
        "label", "n", F.least(F.lit(float(cap)), F.col("raw") / F.col("_mid")).alias("weight")
    )


def record_weights(records: DataFrame, labels: str, weights: DataFrame, vocab: tuple[str, ...]) -> DataFrame:
    """Records with ``weight``: the highest weight of their labels, else 1."""
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("_w"))  # <= vocabulary
    own = F.transform(F.col(labels), lambda l: F.try_element_at(F.col("_w"), l))
    return attach_row(records, table).withColumn("weight", F.coalesce(F.array_max(own), F.lit(1.0))).drop("_w")


def label_frequencies(records: DataFrame, labels: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return records.select(*by, F.explode(labels).alias("label")).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))


def length_profile(df: DataFrame, text: str, limit: int, by: list[str] | None = None, size=word_count) -> DataFrame:
    """Length percentiles (cut to whole numbers), extremes, mean and rows over the limit."""
    by = by or []
    sized = df.select(*by, size(F.col(text)).alias("_n"))
    basic = sized.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("_n").alias("min"), F.max("_n").alias("max"),
        F.avg("_n").alias("mean"), F.count_if(F.col("_n") > limit).alias("n_over"),
    )
    points = exact_percentiles(sized, by, "_n", {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    points = points.withColumns({c: F.floor(F.round(F.col(c), 9)).cast("bigint") for c in ("median", "p90", "p95", "p99")})
    return join_groups(basic, points, by) if by else attach_row(basic, points)


def over_limit(df: DataFrame, text: str, limit: int, id_col: str, size=word_count) -> DataFrame:
    return df.where(size(F.col(text)) > limit).select(id_col)


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """Weighted mean; rows of no weight are counted and left out, a group without any weight is an error."""
    w = F.col(weight)
    nothing = F.raise_error(F.lit(f"the weights of {weight} are all zero")).cast("double")
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(w == 0).alias("n_zero"),
        F.when(F.coalesce(F.sum(w), F.lit(0)) == 0, nothing).otherwise(F.try_divide(F.sum(F.when(w != 0, F.col(value) * w)), F.sum(w))).alias("mean"),
    )


def translation_qc(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per text column: filled sources and outputs, missing outputs, both, and text lengths."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("")).alias("s"), F.coalesce(F.col(o), F.lit("")).alias("o"))
        for c, o in columns.items()
    ])
    s, o = ~is_blank(F.col("s")), ~is_blank(F.col("o"))
    size = F.when(s, F.length("s"))
    return df.select(F.inline(cells)).groupBy("column").agg(
        F.count_if(s).alias("n_source"), F.count_if(o).alias("n_output"),
        F.count_if(s & ~o).alias("n_missing"), F.count_if(s & o).alias("n_both"),
        F.avg(size).alias("mean_len"), F.min(size).alias("min_len"), F.max(size).alias("max_len"),
    )


def group_share(df: DataFrame, by: str, group: str) -> DataFrame:
    """Counts per group and their share in the total of ``by``; the window sees only counts."""
    counts = df.groupBy(by, group).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def epoch_mean(curve: DataFrame, by: list[str], epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    known = curve.where(F.col(epoch).isNotNull() & F.col(loss).isNotNull())
    return known.groupBy(*by, epoch_bucket(F.col(epoch)).alias("epoch")).agg(F.avg(loss).alias("mean_loss"))
