"""Pair metrics as per-row statistics, sums and final expressions.

A metric states which numbers one pair contributes and how its scores follow
from the sums. Sums combine on the map side, so the same metric serves a
corpus, its sections, its subgroups and every bootstrap resample.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import BLEU_ORDERS, bleu_stats, lcs_stats, ngram_stats
from ..functions.scalars import ratio
from ..functions.text import is_blank, split_sections
from .ordinal import attach_row, join_groups

Exprs = dict[str, Column]


@dataclass(frozen=True)
class GroupedMetric:
    """``stats(prediction, reference)`` per row; ``finals(sums, n)`` per group."""

    name: str
    keys: tuple[str, ...]
    stats: Callable[[Column, Column], Exprs]
    finals: Callable[[Exprs, Column], Exprs]


# Smoothing constants of the public caption scorer.
TINY, SMALL = 1e-15, 1e-9


def _bleu_stats(prediction: Column, reference: Column) -> Exprs:
    s = bleu_stats(prediction, reference)
    names = ["pred_len", "ref_len", *(f"{k}_{n}" for n in BLEU_ORDERS for k in ("match", "guess"))]
    return {n: s[n] for n in names}


def _bleu_finals(s: Exprs, n: Column) -> Exprs:
    length = (s["pred_len"] + TINY) / (s["ref_len"] + SMALL)
    brevity = F.when(length < 1, F.exp(1 - 1 / length)).otherwise(F.lit(1.0))
    out, product = {}, F.lit(1.0)
    for k in BLEU_ORDERS:
        product = product * (s[f"match_{k}"] + TINY) / (s[f"guess_{k}"] + SMALL)
        score = F.pow(product, F.lit(1.0 / k)) * brevity
        out[f"bleu_{k}"] = F.when(n > 0, score).otherwise(F.lit(0.0))
    return {"bleu": out["bleu_4"], **out}


def f1(common: Column, a: Column, b: Column) -> Column:
    """F1 of an overlap with two sizes; zero if either is empty."""
    return ratio(2.0 * common, a + b)


def _guarded(s: Column, value: Column) -> Column:
    return F.when((s["pred_len"] > 0) & (s["ref_len"] > 0), value).otherwise(F.lit(0.0))


def _rouge_n_stats(prediction: Column, reference: Column) -> Exprs:
    s = ngram_stats(prediction, reference)
    p, r = s["pred_len"], s["ref_len"]
    bigrams = [F.greatest(x - 1, F.lit(0).cast("bigint")) for x in (p, r)]
    return {"rouge1": _guarded(s, f1(s["overlap_1"], p, r)), "rouge2": _guarded(s, f1(s["overlap_2"], *bigrams))}


def _rouge_l_stats(prediction: Column, reference: Column) -> Exprs:
    s = lcs_stats(prediction, reference)
    return {"rougeL": _guarded(s, f1(s["lcs"], s["pred_len"], s["ref_len"]))}


def _rouge_stats(prediction: Column, reference: Column) -> Exprs:
    return _rouge_n_stats(prediction, reference) | _rouge_l_stats(prediction, reference)


def _mean_finals(s: Exprs, n: Column) -> Exprs:
    return {k: F.when(n > 0, v / n).otherwise(F.lit(0.0)) for k, v in s.items()}


BLEU = GroupedMetric("bleu", ("bleu", "bleu_1", "bleu_2", "bleu_3", "bleu_4"), _bleu_stats, _bleu_finals)
ROUGE = GroupedMetric("rouge", ("rouge1", "rouge2", "rougeL"), _rouge_stats, _mean_finals)
# Parts of it: subsequences cost far more than n-grams.
ROUGE_N = GroupedMetric("rouge_n", ("rouge1", "rouge2"), _rouge_n_stats, _mean_finals)
ROUGE_L = GroupedMetric("rouge_l", ("rougeL",), _rouge_l_stats, _mean_finals)


def mean_metric(name: str, score: Callable[[Column, Column], Column]) -> GroupedMetric:
    """Mean of a per-pair score; pairs with a blank side count as zero."""

    def stats(p: Column, r: Column) -> Exprs:
        return {name: F.when(~is_blank(p) & ~is_blank(r), score(p, r)).otherwise(F.lit(0.0))}

    return GroupedMetric(name, (name,), stats, _mean_finals)


REGISTRY: dict[str, GroupedMetric] = {"bleu": BLEU, "rouge": ROUGE, "rougeL": ROUGE}
TARGET_SECTIONS = {"findings": ("findings",), "findings_impression": ("findings", "impression")}


def select_metrics(names: list[str], registry: dict[str, GroupedMetric] | None = None) -> list[GroupedMetric]:
    """Metrics by name, each once; an unknown name is an error."""
    known = registry or REGISTRY
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known: {sorted(known)}")
    return list({known[n].name: known[n] for n in names}.values())


def metric_keys(names: list[str], target: str | None = None) -> list[str]:
    """Names of the scores a selection yields, per section if a target kind is given."""
    keys = ["num_examples", *(k for m in select_metrics(names) for k in m.keys)]
    if target is None:
        return keys
    return [f"{s}.{k}" for s in TARGET_SECTIONS[target] for k in keys] + ["val_loss"]


def with_stats(df: DataFrame, metrics: list[GroupedMetric], prediction: str = "prediction", reference: str = "reference",
               normalise: Callable[[Column], Column] | None = None, prefix: str = "") -> DataFrame:
    """Per-row statistics of every metric, as columns ``{prefix}{metric}__{stat}``."""
    apply = normalise or (lambda c: c)
    p, r = apply(F.col(prediction)), apply(F.col(reference))
    return df.withColumns({f"{prefix}{m.name}__{k}": c for m in metrics for k, c in m.stats(p, r).items()})


def stat_names(metrics: list[GroupedMetric], prefix: str = "") -> list[str]:
    none = F.lit("")
    return [f"{prefix}{m.name}__{k}" for m in metrics for k in m.stats(none, none)]


def sum_exprs(metrics: list[GroupedMetric]) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stat_names(metrics)]


def final_exprs(metrics: list[GroupedMetric], n: Column, prefix: str = "") -> Exprs:
    """Score columns from summed statistics."""
    none, out = F.lit(""), {}
    for m in metrics:
        sums = {k: F.col(f"{prefix}{m.name}__{k}") for k in m.stats(none, none)}
        out.update(m.finals(sums, n))
    return out


def score(df: DataFrame, metrics: list[GroupedMetric], by: list[str] | None = None, prediction: str = "prediction",
          reference: str = "reference", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Scores per group from one pass over the pairs."""
    by = by or []
    stats = with_stats(df.select(*by, prediction, reference), metrics, prediction, reference, normalise)
    sums = stats.groupBy(*by).agg(F.count(F.lit(1)).alias("num_examples"), *sum_exprs(metrics))
    finals = final_exprs(metrics, F.col("num_examples"))
    return sums.select(*by, "num_examples", *[c.alias(k) for k, c in finals.items()])


def sectioned(df: DataFrame, target: str, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """One row per pair and section of the target kind; an absent section is empty."""
    p, r = split_sections(F.col(prediction)), split_sections(F.col(reference))
    rest = [c for c in df.columns if c not in (prediction, reference)]
    cells = F.array(*[
        F.struct(
            F.lit(s).alias("section"),
            F.coalesce(F.col(f"_p.{s}"), F.lit("")).alias(prediction),
            F.coalesce(F.col(f"_r.{s}"), F.lit("")).alias(reference),
        )
        for s in TARGET_SECTIONS[target]
    ])
    return df.withColumns({"_p": p, "_r": r}).select(*rest, F.inline(cells))


def sectioned_metrics(df: DataFrame, target: str, metrics: list[GroupedMetric], by: list[str] | None = None) -> DataFrame:
    return score(sectioned(df, target), metrics, [*(by or []), "section"])


def factor_groups(df: DataFrame, factors: dict[str, str]) -> DataFrame:
    """Rows repeated once per factor and value; list factors give one row per value."""
    is_list = {f.name: f.dataType.typeName() == "array" for f in df.schema.fields}

    def cells(name: str, column: str) -> Column:
        values = F.col(column) if is_list[column] else F.array(F.col(column))
        return F.transform(
            F.filter(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>")), lambda v: v.isNotNull()),
            lambda v: F.struct(F.lit(name).alias("factor"), v.alias("value")),
        )

    every = F.concat(*[cells(n, c) for n, c in factors.items()])
    return df.select(*df.columns, F.inline(every))


def disaggregate(df: DataFrame, factors: dict[str, str], metrics: list[GroupedMetric], min_size: int = 20,
                 known: DataFrame | None = None) -> DataFrame:
    """Scores per factor value; small groups and known empty ones are not estimable.

    Statistics are computed once per pair, before the pair is repeated per group.
    """
    names = stat_names(metrics)
    columns = list(factors.values())
    stats = with_stats(df.select(*columns, "prediction", "reference"), metrics).select(*columns, *names)
    groups = factor_groups(stats, factors).groupBy("factor", "value").agg(
        F.count(F.lit(1)).alias("n"), *sum_exprs(metrics)
    )
    finals = final_exprs(metrics, F.col("n"))
    enough = F.col("n") >= min_size
    out = groups.select(
        "factor", "value", "n", F.when(enough, "ok").otherwise("not_estimable").alias("status"),
        *[F.when(enough, c).alias(k) for k, c in finals.items()],
    )
    if known is None:
        return out
    every = known.select("factor", "value").distinct().join(out, ["factor", "value"], "full_outer")
    return every.withColumns({
        "n": F.coalesce("n", F.lit(0).cast("bigint")), "status": F.coalesce("status", F.lit("not_estimable"))
    })


def python_metric(name: str, keys: tuple[str, ...], fn: Callable[[list[str], list[str]], list[tuple[float, ...]]]) -> GroupedMetric:
    """A plain Python metric: ``fn`` gives each pair's scores, Spark averages them.

    ``fn`` sees Arrow batches of pairs, never a whole group.
    """
    schema = T.StructType([T.StructField(k, T.DoubleType()) for k in keys])

    @F.pandas_udf(schema)
    def kernel(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(fn(pred.tolist(), ref.tolist()), columns=list(keys))

    def stats(p: Column, r: Column) -> Exprs:
        scores = kernel(p, r)
        return {k: scores[k] for k in keys}

    return GroupedMetric(name, keys, stats, _mean_finals)


def score_distinct(df: DataFrame, text: str, make_scorer: Callable[[], Callable[[list[str]], list[float]]], name: str = "score") -> DataFrame:
    """Model-backed scores: each distinct text is scored once, the model is set up once per task."""

    def run(batches):
        scorer = make_scorer()
        for pdf in batches:
            yield pd.DataFrame({"_key": pdf["_key"], name: scorer(pdf["_text"].tolist())})

    keyed = df.withColumn("_key", F.sha2(F.col(text), 256))  # texts are shuffled once, and met by their digest
    unique = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.first(text).alias("_text"))
    scored = unique.mapInPandas(run, f"_key string, {name} double")
    return keyed.join(scored, "_key", "left").drop("_key")


def multilabel_counts(df: DataFrame, pred: str, ref: str, vocab: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """True and false positives and misses per class, from one pass without repeating rows."""
    by = by or []
    aggs = []
    for i, label in enumerate(vocab):
        p, r = F.array_contains(pred, label), F.array_contains(ref, label)
        aggs += [F.count_if(p & r).alias(f"tp{i}"), F.count_if(p & ~r).alias(f"fp{i}"), F.count_if(~p & r).alias(f"fn{i}")]
    cells = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn")])
        for i, label in enumerate(vocab)
    ])
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(cells))


def _prf(tp: Column, fp: Column, fn: Column) -> Exprs:
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def multilabel_classes(df: DataFrame, pred: str, ref: str, vocab: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    counts = multilabel_counts(df, pred, ref, vocab, by)
    scores = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(
        *(by or []), "label", *[c.alias(k) for k, c in scores.items()], (F.col("tp") + F.col("fn")).alias("support")
    )


def multilabel_summary(df: DataFrame, pred: str, ref: str, vocab: tuple[str, ...], main: tuple[str, ...] | None = None,
                       fallbacks: tuple[str, ...] = (), by: list[str] | None = None) -> DataFrame:
    """Micro and macro scores over ``main``, exact-match accuracy over ``vocab``, fallback rate."""
    by = by or []
    main = main or vocab
    sides = df.select(*by, F.col(pred).alias("_p"), F.col(ref).alias("_r"))

    def within(column: str) -> Column:
        return F.array_sort(F.array_intersect(column, F.array(*[F.lit(v) for v in vocab])))

    flags = sides.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_examples"),
        F.avg((within("_p") == within("_r")).cast("double")).alias("accuracy_exact"),
        *([F.avg(F.arrays_overlap("_p", F.array(*[F.lit(v) for v in fallbacks])).cast("double"))
           .alias("fallback_prediction_rate")] if fallbacks else []),
    )
    counts = multilabel_counts(df, pred, ref, main, by)
    per_class = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    sums = [F.sum(k) for k in ("tp", "fp", "fn")]
    scores = counts.groupBy(*by).agg(
        *[F.avg(c).alias(f"{k}_macro") for k, c in per_class.items()],
        *[c.alias(f"{k}_micro") for k, c in _prf(*sums).items()],
    )
    return join_groups(flags, scores, by) if by else attach_row(flags, scores)


def multilabel_report(df: DataFrame, pred: str, ref: str, vocab: tuple[str, ...], main: tuple[str, ...] | None = None,
                      fallbacks: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Summary and per-class scores; no rows is an error."""
    if df.isEmpty():
        raise ValueError("no rows to score")
    return multilabel_summary(df, pred, ref, vocab, main, fallbacks), multilabel_classes(df, pred, ref, vocab)

