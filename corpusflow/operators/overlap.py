"""Phrase repetition inside a corpus and overlap between corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import is_negative, mentions
from ..functions.scalars import ratio
from ..functions.text import is_blank, normal_section, sentences
from .ordinal import join_groups


def phrases(df: DataFrame, sections: dict[str, str], level: str = "sentence", by: list[str] | None = None) -> DataFrame:
    """``(by.., section, phrase, n)``: how often each phrase occurs.

    ``level='section'`` counts whole sections instead of sentences.
    """
    by = by or []

    def of(column: str) -> Column:
        if level == "sentence":
            return sentences(F.col(column))
        return F.when(is_blank(F.col(column)), F.array().cast("array<string>")).otherwise(
            F.array(normal_section(F.col(column)))
        )

    def cells_of(section: str, column: str) -> Column:
        return F.transform(of(column), lambda p: F.struct(F.lit(section).alias("section"), p.alias("phrase")))

    cells = F.concat(*[cells_of(s, c) for s, c in sections.items()])
    return df.select(*by, F.inline(cells)).groupBy(*by, "section", "phrase").agg(F.count(F.lit(1)).alias("n"))


def top_phrases(counts: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The k most frequent phrases per group, ties by phrase.

    The rank limit is applied before the shuffle, so a hot group sends at most
    k rows per task.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("phrase"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


BANDS = {"once": (1, 1), "2_4": (2, 4), "5_9": (5, 9), "10_49": (10, 49), "50_up": (50, None)}


def phrase_profile(counts: DataFrame, by: list[str]) -> DataFrame:
    """Occurrences, distinct phrases, repetition, top-ten share, hapax share and bands."""
    n = F.col("n")

    def band(low: int, high: int | None) -> Column:
        return F.count_if((n >= low) & (n <= high) if high else n >= low)

    base = counts.groupBy(*by).agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("n_distinct"),
        *[band(*edges).alias(f"band_{name}") for name, edges in BANDS.items()],
    )
    top = top_phrases(counts, by).groupBy(*by).agg(F.sum("n").alias("_top"))
    return join_groups(base, top, by).select(
        *by, "occurrences", "n_distinct",
        (F.col("occurrences") / F.col("n_distinct")).alias("repetition"),
        (F.col("_top") / F.col("occurrences")).alias("top10_share"),
        (F.col("band_once") / F.col("n_distinct")).alias("hapax_share"),
        *[f"band_{name}" for name in BANDS],
    )


def phrase_amplification(train: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """Per predicted phrase: counts, shares on both sides and their ratio (null if unseen).

    Totals, one row per group, are sent to the phrases: dealt by group, all
    phrases of a group would meet in one task.
    """
    def shared(df: DataFrame, name: str) -> DataFrame:
        total = df.groupBy(*by).agg(F.sum("n").alias("_t"))
        return df.join(F.broadcast(total), by).select(*by, "phrase", F.col("n").alias(f"n_{name}"), (F.col("n") / F.col("_t")).alias(f"share_{name}"))

    return (
        shared(pred, "pred").join(shared(train, "train"), [*by, "phrase"], "left")
        .withColumn("amplification", F.col("share_pred") / F.col("share_train"))
        .na.fill({"n_train": 0, "share_train": 0.0})
    )


def phrase_overlap(train: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """Shares of predicted phrases already in train, and mean amplification of train's top ten.

    Both sides' counts stand in one row per phrase, from one grouping; all
    shares follow from its sums.
    """
    none = F.lit(0).cast("bigint")
    sides = train.select(*by, "phrase", F.col("n").alias("n_train"), none.alias("n_pred")).unionByName(
        pred.select(*by, "phrase", none.alias("n_train"), F.col("n").alias("n_pred")))
    rows = sides.groupBy(*by, "phrase").agg(F.sum("n_train").alias("n_train"), F.sum("n_pred").alias("n_pred"))
    made, seen = F.col("n_pred") > 0, (F.col("n_pred") > 0) & (F.col("n_train") > 0)
    base = rows.groupBy(*by).agg(
        F.sum("n_train").alias("_train"), F.sum("n_pred").alias("occurrences"), F.count_if(made).alias("n_distinct"),
        F.coalesce(F.sum(F.when(seen, F.col("n_pred"))), F.lit(0)).alias("_seen"), F.count_if(seen).alias("_seen_distinct"),
    ).where(F.col("n_distinct") > 0)
    hot = top_phrases(rows.where("n_train > 0").withColumn("n", F.col("n_train")), by).where(made)
    amp = (F.col("n_pred") / F.col("occurrences")) / (F.col("n_train") / F.col("_train"))
    means = join_groups(hot, base.select(*by, "_train", "occurrences"), by).groupBy(*by).agg(F.avg(amp).alias("amp_top10"))
    return join_groups(base, means, by, "left").select(
        *by, "occurrences", "n_distinct",
        (F.col("_seen") / F.col("occurrences")).alias("copied_share"),
        (F.col("_seen_distinct") / F.col("n_distinct")).alias("copied_distinct_share"),
        (F.col("n_distinct") - F.col("_seen_distinct")).alias("n_new"),
        ((F.col("n_distinct") - F.col("_seen_distinct")) / F.col("n_distinct")).alias("new_share"),
        "amp_top10",
    )


def overlap_synthesis(train: DataFrame, pred: DataFrame, ref: DataFrame, pred_sections: DataFrame) -> DataFrame:
    """Per experiment and section: diversity, vocabulary, copying beyond the reference's own.

    ``train``, ``ref``: (section, phrase, n); ``pred`` also has ``experiment``.
    """
    by = ["experiment", "section"]
    names = pred.select(*by).distinct()

    def spread(df: DataFrame) -> DataFrame:
        return names.join(df, "section")

    pp = phrase_profile(pred, by)
    pr = phrase_profile(ref, ["section"]).select("section", F.col("n_distinct").alias("distinct_ref"), F.col("top10_share").alias("top10_ref"))
    pt = phrase_profile(train, ["section"]).select("section", F.col("n_distinct").alias("distinct_train"))
    copied = _overlap_against(train, pred, by)
    copied_ref = phrase_overlap(train, ref, ["section"]).select("section", F.col("copied_share").alias("copy_ref"))
    same = phrase_profile(pred_sections, by).select(*by, F.col("repetition").alias("section_repetition"))
    return (
        pp.select(*by, "n_distinct", "repetition", F.col("top10_share").alias("top10"))
        .join(pr, "section", "left").join(pt, "section", "left").join(copied_ref, "section", "left")
        .join(copied, by, "left").join(same, by, "left")
        .select(
            *by, "n_distinct", "distinct_ref",
            (F.col("n_distinct") / F.col("distinct_ref")).alias("diversity"),
            (F.col("n_distinct") / F.col("distinct_train")).alias("vocab_train"),
            "repetition", "top10", "top10_ref",
            F.col("copied_share").alias("copy"), "copy_ref",
            (F.col("copied_share") - F.col("copy_ref")).alias("delta_copy"),
            "new_share", "amp_top10", "section_repetition",
        )
    )


def _overlap_against(train: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """``phrase_overlap`` where the train counts carry fewer group columns than ``by``."""
    own = [c for c in by if c in train.columns]
    # Of a group one row: its total, and the last of its top ten, by which a row tells whether it is among them.
    place = lambda n: F.struct((-F.col(n)).alias("n"), F.col("phrase"))
    last = top_phrases(train, own).groupBy(*own).agg(F.max(place("n")).alias("_last"))
    known = join_groups(train.groupBy(*own).agg(F.sum("n").alias("_tt")), last, own)
    total_pred = pred.groupBy(*by).agg(F.sum("n").alias("_pt"))
    rows = pred.join(train.withColumnRenamed("n", "n_train"), [*own, "phrase"], "left").join(F.broadcast(total_pred), by).join(F.broadcast(known), own, "left")
    seen = F.col("n_train").isNotNull()
    amp = (F.col("n") / F.col("_pt")) / (F.col("n_train") / F.col("_tt"))
    return rows.groupBy(*by).agg(
        (F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)) / F.sum("n")).alias("copied_share"),
        (F.count_if(~seen) / F.count(F.lit(1))).alias("new_share"),
        F.avg(F.when(seen & (place("n_train") <= F.col("_last")), amp)).alias("amp_top10"),
    )


def synthesis_anomalies(pred: DataFrame, experiments: DataFrame) -> DataFrame:
    """Sections an experiment (experiment, target) lacks or gives unasked."""
    made = pred.groupBy("experiment").agg(
        F.max(F.col("section") == "findings").alias("_f"), F.max(F.col("section") == "impression").alias("_i")
    )
    f, i = F.coalesce(F.col("_f"), F.lit(False)), F.coalesce(F.col("_i"), F.lit(False))
    two = F.col("target") == "findings_impression"
    checks = F.array_compact(F.array(
        F.when(~f, "missing_findings"), F.when(two & ~i, "missing_impression"), F.when(~two & i, "unrequested_impression")
    ))
    return experiments.join(made, "experiment", "left").select("experiment", F.explode(checks).alias("anomaly"))


def panel_rates(rows: DataFrame, lexicon: dict[str, str], negative: str, healthy: str, by: list[str]) -> DataFrame:
    """Shares of negative texts among healthy and pathological rows, and of labels cited.

    ``rows``: labels (array), findings, impression of the prediction.
    """
    neg = is_negative(F.col("findings"), F.col("impression"), negative)
    well = F.col("labels") == F.array(F.lit(healthy))
    text = F.concat_ws(" ", "findings", "impression")
    open_labels = F.filter("labels", lambda l: l.isin(*lexicon))
    cited = F.size(mentions(text, lexicon, open_labels))
    marked = rows.select(
        *by, well.alias("_well"), neg.alias("_neg"), F.when(~well, F.size(open_labels)).alias("_open"), F.when(~well, cited).alias("_cited")
    )
    return marked.groupBy(*by).agg(
        F.count_if("_well").alias("n_healthy"),
        F.count_if(F.col("_well") & F.col("_neg")).alias("healthy_negative"),
        F.count_if(~F.col("_well")).alias("n_pathological"),
        F.count_if(~F.col("_well") & F.col("_neg")).alias("false_negative"),
        F.coalesce(F.sum("_open"), F.lit(0)).alias("n_mentionable"),
        F.coalesce(F.sum("_cited"), F.lit(0)).alias("n_cited"),
    ).select(
        "*",
        ratio(F.col("healthy_negative"), F.col("n_healthy")).alias("healthy_negative_share"),
        ratio(F.col("false_negative"), F.col("n_pathological")).alias("false_negative_share"),
        ratio(F.col("n_cited"), F.col("n_mentionable")).alias("cited_share"),
    )
