"""Evaluation jobs over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import dense_format_report, parse_label_lines
from ..functions.text import split_sections
from ..functions.vocabulary import Vocabulary
from ..operators.aggregates import compare_metrics
from ..operators.joins import cyclic_pairing
from ..operators.metrics import multilabel_summary
from ..operators.ordinal import attach_row
from ..operators.selection import unpivot_metrics


def validation_payload(df: DataFrame, vocab: Vocabulary, target_format: str, epoch: float, step: int) -> DataFrame:
    """One row per sample: texts, sections, parsed labels and format diagnostics."""
    sections = {"_p": split_sections(F.col("prediction")), "_r": split_sections(F.col("reference"))}
    fmt = dense_format_report(F.col("prediction"), vocab)
    return df.withColumns({**sections, "_fmt": fmt}).select(
        "id", "reference", "prediction",
        F.col("_r.findings").alias("reference_findings"), F.col("_r.impression").alias("reference_impression"),
        F.col("_p.findings").alias("prediction_findings"), F.col("_p.impression").alias("prediction_impression"),
        parse_label_lines(F.col("reference"), vocab, target_format).alias("labels"),
        parse_label_lines(F.col("prediction"), vocab, target_format).alias("predicted_labels"),
        F.col("_fmt.complete").alias("complete"), F.col("_fmt.recognized_count").alias("recognized_count"),
        F.lit(float(epoch)).alias("epoch"), F.lit(int(step)).alias("step"),
    )


def _long(summary: DataFrame) -> DataFrame:
    return unpivot_metrics(summary.select(F.struct(*[c for c in summary.columns if c != "num_examples"]).alias("m")), [], "m")


def contrast_eval(df: DataFrame, vocab: Vocabulary, seed: int, predict=None) -> tuple[DataFrame, DataFrame]:
    """Scores with every row given another row's payload, minus the plain scores.

    ``df`` holds id, labels and predicted_labels. Without ``predict`` a row
    takes over the prediction made for its source; a model run passes a
    function from the deranged rows (id, source_id, labels) to predictions.
    """
    pairing = cyclic_pairing(df, "id", seed)
    swapped = df.select("id", "labels").join(pairing, "id")
    if predict is None:
        source = df.select(F.col("id").alias("source_id"), "predicted_labels")
        samples = swapped.join(source, "source_id")
    else:
        samples = predict(swapped)
    plain = multilabel_summary(df, "predicted_labels", "labels", vocab.allowed, vocab.scored)
    moved = multilabel_summary(samples, "predicted_labels", "labels", vocab.allowed, vocab.scored)
    return compare_metrics(_long(moved), _long(plain)), samples


# Floors of the calibration verdict.
USABLE_FLOOR, CAUTION_FLOOR = 0.85, 0.70


def verdict_of(score: Column) -> Column:
    return F.when(score >= USABLE_FLOOR, "usable").when(score >= CAUTION_FLOOR, "with_caution").otherwise("not_usable")


def calibration_verdict(df: DataFrame, original: str, round_trip: str, raw: str, vocab: tuple[str, ...]) -> DataFrame:
    """Micro F1 of labels after a round trip and of labels of the raw text, with a verdict on the first."""
    a = multilabel_summary(df, round_trip, original, vocab).select("num_examples", F.col("f1_micro").alias("f1_round_trip"))
    b = multilabel_summary(df, raw, original, vocab).select(F.col("f1_micro").alias("f1_raw"))
    return attach_row(a, b).withColumn("verdict", verdict_of(F.col("f1_round_trip")))
