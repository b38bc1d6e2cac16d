"""Data-quality rules as violation rows, and the verdict over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import lit_strings
from ..functions.messages import message_text
from ..functions.text import SEPARATOR, is_blank, split_sections
from ..functions.vocabulary import Vocabulary
from .windows import examples_per_status


@dataclass(frozen=True)
class Version:
    """What a dataset version promises about its records."""

    views: str = "frontal"
    target: str = "findings"
    system: str | None = None
    user: str | None = None

    @property
    def n_images(self) -> int:
        return 2 if self.views == "frontal_lateral" else 1

    @property
    def view_set(self) -> list[str]:
        return ["frontal", "lateral"] if self.views == "frontal_lateral" else ["frontal"]


Check = tuple[str, Column, Column]


def violations(df: DataFrame, checks: list[Check], id_col: str = "id", split: str = "split") -> DataFrame:
    """``(rule, split, id, detail)`` for every check that fires, from one pass."""
    fired = F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
        for name, cond, detail in checks
    ]))
    out = df.select(F.col(split).alias("split"), F.col(id_col).cast("string").alias("id"), F.explode(fired).alias("v"))
    return out.select("v.rule", "split", "id", "v.detail")


def label_checks(labels: Column, vocab: Vocabulary) -> list[Check]:
    known = lit_strings(vocab.allowed)
    unknown = F.array_except(labels, known)
    fallback = F.arrays_overlap(labels, lit_strings(vocab.fallbacks))
    none = F.lit("")
    return [
        ("labels_missing", labels.isNull() | (F.size(labels) <= 0), none),
        ("labels_duplicate", F.size(F.array_distinct(labels)) < F.size(labels), none),
        ("labels_unknown", F.size(unknown) > 0, F.array_join(F.array_sort(unknown), "|")),
        ("healthy_not_alone", F.array_contains(labels, vocab.healthy) & (F.size(labels) > 1), F.array_join(labels, "|")),
        ("fallback_not_alone", fallback & (F.size(labels) > 1), F.array_join(labels, "|")),
    ]


def with_target(records: DataFrame) -> DataFrame:
    """Records with the target text and its sections, which several rules look at."""
    targets = records.withColumn("_target", message_text(F.col("messages"), "assistant"))
    return targets.withColumn("_sections", split_sections(F.col("_target")))


def record_checks(version: Version, vocab: Vocabulary | None = None) -> list[Check]:
    """Rules on one instruction record as ``with_target`` gives it."""
    none = F.lit("")
    n_images = F.coalesce(F.size("images"), F.lit(0))
    roles = F.transform("messages", lambda m: m.role)
    parts = F.coalesce(F.get("messages", F.lit(1)).content_parts, F.array().cast("array<struct<type:string,image:string,text:string>>"))
    n_parts = F.size(F.filter(parts, lambda p: p.type == "image"))
    target, sections = F.col("_target"), F.col("_sections")
    views = F.array_sort(F.col("factors.views"))
    checks: list[Check] = [
        ("missing_id", is_blank(F.col("id")), none),
        ("image_count", n_images != version.n_images, n_images),
        ("message_roles", ~roles.eqNullSafe(lit_strings(["system", "user", "assistant"])), F.array_join(roles, "|")),
        ("prompt_images", n_parts != n_images, n_parts),
        ("target_blank", is_blank(target), none),
        ("view_set", ~views.eqNullSafe(lit_strings(version.view_set)), F.array_join(views, "|")),
    ]
    if version.target == "findings_impression":
        lame = ~F.contains(target, F.lit(SEPARATOR)) | is_blank(sections.findings) | is_blank(sections.impression)
        checks.append(("target_sections", lame, none))
    if version.system is not None:
        checks.append(("system_prompt", message_text(F.col("messages"), "system") != version.system, none))
    if version.user is not None:
        checks.append(("user_prompt", message_text(F.col("messages"), "user") != version.user, none))
    if vocab is not None:
        checks += label_checks(F.col("factors.diagnostic_category"), vocab)
    return checks


def text_checks(texts: list[str]) -> list[Check]:
    """Every text blank at once, and missing ids."""
    every = F.lit(True)
    for t in texts:
        every = every & is_blank(F.col(t))
    return [("missing_id", is_blank(F.col("id").cast("string")), F.lit("")), ("all_texts_blank", every, F.lit(""))]


def pair_checks(paths: str = "image_path") -> list[Check]:
    """An image pair is one frontal and one lateral file."""
    names = F.transform(paths, lambda p: F.element_at(F.split(p, "/"), -1))
    n_f = F.size(F.filter(names, lambda n: n.startswith("frontal")))
    n_l = F.size(F.filter(names, lambda n: n.startswith("lateral")))
    size = F.coalesce(F.size(paths), F.lit(0))
    return [
        ("pair_size", size != 2, size),
        ("pair_views", (size == 2) & ((n_f != 1) | (n_l != 1)), F.array_join(names, "|")),
    ]


def id_violations(df: DataFrame, id_col: str = "id", split: str = "split") -> DataFrame:
    """Duplicate ids, and every two splits that share an id, from one grouping."""
    ids = df.groupBy(F.col(id_col).cast("string").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set(split)).alias("_splits")  # a handful of splits
    ).where(F.col("_n") > 1).withColumn("split", F.get("_splits", F.lit(0)))
    twice = violations(ids, [("duplicate_id", F.col("_n") > 1, F.col("_n"))])
    # One row for every two splits that share the id.
    pairs = ids.select("id", F.explode("_splits").alias("split"), "_splits").select("id", "split", F.explode("_splits").alias("_other")).where("split < _other")
    return twice.unionByName(violations(pairs, [("split_leakage", F.lit(True), F.concat_ws("|", "split", "_other"))]))


def dq_rules(df: DataFrame, checks: list[Check], id_col: str = "id", split: str = "split") -> DataFrame:
    return violations(df, checks, id_col, split).unionByName(id_violations(df, id_col, split))


def check_records(records: DataFrame, version: Version, vocab: Vocabulary | None = None) -> DataFrame:
    """All violations of the record rules."""
    return dq_rules(with_target(records), record_checks(version, vocab))


def dq_verdict(found: DataFrame, rules: list[str], cap: int = 5) -> DataFrame:
    """One row per rule: passed, number of violations, the first few details."""
    spark = found.sparkSession
    every = spark.createDataFrame([(r,) for r in rules], "rule string")
    counts = found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    first = examples_per_status(found, "rule", ["split", "id", "detail"], cap)
    shown = first.groupBy("rule").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x.id), ";").alias("examples")  # <= cap
    )
    return (
        every.join(counts, "rule", "left").join(shown, "rule", "left")
        .select("rule", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("examples", F.lit("")).alias("examples"))
        .withColumn("passed", F.col("n") == 0)
    )


def exit_status(verdict: DataFrame) -> int:
    """0 if every rule passed, else 1."""
    return int(not verdict.where(~F.col("passed")).isEmpty())


def raise_if_any(found: DataFrame, what: str = "violations", show: int = 5) -> None:
    rows = found.limit(show).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")
