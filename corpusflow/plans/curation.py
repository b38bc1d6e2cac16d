"""Curation jobs that combine joins, rules and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import lit_strings, ordered_positive, render_label_target, tag_labels
from ..functions.messages import build_record, user_parts
from ..functions.text import format_target, is_blank
from ..functions.views import classify_views, pair_type, select_images, view_of
from ..functions.vocabulary import TagRules, Vocabulary
from ..operators.aggregates import dataset_stats
from ..operators.joins import require_files
from ..operators.quality import Version, dq_rules, label_checks, raise_if_any, text_checks, violations
from ..sources.sinks import table_fingerprint, write_guarded, write_splits


def preflight(annotation: DataFrame, source: DataFrame, key: str, version: Version, files: DataFrame | None = None) -> DataFrame:
    """What would make the build fail: ids, texts, source rows, impressions, views and, given a listing (``path``), files."""
    found = dq_rules(annotation, text_checks(["report"]))
    lost = annotation.join(source.select(key), key, "left_anti").select(
        F.lit("source_missing").alias("rule"), "split", F.col("id").cast("string").alias("id"), F.lit("").alias("detail")
    )
    blank = annotation.join(source.where(is_blank(F.col("impression"))).select(key), key, "left_semi").select(
        F.lit("impression_missing").alias("rule"), "split", F.col("id").cast("string").alias("id"), F.lit("").alias("detail")
    )
    lost = lost.unionByName(blank)
    if files is not None:
        skipped = require_files(annotation, "id", "image_path", files)[1]
        lost = lost.unionByName(annotation.select("id", "split").join(skipped, "id").select(
            F.col("reason").alias("rule"), "split", F.col("id").cast("string").alias("id"), "detail"))
    n_front = F.size(F.filter("image_path", lambda p: view_of(p) == "frontal"))
    n_side = F.size(F.filter("image_path", lambda p: view_of(p) == "lateral"))
    checks = [("no_frontal", n_front == 0, F.lit(""))]
    if version.views == "frontal_lateral":
        checks += [("no_lateral", n_side == 0, F.lit("")), ("image_count", F.size("image_path") != 2, F.size("image_path"))]
    return found.unionByName(lost).unionByName(violations(annotation, checks))


def build_records(annotation: DataFrame, source: DataFrame, key: str, version: Version, rules: TagRules,
                  system: str, user: str, lang: str = "en") -> DataFrame:
    """Instruction records of one dataset version, with their split.

    ``source`` holds the key, findings, impression and tags (array).
    """
    picked = select_images(F.col("image_path"), version.views)
    joined = annotation.join(source.select(key, "findings", "impression", "tags"), key)
    target = format_target(F.col("findings"), F.col("impression"), version.target, lang)
    names = F.transform(picked.names, lambda n: F.concat(F.lit("images/"), F.col("id").cast("string"), F.lit("/"), n))
    record = build_record(
        F.col("id"), names, tag_labels(F.col("tags"), rules), target, F.lit(system), F.lit(user),
        tags=F.col("tags"), source_lang=F.lit("en"), target_lang=F.lit(lang),
    )
    return joined.select(record.alias("_r"), "split").select("_r.*", "split")


def record_stats(records: DataFrame) -> DataFrame:
    flat = records.select("split", F.col("factors.diagnostic_category").alias("labels"), F.col("factors.projection").alias("projection"))
    return dataset_stats(flat, {"label": "labels"}, {"projection": "projection"})


def build_dataset(annotation: DataFrame, source: DataFrame, key: str, version: Version, rules: TagRules, system: str,
                  user: str, path: str, lang: str = "en", overwrite: bool = False, files: DataFrame | None = None) -> dict[str, str]:
    """Validate, build and write one version with its statistics and manifest.

    Any violation stops the job before the first file is written.
    """
    raise_if_any(preflight(annotation, source, key, version, files), "build stopped")
    records = build_records(annotation, source, key, version, rules, system, user, lang)
    out = {name: f"{path}/{name}" for name in ("records", "stats", "manifest")}
    write_splits(records, out["records"], overwrite)
    written = records.sparkSession.read.schema(records.schema).json(out["records"])
    write_guarded(record_stats(written), out["stats"], overwrite, fmt="json")
    write_guarded(table_fingerprint(written, ["split"]), out["manifest"], overwrite, fmt="json")
    return out


def drop_missing_section(df: DataFrame, status: Column, strict: bool = False, drop_unverifiable: bool = False,
                         unverifiable: tuple[str, ...] = ("BAD_ID", "SOURCE_MISSING")) -> tuple[DataFrame, DataFrame]:
    """Rows kept and removed by section status.

    Empty and absent sections go; placeholders go too unless ``strict``, which
    removes only what is truly absent. Rows that cannot be checked stop the
    job unless ``drop_unverifiable``.
    """
    gone = ["MISSING_TAG", "EMPTY", *([] if strict else ["PLACEHOLDER"])]
    marked = df.withColumn("_status", status)
    if not drop_unverifiable:
        raise_if_any(marked.where(F.col("_status").isin(*unverifiable)).select("id", "_status"), "unverifiable rows")
    else:
        gone += unverifiable
    removed = marked.where(F.col("_status").isin(gone)).withColumnRenamed("_status", "status")
    return marked.where(~F.col("_status").isin(gone)).drop("_status"), removed


def drop_same_view_pairs(df: DataFrame, folders: DataFrame, key: str, drop_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records without those whose folder holds a pair of the same view.

    ``folders`` holds the key and the counts of ``image_folders``.
    """
    counts = folders.select(key, *[F.col(c).alias(f"_{c}") for c in ("n_files", "n_frontal", "n_lateral")])
    pair = pair_type(F.col("_n_files"), F.col("_n_frontal"), F.col("_n_lateral"))
    marked = df.join(counts, key, "left").withColumn("pair", pair).drop("_n_files", "_n_frontal", "_n_lateral")
    gone = ["FRONTAL_PAIR", "LATERAL_PAIR"]
    if drop_missing:
        gone.append("DIR_MISSING")
    else:
        raise_if_any(marked.where(F.col("pair") == "DIR_MISSING").select(key, "pair"), "folders missing")
    return marked.where(~F.col("pair").isin(gone)), marked.where(F.col("pair").isin(gone))


def extract_recoverable(df: DataFrame, paths: str, folders: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Same-view records whose folder holds more than two images, and those that do not.

    ``folders`` holds the key and the counts of ``image_folders``.
    """
    same = df.where(classify_views(F.col(paths)).status == "SAME_VIEW")
    sized = same.join(folders.select(key, "n_files"), key, "left").withColumn(
        "n_files", F.coalesce("n_files", F.lit(0))
    )
    return sized.where(F.col("n_files") > 2), sized.where(F.col("n_files") <= 2)


def apply_pair_decisions(df: DataFrame, decided: DataFrame, key: str, paths: str) -> DataFrame:
    """Image pairs replaced for decided ids, all other records unchanged."""
    new = decided.select(key, F.col(paths).alias("_new"))
    out = df.join(new, key, "left").withColumn(paths, F.coalesce("_new", F.col(paths)))
    return out.select(*df.columns)


def label_violations(records: DataFrame, vocab: Vocabulary, n_images: int) -> DataFrame:
    """Why records cannot become classification records: ``(rule, id, detail)``."""
    n = F.coalesce(F.size("images"), F.lit(0))
    roles = F.transform("messages", lambda m: m.role)
    shape = F.coalesce(F.size(roles), F.lit(0)) < 3
    checks = [
        ("image_count", n != n_images, n), *label_checks(F.col("factors.diagnostic_category"), vocab),
        ("messages_invalid", shape, F.lit("")), ("no_assistant_target", ~shape & (F.element_at(roles, -1) != "assistant"), F.lit("")),
    ]
    return violations(records.withColumn("split", F.lit("")), checks).drop("split")


def label_records(records: DataFrame, vocab: Vocabulary, n_images: int, target_format: str, system: str, user: str,
                  keep_fallback_records: bool = False, with_fallbacks: bool = False, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Classification records made from report records, and the counts.

    Records labelled only with a fallback are left out unless kept on purpose.
    Records that break ``label_violations`` stop the job, unless ``strict`` is
    turned off; then they are counted alone.
    """
    if n_images < 1:
        raise ValueError("a record needs at least one image")
    if strict:
        raise_if_any(label_violations(records, vocab, n_images), "records cannot be labelled")
    if keep_fallback_records and not with_fallbacks:
        raise ValueError("keeping fallback records needs the fallback labels")
    labels = F.col("factors.diagnostic_category")
    other, unlabeled = (labels == lit_strings([f]) for f in vocab.fallbacks)
    ordered = ordered_positive(labels, vocab, with_fallbacks)
    target = render_label_target(labels, vocab, target_format, with_fallbacks)
    messages = F.transform("messages", lambda m: m.withField(
        "content_text", F.when(m.role == "system", F.lit(system)).when(m.role == "assistant", target).otherwise(m.content_text)
    ).withField("content_parts", F.when(m.role == "user", user_parts(F.col("images"), F.lit(user))).otherwise(m.content_parts)))
    kept = records if keep_fallback_records else records.where(~(other | unlabeled))
    out = kept.withColumns({
        "messages": messages,
        "factors": F.col("factors").withField("task_type", F.lit("clinical_classification")).withField("diagnostic_category", ordered),
    })
    drop = F.lit(not keep_fallback_records)
    counts = records.agg(
        F.count(F.lit(1)).alias("source_records"),
        F.count_if(~((other | unlabeled) & drop)).alias("clinical_records"),
        F.count_if(other & drop).alias("excluded_other"),
        F.count_if(unlabeled & drop).alias("excluded_unlabeled"),
        F.count_if(F.coalesce(F.size("images"), F.lit(0)) != n_images).alias("wrong_image_count"),
    )
    return out, counts


def filter_by_label_policy(df: DataFrame, labels: str, variant: str, residual: str = "Other") -> DataFrame:
    """Variant ``all`` keeps everything, ``no_residual`` drops the residual class."""
    if variant == "all":
        return df
    if variant == "no_residual":
        return df.where(~F.array_contains(labels, residual))
    raise ValueError(f"unknown label policy {variant!r}")


ISSUES = (
    "no_findings", "no_impression", "no_frontal", "no_lateral", "unknown_views", "no_images", "multi_images", "complete",
)


def issue_condition(issue: str) -> Column:
    """Named issue over findings, impression, frontal, lateral (nullable flags) and images."""
    has_f, has_i = (F.coalesce(F.col(c), F.lit("")) != "" for c in ("findings", "impression"))
    front, side = F.col("frontal"), F.col("lateral")
    n = F.coalesce(F.size("images"), F.lit(0))
    table = {
        "no_findings": ~has_f,
        "no_impression": ~has_i,
        "no_frontal": F.coalesce(~front, F.lit(False)),
        "no_lateral": F.coalesce(~side, F.lit(False)),
        "unknown_views": front.isNull(),
        "no_images": n == 0,
        "multi_images": n > 2,
        "complete": has_f & has_i & F.coalesce(front & side, F.lit(False)),
    }
    return table[issue]


def issues_of() -> Column:
    """Array of the issues that hold for a study, from one pass over it."""
    return F.array_compact(F.array(*[F.when(issue_condition(i), F.lit(i)) for i in ISSUES]))


def filter_studies(df: DataFrame, split: str | None = None, issue: str | None = None, query: str = "",
                   texts: tuple[str, ...] = ("findings", "impression", "report")) -> DataFrame:
    """Studies of a split with a named issue whose id or texts hold the query, letters of either case."""
    out = df if not split else df.where(F.col("split") == split)
    if issue:
        out = out.where(issue_condition(issue))
    needle = query.strip().lower()
    if needle:
        hit = F.lit(False)
        for c in ("id", *texts):
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(needle))
        out = out.where(hit)
    return out


def priority_reason(cascade: list[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first condition that holds."""
    out = F.lit(otherwise)
    for name, cond in reversed(cascade):
        out = F.when(cond, name).otherwise(out)
    return out


def exclusion_reason(findings: Column, n_files: Column) -> Column:
    return priority_reason([("no_findings", is_blank(findings)), ("too_few_files", n_files < 2)], "unexplained")


def impression_status(impression: Column, placeholder_only: Column) -> Column:
    return priority_reason([("missing", is_blank(impression)), ("placeholder", placeholder_only)], "recoverable")
