"""Joins and reconciliation of dataset copies.

Joins are left to the optimizer: at run time it broadcasts a side it has
measured to be small and splits a key it finds skewed. Only tables of a size
fixed by the code are broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, text_key, text_match
from ..session import cut
from ..sources.readers import last_by
from .aggregates import union_all
from .nearest import nearest
from .ordinal import attach_row, exact_percentiles, index_by_key, with_global_index

TEXTS = "array<string>"


def enrich(left: DataFrame, right: DataFrame, key: str, section: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that gain a non-blank section, and per ``by`` those that found none.

    ``right`` holds one row per key.
    """
    usable = right.where(F.col(key).isNotNull() & ~is_blank(F.col(section))).select(key, section)
    return left.join(usable, key, "inner"), left.join(usable, key, "left_anti").select(*by)


def restrict_to(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def attach_source(df: DataFrame, source: DataFrame, key: str, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Left join to the source study, absent texts empty; and the orphans."""
    marked = source.withColumn("_found", F.lit(True))
    out = (
        df.join(marked, key, "left")
        .withColumns({t: F.coalesce(F.col(t), F.lit("")) for t in texts})
        .withColumn("has_source", F.coalesce("_found", F.lit(False)))
        .drop("_found")
    )
    return out, df.join(source.select(key), key, "left_anti")


def _typed(checks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))


def reconcile(a: DataFrame, b: DataFrame, key: str = "id", fields: list[str] | None = None) -> DataFrame:
    """Typed findings between two copies, one row per key and finding.

    Columns: key, split, text, images (array) and optional ``fields``. Copy
    ``b`` may also carry ``mapping`` (its image name to the name in ``a``) and
    ``files`` (names found on disk).
    """
    fields = fields or []
    left = a.select(key, F.struct(*[c for c in a.columns if c != key]).alias("a"))
    right = b.select(key, F.struct(*[c for c in b.columns if c != key]).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    checks = [
        ("only_in_a", F.col("b").isNull()),
        ("only_in_b", F.col("a").isNull()),
        ("split_differs", both & ~F.col("a.split").eqNullSafe(F.col("b.split"))),
        ("text_differs", both & ~F.col("a.text").eqNullSafe(F.col("b.text"))),
        ("image_count_differs", both & (F.size("a.images") != F.size("b.images"))),
    ]
    if fields:
        uneven = [F.col(f"a.{f}").isNull() != F.col(f"b.{f}").isNull() for f in fields]
        checks.append(("field_set_differs", both & F.array_contains(F.array(*uneven), True)))
    if "mapping" in b.columns:
        mapped = F.transform("b.images", lambda n: F.try_element_at(F.col("b.mapping"), n))
        known = both & F.col("b.mapping").isNotNull()
        partial = F.exists(mapped, lambda n: n.isNull())
        checks += [
            ("mapping_absent", both & F.col("b.mapping").isNull()),
            ("mapping_incomplete", known & partial),
            ("pair_differs", known & ~partial & (F.array_sort(mapped) != F.array_sort(F.col("a.images")))),
        ]
    if "files" in b.columns:
        on_disk = F.coalesce(F.col("b.files"), F.array().cast(TEXTS))
        checks.append(("file_missing", both & (F.size(F.array_except("b.images", on_disk)) > 0)))
    return left.join(right, key, "full_outer").select(key, F.explode(_typed(checks)).alias("finding"))


def match_text(a: DataFrame, b: DataFrame, key: str, a_text: str, b_text: str) -> DataFrame:
    """Every row of ``b`` with the class of its text against the source ``a``."""
    source = a.select(F.col(key).alias("_key"), F.col(a_text).alias("_source"), F.lit(True).alias("_found"))
    joined = b.join(source, b[key] == F.col("_key"), "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    m = text_match(F.col("_source"), F.col(b_text))
    return joined.withColumn("_m", m).select(
        *[b[c] for c in b.columns],
        F.when(b[key].isNull(), "BAD_ID").when(~found, "SOURCE_MISSING").otherwise(F.col("_m.status")).alias("status"),
        F.when(found, F.col("_m.jaccard")).otherwise(0.0).alias("jaccard"),
        F.when(found, F.col("_m.coverage")).otherwise(0.0).alias("coverage"),
    )


# Fixed value: the file name pattern of a labelled copy.
LABELLED_NAME = r"^(frontal|lateral)(_\d+)?\.png\z"


def reconcile3(annotation: DataFrame, disk: DataFrame, state: DataFrame, pattern: str = LABELLED_NAME) -> DataFrame:
    """Findings between declared files, files on disk and the labelling state.

    All three hold rows of ``id`` and ``file``; a record or folder without
    files is one row with a null file. Sides meet by id and file, and merge on
    the map side.
    """
    sides = {"ann": annotation, "disk": disk, "state": state}
    rows = union_all([df.select("id", "file", *[F.lit(own == s).alias(s) for s in sides]) for own, df in sides.items()])
    ann, on_disk, st = (F.col(s) for s in sides)
    ids = rows.groupBy("id").agg(F.bool_or("ann").alias("ann"), F.bool_or("disk").alias("disk"))
    lone = ids.where(ann != on_disk).select(
        "id", F.when(ann, "record_without_folder").otherwise("folder_without_record").alias("rule"), F.lit("").alias("file")
    )
    per_file = rows.where(F.col("file").isNotNull()).groupBy("id", "file").agg(*[F.bool_or(s).alias(s) for s in sides])
    found = F.array_compact(F.array(
        F.when(ann & ~on_disk, "declared_not_on_disk"), F.when(st & ~on_disk, "state_not_on_disk"), F.when(on_disk & ~st, "disk_not_in_state"),
        F.when(ann & ~st, "declared_not_in_state"), F.when(on_disk & ~F.col("file").rlike(pattern), "bad_name"),
    ))
    both = ids.where(ann & on_disk).select("id")
    return lone.unionByName(per_file.join(both, "id").select("id", F.explode(found).alias("rule"), "file"))


def match_images(derived: DataFrame, original: DataFrame) -> DataFrame:
    """Tiered match per derived image: exact in study, exact in patient, nearest, or why not.

    Both sides: patient, study, file, state, shape, digest, data (array). Equal
    digests settle nearly all rows; pixels are compared only for the rest.
    """
    ok = original.where(F.col("state") == "OK")
    hit = ["shape", "digest"]
    in_study = ok.select("study", *hit).distinct().withColumn("_s", F.lit(True))
    in_patient = ok.select("patient", *hit).distinct().withColumn("_p", F.lit(True))
    shapes = ok.select("patient", "shape").distinct().withColumn("_sh", F.lit(True))
    patients = ok.select("patient").distinct().withColumn("_any", F.lit(True))
    typed = cut(
        derived.drop("data").withColumn("_did", F.concat_ws("/", "study", "file"))
        .join(in_study, ["study", *hit], "left")
        .join(in_patient, ["patient", *hit], "left")
        .join(shapes, ["patient", "shape"], "left")
        .join(patients, "patient", "left")
        .withColumn(
            "status",
            F.when(F.col("state") != "OK", F.col("state"))
            .when(F.col("_any").isNull(), "ORIG_MISSING")
            .when(F.col("_s"), "EXACT")
            .when(F.col("_p"), "EXACT_PATIENT")
            .when(F.col("_sh"), "DIFF_PIXELS")
            .otherwise("SHAPE_MISMATCH"),
        )
    )
    rest = typed.where(F.col("status") == "DIFF_PIXELS").select("_did")
    pixels = derived.select(
        F.concat_ws("/", "study", "file").alias("_did"), "patient", "shape", F.col("data").alias("_ddata")
    ).join(rest, "_did", "left_semi")
    wanted = typed.where(F.col("status") == "DIFF_PIXELS").select("patient", "shape").distinct()
    others = ok.join(wanted, ["patient", "shape"], "left_semi").select(
        "patient", "shape", F.concat_ws("/", "study", "file").alias("_oid"), F.col("data").alias("_odata")
    )
    near = nearest(pixels, others, ["patient", "shape"])
    return typed.join(near, "_did", "left").select(
        "patient", "study", "file", "status",
        F.col("_nearest").alias("nearest"),
        F.round("_distance", 6).alias("mean_abs"),
        F.round("_max_abs", 6).alias("max_abs"),
    )


def join_baseline(runs: DataFrame, baselines: DataFrame, identity: list[str], posthoc: DataFrame | None = None) -> DataFrame:
    """Long metrics (identity.., experiment, metric, value) against the baseline of equal identity.

    Post-hoc values count only where the run has none of its own.
    """
    if posthoc is not None:
        extra = posthoc.select("experiment", "metric", F.col("value").alias("_late"))
        who = runs.select("experiment", *identity).distinct()
        own = runs.select("experiment", "metric", "value")
        runs = (
            own.join(extra, ["experiment", "metric"], "full_outer")
            .select("experiment", "metric", F.coalesce("value", "_late").alias("value"))
            .join(who, "experiment")
        )
    base = baselines.select(*identity, "metric", F.col("value").alias("baseline"))
    return runs.join(base, [*identity, "metric"], "left").select(
        "experiment", *identity, "metric", "value", "baseline",
        F.bround(F.col("value") - F.col("baseline"), 6).alias("delta"),
    )


def paired_compare(
    runs: DataFrame, factor: str, key: list[str], a: str, b: str, metric: str
) -> tuple[DataFrame, DataFrame]:
    """Pairs of runs equal in ``key`` and differing in ``factor``, and their summary."""

    pairs = (
        runs.where(F.col(factor).isin(a, b)).groupBy(*key)
        .agg(
            F.max(F.when(F.col(factor) == a, F.col(metric))).alias("value_a"),
            F.max(F.when(F.col(factor) == b, F.col(metric))).alias("value_b"),
            F.count_distinct(F.col(factor)).alias("_sides"),
        )
        .where(F.col("_sides") == 2).drop("_sides")
        .withColumn("delta", F.col("value_b") - F.col("value_a"))
        .withColumn("winner", F.when(F.col("delta") > 0, b).when(F.col("delta").isNotNull(), a))
    )
    return pairs, paired_summary(pairs)


def paired_summary(pairs: DataFrame) -> DataFrame:
    median = exact_percentiles(pairs, [], "delta", {"median": 0.5})
    summary = pairs.agg(
        F.count("delta").alias("n"),
        F.avg("delta").alias("mean"),
        F.count_if(F.col("delta") > 0).alias("wins_b"),
    )
    return attach_row(summary, median)


def align_predictions(current: DataFrame, baseline: DataFrame, key: str = "id", order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs present in both runs, and the counts of common and lone ids.

    Of rows with the same id the last by ``order`` counts, by all columns where
    none is given.
    """
    c, b = (
        last_by(side.where(F.col(key).isNotNull()), key, F.struct(*(order or side.columns))) for side in (current, baseline)
    )
    renamed = b.select(key, *[F.col(x).alias(f"baseline_{x}") for x in b.columns if x != key])
    flags = (
        c.select(key, F.lit(1).alias("_c")).join(b.select(key, F.lit(1).alias("_b")), key, "full_outer")
    )
    counts = flags.agg(
        F.count("_c").alias("n_current"),
        F.count("_b").alias("n_baseline"),
        F.count_if(F.col("_c").isNotNull() & F.col("_b").isNotNull()).alias("n_common"),
        F.count_if(F.col("_b").isNull()).alias("n_only_current"),
        F.count_if(F.col("_c").isNull()).alias("n_only_baseline"),
    ).withColumn("status", F.when(F.col("n_common") < 2, "not_estimable").otherwise("ok"))
    return c.join(renamed, key, "inner"), counts


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def merge_validated(left: DataFrame, right: DataFrame, key: str, payload: str, digest: str) -> DataFrame:
    """Left join with unique keys and a re-checked payload hash; a breach is an error."""
    for side, df in (("left", left), ("right", right)):
        if not duplicate_keys(df, key).isEmpty():
            raise ValueError(f"{side} side holds {key} more than once")
    merged = left.join(right, key, "left")
    broken = merged.where(F.col(payload).isNotNull() & (F.md5(F.col(payload)) != F.col(digest)))
    if not broken.isEmpty():
        raise ValueError(f"{payload} does not match {digest}")
    return merged


def cohort_diff(rows: DataFrame, versions: list[str]) -> DataFrame:
    """Per split and later version: ids added to and removed from the first version.

    ``rows`` holds version, split, id.
    """
    base, rest = versions[0], versions[1:]
    member = rows.groupBy("split", "id").agg(
        *[F.max(F.col("version") == v).alias(f"v{i}") for i, v in enumerate(versions)]
    )
    aggs = []
    for i, _ in enumerate(rest, start=1):
        aggs += [
            F.count_if(F.col(f"v{i}") & ~F.col("v0")).alias(f"added{i}"),
            F.count_if(F.col("v0") & ~F.col(f"v{i}")).alias(f"removed{i}"),
        ]
    cells = F.array(
        *[F.struct(F.lit(v).alias("version"), F.col(f"added{i}").alias("added"), F.col(f"removed{i}").alias("removed"))
          for i, v in enumerate(rest, start=1)]
    )
    return member.groupBy("split").agg(*aggs).select("split", F.inline(cells)).withColumn("base", F.lit(base))


def apply_updates(
    base: DataFrame, updates: DataFrame, key: str, columns: list[str], overwrite: bool = False,
    sources: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Base rows with the supplied columns replaced, and the contract violations.

    ``sources`` names per column the text its value is made from: a non-blank
    source needs a non-blank value and the other way round.
    """
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_given"))
    joined = base.join(new, key, "left")
    given = F.coalesce(F.col("_given"), F.lit(False))
    out = joined.select(
        *[F.when(given, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
          for c in base.columns]
    )
    checks = [] if overwrite else [("already_set:" + c, given & ~is_blank(F.col(c))) for c in columns]
    for column, source in (sources or {}).items():
        checks += [
            (f"blank_output:{column}", given & ~is_blank(F.col(source)) & is_blank(F.col(f"_new_{column}"))),
            (f"unexpected_output:{column}", given & is_blank(F.col(source)) & ~is_blank(F.col(f"_new_{column}"))),
        ]
    known = base.select(key)
    violations = updates.where(is_blank(F.col(key).cast("string"))).select(
        F.col(key).cast("string").alias("id"), F.lit("empty_id").alias("violation")
    ).unionByName(
        updates.where(~is_blank(F.col(key).cast("string"))).join(known, key, "left_anti").select(
            F.col(key).cast("string").alias("id"), F.lit("unknown_id").alias("violation")
        )
    )
    if checks:
        violations = violations.unionByName(
            joined.select(F.col(key).cast("string").alias("id"), F.explode(_typed(checks)).alias("violation"))
        )
    return out, violations


def lookup_cache(texts: DataFrame, text: str, cache: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their cached result, the work queue of misses, and the counts.

    A text is looked up once however often it occurs; blank texts are not
    looked up at all, and do not enter the join. A key that the cache holds
    several times counts once, with its greatest translation.
    """
    cache = cache.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("translation").alias("translation"))
    keyed = texts.withColumn("key", F.when(~is_blank(F.col(text)), text_key(F.col(text))))
    unique = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min(text).alias("source"), F.count(F.lit(1)).alias("_rows")
    )
    known = unique.join(cache.select("key", "translation"), "key", "left")
    queue = known.where(F.col("translation").isNull()).select("key", "source")
    stats = known.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("unique"),
        F.count("translation").alias("hit"),
        F.count_if(F.col("translation").isNull()).alias("miss"),
    )
    blank = keyed.where(F.col("key").isNull()).withColumn("translation", F.lit(None).cast(dict(cache.dtypes)["translation"]))
    found = keyed.where(F.col("key").isNotNull()).join(cache, "key", "left").select(blank.columns)
    return found.unionAll(blank), queue, stats


def cyclic_pairing(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Mapping ``(id, source_id)`` that moves every row by one seeded offset.

    No row keeps its own payload. Fails on duplicate ids or fewer than two rows.
    """
    if not duplicate_keys(df, id_col).isEmpty():
        raise ValueError("cyclic pairing needs unique ids")
    indexed = with_global_index(df.select(F.col(id_col).alias("id")), "id")
    n = indexed.count()
    if n < 2:
        raise ValueError("cyclic pairing needs at least two rows")
    offset = 1 + seeded_int(seed, "offset", n - 1)
    source = indexed.select(
        F.col("id").alias("source_id"), F.pmod(F.col("idx") - offset, F.lit(n)).alias("idx")
    )
    return indexed.join(source, "idx").select("id", "source_id")


def seeded_int(seed: int, name: str, n: int) -> int:
    """The driver-side twin of ``draw``: a number in 0 .. n-1."""
    import hashlib

    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:15], 16) % n


def cross_review(probe: DataFrame, samples: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Probe cases times the steps that hold a sample, with review ids R0001.. and blank marks."""
    rows = samples.join(probe.select(id_col), id_col, "left_semi")
    numbered = index_by_key(rows, order)
    number = (F.col("idx") + 1).cast("string")
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(4)), "0")
    return numbered.withColumns(
        {"review_id": F.concat(F.lit("R"), padded), "reviewer": F.lit(""), "verdict": F.lit(""), "note": F.lit("")}
    ).drop("idx")


def require_files(records: DataFrame, id_col: str, paths: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records whose every path exists, and the others with the missing paths."""
    wanted = records.select(F.col(id_col).alias("id"), F.explode(paths).alias("path"))
    missing = wanted.join(files.select("path").distinct(), "path", "left_anti")
    listed = missing.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("path")), ";").alias("detail"))
    none = records.where(F.coalesce(F.size(paths), F.lit(0)) <= 0).select(
        F.col(id_col).alias("id"), F.lit("no_paths").alias("reason"), F.lit("").alias("detail")
    )
    skipped = listed.select("id", F.lit("file_missing").alias("reason"), "detail").unionByName(none)
    kept = records.join(skipped.select(F.col("id").alias(id_col)), id_col, "left_anti")
    return kept, skipped
