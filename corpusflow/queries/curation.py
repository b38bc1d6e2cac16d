"""Curation, quality rules and batch jobs over the studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.text import base_name, format_target, is_blank, section_status
from ..functions.vocabulary import TagRules
from ..operators import batches as B
from ..operators import quality as Q
from ..plans import curation as C
from ..session import cut, scratch_path
from ..sources.readers import image_folders
from . import sqlkit as K
from .fixtures import IMAGED, STUDIES, VOCAB, imaged, joined, studies, table
from .registry import query
from .sources import _fingerprint_sql
from .texts import PAIR_SQL, SECTION_TEXT

TAGS = TagRules(rules=(("LowQuality", ("lowquality",)), ("Toxic", ("toxic",))), normal_tokens=("no finding",), unindexed_tokens=("unlabeled",))


def _annotation(spark, sf):
    """Studies with one frontal and one lateral image each."""
    s = studies(spark, sf)
    name = F.concat(F.lit("images/"), F.col("id").cast("string"), F.lit("/"))
    paths = F.array(F.concat(name, F.lit("frontal.png")), F.concat(name, F.lit("lateral.png")))
    return s.select("id", "split", "report", paths.alias("image_path"))


def _source(spark, sf):
    # A study of one line has no impression of its own: its findings stand for it.
    impression = F.when(is_blank(F.col("impression")), F.col("findings")).otherwise(F.col("impression"))
    return studies(spark, sf).select("id", "findings", impression.alias("impression"), F.split("label_str", "[|]").alias("tags"))


@query("c1_build_dataset", f"""
WITH {STUDIES.replace("'|') AS labels", "'|') AS labels, CASE WHEN " + K.filled('impression') + " THEN impression ELSE findings END AS told")} SELECT CAST(id AS VARCHAR) AS id, split, label_str AS labels, 'frontal+lateral' AS projection, 'images/' || id || '/frontal.png|images/' || id || '/lateral.png' AS images,
  md5('Findings:' || chr(10) || {K.strip('findings')} || chr(10) || '<SEP>' || chr(10) || 'Impression:' || chr(10) || {K.strip('told')}) AS target,
  CAST(count(*) OVER (PARTITION BY split) AS BIGINT) AS n_manifest, CAST(count(*) OVER (PARTITION BY split) AS BIGINT) AS n_stats FROM studies""")
def _(spark, sf):
    out = C.build_dataset(
        _annotation(spark, sf), _source(spark, sf), "id", Q.Version("frontal_lateral", "findings_impression"), TAGS,
        "You read reports.", "Describe the images.", scratch_path(spark, "dataset"),
    )
    records = spark.read.schema(M.RECORD_COLUMNS + ", split string").json(out["records"])
    manifest = spark.read.schema("split string, n_rows bigint, fingerprint string").json(out["manifest"])
    stats = spark.read.schema("kind string, split string, value string, n bigint").json(out["stats"]).where("kind = 'rows'")
    return (
        records.select(
            "id", "split", joined("factors.diagnostic_category").alias("labels"), "factors.projection", joined("images").alias("images"),
            F.md5(M.message_text(F.col("messages"), "assistant")).alias("target"),
        )
        .join(manifest.select("split", F.col("n_rows").alias("n_manifest")), "split")
        .join(stats.select("split", F.col("n").alias("n_stats")), "split")
    )


@query("c1_preflight", f"""
WITH {IMAGED}, c AS (SELECT *, {K.n_view('image_path', 'frontal')} AS nf, {K.n_view('image_path', 'lateral')} AS nl, len(image_path) AS n FROM imaged)
SELECT 'all_texts_blank' AS rule, split, CAST(id AS VARCHAR) AS id, '' AS detail FROM c WHERE NOT {K.filled('report')}
UNION ALL SELECT 'source_missing', split, CAST(id AS VARCHAR), '' FROM c WHERE lang = 'es'
UNION ALL SELECT 'no_frontal', split, CAST(id AS VARCHAR), '' FROM c WHERE nf = 0 UNION ALL SELECT 'no_lateral', split, CAST(id AS VARCHAR), '' FROM c WHERE nl = 0
UNION ALL SELECT 'image_count', split, CAST(id AS VARCHAR), CAST(n AS VARCHAR) FROM c WHERE n <> 2
UNION ALL SELECT 'impression_missing', split, CAST(id AS VARCHAR), '' FROM c WHERE lang <> 'es' AND NOT {K.filled('impression')}
UNION ALL SELECT 'file_missing', split, CAST(id AS VARCHAR), 'images/' || id || '/lateral_3.png' FROM c WHERE contains(label_str, 'Toxic')""")
def _(spark, sf):
    a = imaged(spark, sf).select("id", "split", "report", "image_path")
    source = studies(spark, sf).where(F.col("lang") != "es").select("id", "impression")
    files = a.select(F.explode("image_path").alias("path")).where(base_name(F.col("path")) != "lateral_3.png")
    return C.preflight(a, source, "id", Q.Version("frontal_lateral"), files)


@query("c1_dataset_stats", f"""
WITH {STUDIES}, l AS (SELECT split, unnest(labels) AS label FROM studies)
SELECT 'rows' AS kind, split, '' AS value, CAST(count(*) AS BIGINT) AS n FROM studies GROUP BY split
UNION ALL SELECT 'label', split, label, CAST(count(*) AS BIGINT) FROM l GROUP BY split, label
UNION ALL SELECT 'projection', split, 'frontal+lateral', CAST(count(*) AS BIGINT) FROM studies GROUP BY split""")
def _(spark, sf):
    out = C.build_dataset(
        _annotation(spark, sf), _source(spark, sf), "id", Q.Version("frontal_lateral", "findings_impression"), TAGS,
        "You read reports.", "Describe the images.", scratch_path(spark, "dataset"),
    )
    stats = spark.read.schema("kind string, split string, value string, n bigint").json(out["stats"])
    return stats.withColumn("value", F.coalesce("value", F.lit("")))


def _section_map():
    l = F.col("label_str")
    text = F.when(l == "Toxic", "N/A - XXXX").when(l == "LowQuality", "none.").otherwise(F.col("impression"))
    both = F.create_map(F.lit("IMPRESSION"), text)
    return F.when(l == "LowQuality|Toxic", F.create_map(F.lit("FINDINGS"), F.col("findings"))).otherwise(both)


_STATUS = f"""CASE WHEN lang = 'es' THEN 'SOURCE_MISSING' WHEN label_str = 'LowQuality|Toxic' THEN 'MISSING_TAG' WHEN NOT {K.filled(f"({SECTION_TEXT})")} THEN 'EMPTY'
  WHEN label_str IN ('Toxic', 'LowQuality') THEN 'PLACEHOLDER' ELSE 'OK' END"""


@query("c2_drop_missing_section", f"""
WITH {STUDIES}, s AS (SELECT id, split, {_STATUS} AS status FROM studies)
SELECT 'default' AS mode, status, split, CAST(count(*) AS BIGINT) AS n FROM s WHERE status <> 'OK' GROUP BY ALL
UNION ALL SELECT 'strict', status, split, CAST(count(*) AS BIGINT) FROM s WHERE status NOT IN ('OK', 'PLACEHOLDER') GROUP BY ALL
UNION ALL SELECT 'kept_strict', '', split, CAST(count(*) AS BIGINT) FROM s WHERE status IN ('OK', 'PLACEHOLDER') GROUP BY ALL""")
def _(spark, sf):
    # Impressions that open like a placeholder token are rare enough to be checked by the status itself.
    s = studies(spark, sf)
    status = F.when(F.col("lang") == "es", "SOURCE_MISSING").otherwise(section_status(_section_map(), "IMPRESSION"))
    out = []
    for mode, strict in (("default", False), ("strict", True)):
        kept, removed = C.drop_missing_section(s, status, strict, drop_unverifiable=True)
        out.append(removed.groupBy("status", "split").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(mode)))
    kept = kept.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumns({"status": F.lit(""), "mode": F.lit("kept_strict")})
    return out[0].unionByName(out[1]).unionByName(kept)


_FOLDERS = f"""
folders AS (SELECT id, CASE WHEN label_str = 'Unlabeled' THEN list_concat(image_path, ['x/frontal_9.png']) WHEN label_str = 'LowQuality|Toxic' THEN list_concat(image_path, ['x/lateral_9' || i || '.png' FOR i IN range(70)]) ELSE image_path END AS files FROM imaged WHERE lang <> 'es'),
fp AS (SELECT s.id, {PAIR_SQL} AS pair, files FROM imaged s LEFT JOIN folders f ON f.id = s.id)"""


def _folders(spark, sf):
    """Counts of the image folders, from a listing; some folders hold more than 70 files."""
    s = imaged(spark, sf).where(F.col("lang") != "es")
    more = F.concat("image_path", F.array(F.lit("x/frontal_9.png")))
    many = F.transform(F.sequence(F.lit(0), F.lit(69)), lambda i: F.concat(F.lit("x/lateral_9"), i.cast("string"), F.lit(".png")))
    files = F.when(F.col("label_str") == "Unlabeled", more).when(F.col("label_str") == "LowQuality|Toxic", F.concat("image_path", many)).otherwise(F.col("image_path"))
    listing = s.select(F.col("id").alias("study"), F.explode(files).alias("path")).select("study", base_name(F.col("path")).alias("file"))
    return image_folders(listing).withColumnRenamed("study", "id")


@query("c3_drop_same_view_pairs", f"""
WITH {IMAGED}, {_FOLDERS} SELECT id, pair, CASE WHEN pair IN ('FRONTAL_PAIR', 'LATERAL_PAIR', 'DIR_MISSING') THEN 'removed' ELSE 'kept' END AS side FROM fp""")
def _(spark, sf):
    kept, removed = C.drop_same_view_pairs(studies(spark, sf).select("id"), _folders(spark, sf), "id", drop_missing=True)
    return kept.withColumn("side", F.lit("kept")).unionByName(removed.withColumn("side", F.lit("removed")))


@query("c4_extract_recoverable", f"""
WITH {IMAGED}, {_FOLDERS}, sv AS (SELECT id FROM imaged WHERE len(image_path) = 2 AND {K.n_view('image_path', 'unknown')} = 0 AND ({K.n_view('image_path', 'frontal')} = 2 OR {K.n_view('image_path', 'lateral')} = 2))
SELECT sv.id, coalesce(len(f.files), 0) AS n_files, coalesce(len(f.files), 0) > 2 AS recoverable FROM sv LEFT JOIN folders f ON f.id = sv.id""")
def _(spark, sf):
    yes, no = C.extract_recoverable(imaged(spark, sf).select("id", "image_path"), "image_path", _folders(spark, sf), "id")
    return yes.select("id", "n_files", F.lit(True).alias("recoverable")).unionByName(no.select("id", "n_files", F.lit(False).alias("recoverable")))


@query("c5_apply_pair_decisions", f"""
WITH {IMAGED} SELECT id, split, CASE WHEN lang = 'fr' AND label_str = 'No Finding' THEN 'new/' || id || '_a.png|new/' || id || '_b.png' ELSE array_to_string(image_path, '|') END AS images FROM imaged""")
def _(spark, sf):
    s = imaged(spark, sf)
    new = F.array(*[F.concat(F.lit("new/"), "id", F.lit(x)) for x in ("_a.png", "_b.png")])
    decided = s.where((F.col("lang") == "fr") & (F.col("label_str") == "No Finding")).select("id", new.alias("image_path"))
    out = C.apply_pair_decisions(s.select("id", "split", "image_path"), decided, "id", "image_path")
    return out.select("id", "split", joined("image_path").alias("images"))


def _records(spark, sf):
    """Instruction records with known faults."""
    s = imaged(spark, sf)
    lang, l = F.col("lang"), F.col("label_str")
    target = F.when(lang == "en", format_target(F.col("findings"), F.col("impression"), "findings_impression")).when(lang == "es", " \n").otherwise(F.col("report"))
    labels = (
        F.when(l == "Toxic", F.array(F.lit("Toxic"), F.lit("Toxic"))).when(l == "LowQuality", F.array(F.lit("No Finding"), F.lit("LowQuality")))
        .when(l == "LowQuality|Toxic", F.array(F.lit("Strange"), F.lit("Unlabeled"))).otherwise(F.col("labels"))
    )
    r = M.build_record(F.col("id"), F.col("image_path"), labels, target, F.when(lang == "fr", "other").otherwise("sys"), F.lit("ask"))
    once = s.select(r.alias("r"), "split", "label_str", "lang").select("r.*", "split", "label_str", "lang")
    again = once.where(F.col("label_str") == "Toxic").withColumn("split", F.when(F.col("lang") == "en", "val").otherwise(F.col("split")))
    third = once.where((F.col("label_str") == "Toxic") & (F.col("lang") == "en")).withColumn("split", F.lit("test"))
    return cut(once.unionByName(again).unionByName(third).drop("label_str", "lang"))  # read by several rules


_VIEWS = f"list_sort([coalesce({K.view_of('p')}, 'unknown') for p in image_path])"
_REC = IMAGED + f""",
rec AS (SELECT id, split, lang, label_str, image_path, findings, impression, report FROM imaged UNION ALL
  SELECT id, CASE WHEN lang = 'en' THEN 'val' ELSE split END, lang, label_str, image_path, findings, impression, report FROM imaged WHERE label_str = 'Toxic' UNION ALL
  SELECT id, 'test', lang, label_str, image_path, findings, impression, report FROM imaged WHERE label_str = 'Toxic' AND lang = 'en'),
dup AS (SELECT id, count(*) AS n, min(split) AS lo FROM rec GROUP BY id HAVING count(*) > 1),
leak AS (SELECT DISTINCT a.id, a.split AS lo, b.split AS hi FROM rec a JOIN rec b ON b.id = a.id AND a.split < b.split)"""


@query("c13_dq_rules", f"""
WITH {_REC}
SELECT 'image_count' AS rule, split, CAST(id AS VARCHAR) AS id, CAST(len(image_path) AS VARCHAR) AS detail FROM rec WHERE len(image_path) <> 2
UNION ALL SELECT 'target_blank', split, CAST(id AS VARCHAR), '' FROM rec WHERE lang = 'es' OR (lang IN ('fr', 'de') AND NOT {K.filled('report')})
UNION ALL SELECT 'view_set', split, CAST(id AS VARCHAR), array_to_string({_VIEWS}, '|') FROM rec WHERE {_VIEWS} <> ['frontal', 'lateral']
UNION ALL SELECT 'target_sections', split, CAST(id AS VARCHAR), '' FROM rec WHERE lang <> 'en' OR NOT {K.filled('findings')} OR NOT {K.filled('impression')}
UNION ALL SELECT 'system_prompt', split, CAST(id AS VARCHAR), '' FROM rec WHERE lang = 'fr'
UNION ALL SELECT 'labels_duplicate', split, CAST(id AS VARCHAR), '' FROM rec WHERE label_str = 'Toxic'
UNION ALL SELECT 'labels_unknown', split, CAST(id AS VARCHAR), 'Strange' FROM rec WHERE label_str = 'LowQuality|Toxic'
UNION ALL SELECT 'healthy_not_alone', split, CAST(id AS VARCHAR), 'No Finding|LowQuality' FROM rec WHERE label_str = 'LowQuality'
UNION ALL SELECT 'fallback_not_alone', split, CAST(id AS VARCHAR), 'Strange|Unlabeled' FROM rec WHERE label_str = 'LowQuality|Toxic'
UNION ALL SELECT 'duplicate_id', lo, CAST(id AS VARCHAR), CAST(n AS VARCHAR) FROM dup UNION ALL SELECT 'split_leakage', lo, CAST(id AS VARCHAR), lo || '|' || hi FROM leak""")
def _(spark, sf):
    version = Q.Version("frontal_lateral", "findings_impression", system="sys", user="ask")
    return Q.check_records(_records(spark, sf), version, VOCAB)


@query("c13_pair_checks", f"""
WITH {IMAGED}, n AS (SELECT *, [{K.base_name('p')} for p in image_path] AS names FROM imaged)
SELECT 'pair_size' AS rule, split, CAST(id AS VARCHAR) AS id, CAST(len(names) AS VARCHAR) AS detail FROM n WHERE len(names) <> 2
UNION ALL SELECT 'pair_views', split, CAST(id AS VARCHAR), array_to_string(names, '|') FROM n WHERE len(names) = 2 AND (len([x for x in names if starts_with(x, 'frontal')]) <> 1 OR len([x for x in names if starts_with(x, 'lateral')]) <> 1)""")
def _(spark, sf):
    return Q.violations(imaged(spark, sf).select("id", "split", "image_path"), Q.pair_checks())


@query("c14_dq_verdict", f"""
WITH {_REC}, v AS (SELECT 'labels_duplicate' AS rule, split, CAST(id AS VARCHAR) AS id FROM rec WHERE label_str = 'Toxic'
  UNION ALL SELECT 'healthy_not_alone', split, CAST(id AS VARCHAR) FROM rec WHERE label_str = 'LowQuality' UNION ALL SELECT 'image_count', split, CAST(id AS VARCHAR) FROM rec WHERE len(image_path) <> 2),
k AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY split, id) AS rn FROM v),
r AS (SELECT unnest(['labels_duplicate', 'healthy_not_alone', 'image_count', 'message_roles']) AS rule)
SELECT r.rule, CAST(count(k.id) AS BIGINT) AS n, coalesce(string_agg(k.id, ';' ORDER BY rn) FILTER (rn <= 5), '') AS examples, count(k.id) = 0 AS passed FROM r LEFT JOIN k ON k.rule = r.rule GROUP BY r.rule""")
def _(spark, sf):
    rules = ["labels_duplicate", "healthy_not_alone", "image_count", "message_roles"]
    checks = [c for c in Q.record_checks(Q.Version("frontal_lateral"), VOCAB) if c[0] in rules]
    return Q.dq_verdict(Q.violations(Q.with_target(_records(spark, sf)), checks), rules)


def _clean_records(spark, sf):
    s = imaged(spark, sf)
    r = M.build_record(F.col("id"), F.col("image_path"), F.col("labels"), F.col("findings"), F.lit("sys"), F.lit("ask"))
    return s.select(r.alias("r")).select("r.*")


@query("c6_label_records", f"""
WITH {IMAGED} SELECT CAST(id AS VARCHAR) AS id, 'classify|pick labels|Clinical findings:' || chr(10) || 'LowQuality: ' || CASE WHEN list_contains(labels, 'LowQuality') THEN 'Present' ELSE 'Absent' END || chr(10)
  || 'Toxic: ' || CASE WHEN list_contains(labels, 'Toxic') THEN 'Present' ELSE 'Absent' END AS texts, label_str AS labels, 'clinical_classification' AS task_type, len(image_path) AS n_parts FROM imaged WHERE label_str <> 'Unlabeled'""")
def _(spark, sf):
    vocab = type(VOCAB)(VOCAB.labels, VOCAB.healthy, ("Other", "Unlabeled"))
    out, _ = C.label_records(_clean_records(spark, sf), vocab, 2, "dense_binary", "classify", "pick labels", strict=False)
    m = F.col("messages")
    parts = F.get(m, F.lit(1)).content_parts
    return out.select(
        "id", F.concat_ws("|", *[M.message_text(m, r) for r in ("system", "user", "assistant")]).alias("texts"),
        joined("factors.diagnostic_category").alias("labels"), "factors.task_type", F.size(F.filter(parts, lambda p: p.type == "image")).alias("n_parts"),
    )


@query("c6_label_violations", f"""
WITH {_REC} SELECT 'image_count' AS rule, CAST(id AS VARCHAR) AS id, CAST(len(image_path) AS VARCHAR) AS detail FROM rec WHERE len(image_path) <> 2
UNION ALL SELECT 'labels_duplicate', CAST(id AS VARCHAR), '' FROM rec WHERE label_str = 'Toxic'
UNION ALL SELECT 'labels_unknown', CAST(id AS VARCHAR), 'Strange' FROM rec WHERE label_str = 'LowQuality|Toxic'
UNION ALL SELECT 'healthy_not_alone', CAST(id AS VARCHAR), 'No Finding|LowQuality' FROM rec WHERE label_str = 'LowQuality'
UNION ALL SELECT 'fallback_not_alone', CAST(id AS VARCHAR), 'Strange|Unlabeled' FROM rec WHERE label_str = 'LowQuality|Toxic'""")
def _(spark, sf):
    return C.label_violations(_records(spark, sf), VOCAB, 2)


@query("c6_label_counts", f"""
WITH {IMAGED} SELECT CAST(count(*) AS BIGINT) AS source_records, CAST(count(*) FILTER (label_str <> 'Unlabeled') AS BIGINT) AS clinical_records, CAST(0 AS BIGINT) AS excluded_other,
  CAST(count(*) FILTER (label_str = 'Unlabeled') AS BIGINT) AS excluded_unlabeled, CAST(count(*) FILTER (len(image_path) <> 2) AS BIGINT) AS wrong_image_count FROM imaged""")
def _(spark, sf):
    vocab = type(VOCAB)(VOCAB.labels, VOCAB.healthy, ("Other", "Unlabeled"))
    return C.label_records(_clean_records(spark, sf), vocab, 2, "positive_only", "classify", "pick labels", strict=False)[1]


@query("p10_priority_reason", f"""
WITH {IMAGED} SELECT id, CASE WHEN NOT {K.filled('impression')} THEN 'no_findings' WHEN len(image_path) < 2 THEN 'too_few_files' ELSE 'unexplained' END AS exclusion,
  CASE WHEN NOT {K.filled('impression')} THEN 'missing' WHEN label_str = 'Toxic' THEN 'placeholder' ELSE 'recoverable' END AS impression_state FROM imaged""")
def _(spark, sf):
    return imaged(spark, sf).select(
        "id", C.exclusion_reason(F.col("impression"), F.size("image_path")).alias("exclusion"),
        C.impression_status(F.col("impression"), F.col("label_str") == "Toxic").alias("impression_state"),
    )


_FLAGS = """CASE lang WHEN 'en' THEN true WHEN 'fr' THEN false END AS fr, CASE label_str WHEN 'No Finding' THEN true WHEN 'Toxic' THEN false END AS la"""
_ISSUE_SQL = {
    "no_findings": "findings = ''", "no_impression": "impression = ''", "no_frontal": "fr = false", "no_lateral": "la = false",
    "unknown_views": "fr IS NULL", "no_images": "len(image_path) = 0", "multi_images": "len(image_path) > 2",
    "complete": "findings <> '' AND impression <> '' AND fr = true AND la = true",
}


@query("p31_filter_studies", f"WITH {IMAGED}, f AS (SELECT *, {_FLAGS} FROM imaged) " + " UNION ALL ".join(
    f"SELECT '{i}' AS issue, id FROM f WHERE {c} AND split = 'test' AND (contains(CAST(id AS VARCHAR), 'on') OR contains(lower(report), 'on'))" for i, c in _ISSUE_SQL.items()))
def _(spark, sf):
    lang, l = F.col("lang"), F.col("label_str")
    s = imaged(spark, sf).withColumns({
        "frontal": F.when(lang == "en", True).when(lang == "fr", False), "lateral": F.when(l == "No Finding", True).when(l == "Toxic", False),
        "images": F.col("image_path"),
    })
    return C.filter_studies(s, "test", None, " ON ").select(F.explode(C.issues_of()).alias("issue"), "id")


def _batch(spark, sf):
    """Results of a batch over the studies, with every kind of error."""
    s = studies(spark, sf)
    lang, l, i = F.col("lang"), F.col("label_str"), F.col("id").cast("string")
    good = F.to_json(F.struct(F.split("label_str", "[|]").alias("diagnostic_label")))
    odd = F.to_json(F.struct(F.lit("x").alias("label")))

    def block(text):
        return F.struct(F.lit("text").alias("type"), text.alias("text"))

    content = (
        F.when(lang == "de", F.array(block(good), block(good))).when(lang == "es", F.array(block(odd)))
        .when(l == "LowQuality|Toxic", F.array(block(F.lit("{broken")))).otherwise(F.array(block(good)))
    )
    usage = F.struct(F.length("findings").cast("bigint").alias("input_tokens"), F.lit(7).cast("bigint").alias("output_tokens"))
    message = F.struct(content.alias("content"), usage.alias("usage"))
    result = F.struct(F.when(lang == "fr", "errored").otherwise("succeeded").alias("type"), message.alias("message"))
    name = F.when(l == "LowQuality", "").when(l == "No Finding", F.when(F.col("source") < "src12", F.concat(F.lit("x"), i)).otherwise(i)).otherwise(i)
    rows = s.select(name.alias("custom_id"), result.alias("result"), "label_str")
    twice = rows.unionByName(rows.where(F.col("label_str") == "Toxic")).drop("label_str")
    return twice, s.select(i.alias("custom_id"))


_BATCH = STUDIES + """,
rows0 AS (SELECT CASE WHEN label_str = 'LowQuality' THEN '' WHEN label_str = 'No Finding' AND source < 'src12' THEN 'x' || id ELSE CAST(id AS VARCHAR) END AS custom_id, lang, label_str, length(findings) AS toks FROM studies),
res AS (SELECT * FROM rows0 UNION ALL SELECT * FROM rows0 WHERE label_str = 'Toxic'),
typed AS (SELECT custom_id, toks, label_str, CASE WHEN custom_id = '' THEN 'bad_id' WHEN starts_with(custom_id, 'x') THEN 'unknown_id' WHEN label_str = 'Toxic' THEN 'duplicate_id' WHEN lang = 'fr' THEN 'not_succeeded'
  WHEN lang = 'de' THEN 'text_block_count' WHEN lang = 'es' THEN 'wrong_keys' WHEN label_str = 'LowQuality|Toxic' THEN 'not_json' END AS error FROM res)"""


@query("j15_batch_errors", f"""
WITH {_BATCH} SELECT custom_id, error FROM typed WHERE error IS NOT NULL
UNION ALL SELECT CAST(id AS VARCHAR), 'missing' FROM studies WHERE label_str = 'LowQuality' OR (label_str = 'No Finding' AND source < 'src12')""")
def _(spark, sf):
    return B.reconcile_batch(*_batch(spark, sf), ["diagnostic_label"])[1]


@query("j15_batch_payloads", f"""
WITH {_BATCH} SELECT custom_id, '["' || replace(label_str, '|', '","') || '"]' AS labels FROM typed WHERE error IS NULL""")
def _(spark, sf):
    parsed = B.reconcile_batch(*_batch(spark, sf), ["diagnostic_label"])[0]
    labels = F.from_json("payload", "diagnostic_label array<string>").diagnostic_label
    return parsed.select("custom_id", F.to_json(labels).alias("labels"))


@query("j15_batch_usage", f"WITH {_BATCH} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(toks) AS BIGINT) AS input_tokens, CAST(7 * count(*) AS BIGINT) AS output_tokens FROM typed WHERE error IS NULL")
def _(spark, sf):
    return B.reconcile_batch(*_batch(spark, sf), ["diagnostic_label"])[2]


@query("c15_resume_queue", f"""
WITH {STUDIES} SELECT id FROM studies WHERE (({K.filled('findings')} AND lang IN ('en', 'de')) OR ({K.filled('impression')} AND lang = 'fr')) AND label_str <> 'Toxic'""")
def _(spark, sf):
    s = studies(spark, sf).withColumns({
        "findings_it": F.when(F.col("lang").isin("en", "de"), " ").otherwise("x"), "impression_it": F.when(F.col("lang") == "fr", "").otherwise("x"),
    })
    done = s.where(F.col("label_str") == "Toxic").select("id")
    return B.resume_queue(s, {"findings": "findings_it", "impression": "impression_it"}, done).select("id")


@query("c16_submission_state", f"""
SELECT CAST(count(*) AS BIGINT) AS n, {_fingerprint_sql("(2 * doc_id) || ':' || doc_id")} AS ids_hash, {_fingerprint_sql("'{' || '\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"text\":' || to_json(text) || '}'")} AS input_hash FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("position", 2 * F.col("doc_id"))
    return B.submission_state(d, "doc_id", ["lang", "text"], "position")


@query("c16_check_submission", "SELECT unnest(['n', 'ids_hash', 'input_hash']) AS part")
def _(spark, sf):
    d = table(spark, sf, "documents")
    now = B.submission_state(d, "doc_id", ["lang", "text"])
    then = B.submission_state(d.where(F.col("lang") != "es"), "doc_id", ["lang", "text"])
    return B.check_submission(now, then).select("part")


@query("c16_reordered_submission", "SELECT 'ids_hash' AS part")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text", F.col("doc_id").alias("position"))
    now = B.submission_state(d, "doc_id", ["lang", "text"], "position")
    then = B.submission_state(d.withColumn("position", -F.col("position")), "doc_id", ["lang", "text"], "position")
    return B.check_submission(now, then).select("part")
