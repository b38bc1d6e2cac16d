"""Joins and reconciliation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import joins as J
from . import sqlkit as K
from .fixtures import IMAGED, PAIRS, RUN_METRICS, RUN_TABLE, RUNS, STUDIES, imaged, pairs, r6, run_metrics, runs, studies, table, two_runs
from .registry import query
from .texts import STUDY_IDS, _study_ids


@query("j1_enrich", f"""
WITH {STUDIES}, r AS (SELECT id, impression FROM studies WHERE {K.filled('impression')})
SELECT 'kept' AS side, s.split, s.id, md5(r.impression) AS section FROM studies s JOIN r ON r.id = s.id
UNION ALL SELECT 'dropped', s.split, s.id, NULL FROM studies s WHERE s.id NOT IN (SELECT id FROM r)""")
def _(spark, sf):
    s = studies(spark, sf)
    kept, dropped = J.enrich(s.select("id", "split"), s.select("id", "impression"), "id", "impression", ["id", "split"])
    kept = kept.select(F.lit("kept").alias("side"), "split", "id", F.md5("impression").alias("section"))
    return kept.unionByName(dropped.select(F.lit("dropped").alias("side"), "split", "id"), allowMissingColumns=True)


@query("j2_restrict_to", "SELECT d.doc_id AS id, d.lang FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    keys = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return J.restrict_to(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), keys, "id")


@query("j3_attach_source", """
SELECT d.doc_id AS id, d.lang, l.doc_id IS NOT NULL AS has_source, coalesce('q' || l.quality, '') AS grade,
  CASE WHEN l.doc_id IS NULL THEN 'orphan' ELSE 'matched' END AS side FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(spark, sf):
    source = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("q"), "quality").alias("grade"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    rows, orphans = J.attach_source(d, source, "id", ["grade"])
    return rows.join(orphans.select("id", F.lit("orphan").alias("side")), "id", "left").na.fill({"side": "matched"})


def _copies(spark, sf):
    """Two copies of the studies that differ in known ways."""
    s = imaged(spark, sf)
    names = F.transform("image_path", X.base_name)
    a = s.where(F.col("lang") != "es").select(
        "id", "split", F.col("report").alias("text"), names.alias("images"), F.lit("x").alias("tag")
    )
    lang, label = F.col("lang"), F.col("label_str")
    renamed = F.transform(names, lambda n: F.concat(F.lit("new_"), n))
    mapping = F.map_from_arrays(renamed, F.when(label == "Toxic", F.reverse(names)).otherwise(names))
    wrong = F.map_from_arrays(renamed, F.transform(names, lambda n: F.concat(n, F.lit("?"))))
    b = s.where((lang != "de") | (label != "Unlabeled")).select(
        "id", F.when(F.col("source") < "src12", "moved").otherwise(F.col("split")).alias("split"),
        F.when(label == "Toxic", F.upper("report")).otherwise(F.col("report")).alias("text"),
        F.when(label == "LowQuality", F.concat(renamed, F.array(F.lit("extra.png")))).otherwise(renamed).alias("images"),
        F.when(lang == "fr", F.lit(None)).otherwise(F.lit("x")).alias("tag"),
        F.when(F.col("source") >= "src18", F.lit(None)).when(label == "No Finding", wrong).otherwise(mapping).alias("mapping"),
        F.when(lang == "fr", F.slice(renamed, 1, 1)).otherwise(renamed).alias("files"),
    )
    return a, b


@query("j4_reconcile", f"""
WITH {IMAGED}, a AS (SELECT * FROM imaged WHERE lang <> 'es'), b AS (SELECT * FROM imaged WHERE lang <> 'de' OR label_str <> 'Unlabeled'),
both_sides AS (SELECT a.*, len(a.image_path) AS n FROM a JOIN b ON b.id = a.id)
SELECT id, 'only_in_a' AS finding FROM a WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT id, 'only_in_b' FROM b WHERE id NOT IN (SELECT id FROM a)
UNION ALL SELECT id, 'split_differs' FROM both_sides WHERE source < 'src12'
UNION ALL SELECT id, 'text_differs' FROM both_sides WHERE label_str = 'Toxic' AND upper(report) <> report
UNION ALL SELECT id, 'image_count_differs' FROM both_sides WHERE label_str = 'LowQuality'
UNION ALL SELECT id, 'field_set_differs' FROM both_sides WHERE lang = 'fr'
UNION ALL SELECT id, 'mapping_absent' FROM both_sides WHERE source >= 'src18'
UNION ALL SELECT id, 'mapping_incomplete' FROM both_sides WHERE source < 'src18' AND label_str = 'LowQuality'
UNION ALL SELECT id, 'pair_differs' FROM both_sides WHERE source < 'src18' AND label_str = 'No Finding'
UNION ALL SELECT id, 'file_missing' FROM both_sides WHERE label_str = 'LowQuality' OR (lang = 'fr' AND n > 1)""")
def _(spark, sf):
    a, b = _copies(spark, sf)
    return J.reconcile(a, b, "id", ["tag"])


_TA, _TB = K.tokens("a"), K.tokens("b")


@query("j5_match_text", f"""
WITH {STUDIES}, {STUDY_IDS}, src AS (SELECT CAST(id AS VARCHAR) AS k, findings AS a FROM studies WHERE label_str <> 'Unlabeled'),
b AS (SELECT i.name, nullif(regexp_extract(i.name, '^CXR([0-9]+)_', 1), '') AS k, s.report AS b FROM ids i JOIN studies s ON s.id = i.doc_id),
j AS (SELECT b.name, b.k, b.b, src.a, src.k IS NOT NULL AS found FROM b LEFT JOIN src ON src.k = b.k),
t AS (SELECT *, {K.alnum('a')} AS ka, {K.alnum('b')} AS kb, list_distinct({_TA}) AS ta, list_distinct({_TB}) AS tb FROM j),
n AS (SELECT *, len(list_intersect(ta, tb)) AS i, len(ta) + len(tb) - len(list_intersect(ta, tb)) AS u FROM t),
m AS (SELECT *, CASE WHEN u = 0 THEN 1.0 ELSE i / u END AS jac FROM n)
SELECT name, CASE WHEN k IS NULL THEN 'BAD_ID' WHEN NOT found THEN 'SOURCE_MISSING' WHEN a = '' THEN 'NO_SOURCE' WHEN ka = kb THEN 'EXACT'
  WHEN ka <> '' AND contains(kb, ka) THEN 'SUBSET' WHEN jac >= 0.9 THEN 'NEAR' WHEN jac >= 0.5 THEN 'PARTIAL' ELSE 'MISMATCH' END AS status,
  round(CASE WHEN found AND a <> '' THEN jac ELSE 0.0 END, 6) AS jaccard FROM m""")
def _(spark, sf):
    s = studies(spark, sf)
    a = s.where(F.col("label_str") != "Unlabeled").select(F.col("id").cast("string").alias("k"), "findings")
    names = _study_ids(spark, sf).select(F.col("doc_id").alias("id"), "name", X.study_key(F.col("name"), "strict").alias("k"))
    b = s.select("id", "report").join(names, "id").select("name", "k", "report")
    return r6(J.match_text(a, b, "k", "findings", "report").select("name", "status", "jaccard"), "jaccard")


@query("j6_reconcile3", f"""
WITH {IMAGED}, n AS (SELECT id, lang, label_str, [{K.base_name('p')} for p in image_path] AS names FROM imaged),
ann AS (SELECT id, names FROM n WHERE lang <> 'es'),
disk AS (SELECT id, CASE WHEN label_str = 'No Finding' THEN list_concat(names, ['stray.png']) WHEN label_str = 'Toxic' THEN list_concat(names, ['lateral_9' || i || '.png' FOR i IN range(70)]) ELSE names[1:1] END AS names FROM n WHERE lang <> 'fr'),
st AS (SELECT id, CASE WHEN lang = 'de' THEN ['gone.png'] ELSE names END AS names FROM n WHERE label_str <> 'Unlabeled'),
j AS (SELECT a.id, a.names AS an, d.names AS dn, coalesce(s.names, []) AS sn FROM ann a JOIN disk d ON d.id = a.id LEFT JOIN st s ON s.id = a.id)
SELECT id, 'record_without_folder' AS rule, '' AS file FROM ann WHERE id NOT IN (SELECT id FROM disk)
UNION ALL SELECT id, 'folder_without_record', '' FROM disk WHERE id NOT IN (SELECT id FROM ann)
UNION ALL SELECT id, 'declared_not_on_disk', unnest([f for f in an if NOT list_contains(dn, f)]) FROM j
UNION ALL SELECT id, 'state_not_on_disk', unnest([f for f in sn if NOT list_contains(dn, f)]) FROM j
UNION ALL SELECT id, 'disk_not_in_state', unnest([f for f in dn if NOT list_contains(sn, f)]) FROM j
UNION ALL SELECT id, 'declared_not_in_state', unnest([f for f in an if NOT list_contains(sn, f)]) FROM j
UNION ALL SELECT id, 'bad_name', unnest([f for f in dn if NOT regexp_matches(f, '^(frontal|lateral)(_[0-9]+)?[.]png$')]) FROM j""")
def _(spark, sf):
    n = imaged(spark, sf).withColumn("names", F.transform("image_path", X.base_name))
    lang, label = F.col("lang"), F.col("label_str")
    ann = n.where(lang != "es").select("id", F.col("names").alias("files"))
    many = F.transform(F.sequence(F.lit(0), F.lit(69)), lambda i: F.concat(F.lit("lateral_9"), i.cast("string"), F.lit(".png")))
    disk = n.where(lang != "fr").select(
        "id", F.when(label == "No Finding", F.concat("names", F.array(F.lit("stray.png")))).when(label == "Toxic", F.concat("names", many)).otherwise(F.slice("names", 1, 1)).alias("files")
    )
    state = n.where(label != "Unlabeled").select("id", F.when(lang == "de", F.array(F.lit("gone.png"))).otherwise(F.col("names")).alias("files"))
    return J.reconcile3(*[side.select("id", F.explode_outer("files").alias("file")) for side in (ann, disk, state)])


def _image_sides(spark, sf):
    """Embeddings as originals, and copies of them in five conditions."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    digest, pixels = F.md5(F.to_json("embedding")), F.col("embedding").cast("array<double>")
    kind = F.col("vec_id") % 5
    original = e.select(
        F.concat(F.lit("p"), "label").alias("patient"), F.concat_ws("_", F.lit("s"), "label", F.col("vec_id") % 7).alias("study"),
        F.concat(F.lit("o"), "vec_id").alias("file"), F.lit("OK").alias("state"), F.lit("8x8").alias("shape"),
        digest.alias("digest"), pixels.alias("data"),
    ).where(F.col("patient") != "p9")
    derived = e.select(
        F.concat(F.lit("p"), "label").alias("patient"),
        F.concat_ws("_", F.lit("s"), "label", (F.col("vec_id") + F.when(kind == 1, 1).otherwise(0)) % 7).alias("study"),
        F.concat(F.lit("d"), "vec_id").alias("file"), F.when(kind == 4, "UNREADABLE").otherwise("OK").alias("state"),
        F.when(kind == 3, "4x16").otherwise("8x8").alias("shape"),
        F.when(kind == 2, F.md5(F.concat(digest, F.lit("changed")))).otherwise(digest).alias("digest"),
        F.when(kind == 2, F.transform(pixels, lambda x: F.round(x * 2, 3))).otherwise(pixels).alias("data"),
    )
    return derived, original


@query("j7_match_images", """
WITH o AS (SELECT vec_id, label, embedding FROM embeddings WHERE label <> 9),
d AS (SELECT vec_id, label, vec_id % 5 AS kind, (vec_id + CASE WHEN vec_id % 5 = 1 THEN 1 ELSE 0 END) % 7 AS st, embedding,
  [round(CAST(x AS DOUBLE) * 2, 3) for x in embedding] AS changed FROM embeddings),
same AS (SELECT d.vec_id, bool_or(o.vec_id % 7 = d.st) AS in_study FROM d JOIN o ON o.label = d.label AND o.embedding = d.embedding GROUP BY d.vec_id),
gaps AS (SELECT d.vec_id, o.vec_id AS ov, [abs(d.changed[i] - CAST(o.embedding[i] AS DOUBLE)) for i in range(1, 65)] AS g FROM d JOIN o ON o.label = d.label WHERE d.kind = 2),
dist AS (SELECT vec_id, 's_' || (SELECT label FROM o WHERE o.vec_id = ov) || '_' || (ov % 7) || '/o' || ov AS name, round(list_avg(g), 9) AS m, list_max(g) AS x FROM gaps),
near AS (SELECT vec_id, name, m, x, row_number() OVER (PARTITION BY vec_id ORDER BY m, name) AS rn FROM dist),
st AS (SELECT d.*, s.in_study, CASE WHEN kind = 4 THEN 'UNREADABLE' WHEN label = 9 THEN 'ORIG_MISSING' WHEN kind = 3 THEN 'SHAPE_MISMATCH'
  WHEN kind = 2 THEN 'DIFF_PIXELS' WHEN s.in_study THEN 'EXACT' ELSE 'EXACT_PATIENT' END AS status FROM d LEFT JOIN same s ON s.vec_id = d.vec_id)
SELECT 'p' || label AS patient, 'd' || st.vec_id AS file, status, name AS nearest, round(m, 6) AS mean_abs, round(x, 6) AS max_abs
FROM st LEFT JOIN near n ON n.vec_id = st.vec_id AND n.rn = 1 AND st.status = 'DIFF_PIXELS'""")
def _(spark, sf):
    derived, original = _image_sides(spark, sf)
    return J.match_images(derived, original).drop("study")


@query("j8_compare_sets", f"""
WITH {IMAGED}, p AS (SELECT id, lang, label_str, [md5(x) for x in image_path] AS a FROM imaged),
s AS (SELECT id, a, CASE WHEN label_str = 'Toxic' THEN list_concat(a, ['z']) WHEN label_str = 'LowQuality' THEN ['!FILE_MISSING']
  WHEN lang = 'es' THEN ['!UNREADABLE', '!FILE_MISSING'] WHEN lang = 'fr' THEN list_reverse(a) WHEN lang = 'de' THEN list_concat(a[1:1], [md5('other')]) ELSE a END AS b FROM p),
t AS (SELECT *, CASE WHEN len(a) <> len(b) THEN 'COUNT_MISMATCH' WHEN len([x for x in b if starts_with(x, '!')]) > 0
  THEN CASE WHEN len([x for x in b if starts_with(x, '!') AND x <> '!FILE_MISSING']) = 0 THEN 'FILE_MISSING' ELSE 'UNREADABLE' END
  WHEN a = b THEN 'IDENTICAL' WHEN list_sort(a) = list_sort(b) THEN 'PERMUTED' ELSE 'CONTENT_MISMATCH' END AS status FROM s)
SELECT id, status, CASE status WHEN 'PERMUTED' THEN array_to_string([list_position(a, x) - 1 for x in b], ',')
  WHEN 'CONTENT_MISMATCH' THEN array_to_string([i - 1 for i in range(1, len(a) + 1) if a[i] <> b[i]], ',')
  WHEN 'FILE_MISSING' THEN array_to_string([x for x in b if starts_with(x, '!')], ';')
  WHEN 'UNREADABLE' THEN array_to_string([x for x in b if starts_with(x, '!')], ';') ELSE '' END AS detail FROM t""")
def _(spark, sf):
    a = F.transform("image_path", F.md5)
    lang, label = F.col("lang"), F.col("label_str")
    b = (
        F.when(label == "Toxic", F.concat(a, F.array(F.lit("z")))).when(label == "LowQuality", F.array(F.lit("!FILE_MISSING")))
        .when(lang == "es", F.array(F.lit("!UNREADABLE"), F.lit("!FILE_MISSING"))).when(lang == "fr", F.reverse(a))
        .when(lang == "de", F.concat(F.slice(a, 1, 1), F.array(F.md5(F.lit("other"))))).otherwise(a)
    )
    s = imaged(spark, sf).select("id", a.alias("a"), b.alias("b"))
    return s.select("id", V.compare_sets(F.col("a"), F.col("b")).alias("c")).select("id", "c.*")


@query("f5_vector_diff", """
WITH p AS (SELECT vec_id, embedding AS a, list_reverse(embedding) AS b FROM embeddings),
g AS (SELECT vec_id, [abs(CAST(a[i] AS DOUBLE) - CAST(b[i] AS DOUBLE)) for i in range(1, len(a) + 1)] AS g FROM p)
SELECT vec_id, round(list_max(g), 6) AS max_abs, round(list_avg(g), 6) AS mean_abs, round(len([x for x in g if x <> 0]) * 100.0 / len(g), 6) AS pct_different,
  true AS uneven_is_null FROM g""")
def _(spark, sf):
    a = F.col("embedding")
    d = V.vector_diff(a, F.reverse(a))
    uneven = V.vector_diff(a, F.slice(a, 1, 3)).isNull()
    out = table(spark, sf, "embeddings").select("vec_id", d.alias("d"), uneven.alias("uneven_is_null")).select("vec_id", "d.*", "uneven_is_null")
    return r6(out, "max_abs")


_SYM = """
n AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS x FROM embeddings),
s AS (SELECT vec_id, label, x, list_avg(x) AS m, sqrt(list_var_pop(x)) + 1e-6 AS sd FROM n),
sym AS (SELECT vec_id, label, list_sum([(x[i] - m) * (x[((i - 1) // 8) * 8 + 8 - ((i - 1) % 8)] - m) for i in range(1, 65)]) / 64 / (sd * sd) AS score FROM s)"""


@query("f6_mirror_symmetry", f"""
WITH {_SYM} SELECT vec_id, round(score, 6) AS score FROM sym""")
def _(spark, sf):
    return r6(table(spark, sf, "embeddings").select("vec_id", V.mirror_symmetry(F.col("embedding"), 8).alias("score")), "score")


@query("f6_score_table", f"""
WITH {_SYM} SELECT vec_id, CASE WHEN label % 2 = 0 THEN 0.25 ELSE round(score, 6) END AS score, label % 2 = 1 AS fresh FROM sym""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    kept = e.where(F.col("label") % 2 == 0).select("vec_id", F.lit(0.25).alias("score"))
    return r6(V.scored_by_key(e, "vec_id", V.mirror_symmetry(F.col("embedding"), 8), kept), "score")


@query("f6_symmetry_views", f"""
WITH {_SYM}, st AS (SELECT label, vec_id // 8 AS study, score FROM sym)
SELECT label, study, bool_or(score >= 0.05) AS frontal, bool_or(score < 0.05) AS lateral, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY ALL""")
def _(spark, sf):
    s = table(spark, sf, "embeddings").select("label", F.expr("vec_id div 8").alias("study"), V.mirror_symmetry(F.col("embedding"), 8).alias("score"))
    frontal, lateral = V.symmetry_flags(F.col("score"), 0.05)
    return s.groupBy("label", "study").agg(frontal.alias("frontal"), lateral.alias("lateral"), F.count(F.lit(1)).alias("n"))


@query("j9_join_baseline", f"""
WITH {RUN_METRICS}, base AS (SELECT model, dataset, metric, avg(value) AS baseline FROM run_metrics WHERE mode = 'lora' GROUP BY ALL),
late AS (SELECT experiment, unnest(['late_score', 'click']) AS metric, 1.5 AS v FROM runs),
own AS (SELECT coalesce(m.experiment, l.experiment) AS experiment, coalesce(m.metric, l.metric) AS metric, coalesce(m.value, l.v) AS value
  FROM run_metrics m FULL JOIN late l ON l.experiment = m.experiment AND l.metric = m.metric)
SELECT o.experiment, r.model, r.dataset, o.metric, round(o.value, 6) AS value, round(b.baseline, 6) AS baseline, round(o.value - b.baseline, 6) AS delta
FROM own o JOIN runs r ON r.experiment = o.experiment LEFT JOIN base b ON b.model = r.model AND b.dataset = r.dataset AND b.metric = o.metric""")
def _(spark, sf):
    m = run_metrics(spark, sf)
    base = m.where(F.col("mode") == "lora").groupBy("model", "dataset", "metric").agg(F.avg("value").alias("value"))
    names = F.explode(F.array(F.lit("late_score"), F.lit("click"))).alias("metric")
    late = runs(spark, sf).select("experiment", names).withColumn("value", F.lit(1.5))
    out = J.join_baseline(m.drop("mode"), base, ["model", "dataset"], late)
    return r6(out, "value", "baseline", "delta")


_PAIRED = f"""
WITH {RUN_TABLE}, cells AS (SELECT model, dataset, mode, max(best_value) AS v FROM runs GROUP BY ALL),
paired AS (SELECT a.model, a.dataset, a.v AS value_a, b.v AS value_b, b.v - a.v AS delta FROM cells a JOIN cells b ON a.model = b.model AND a.dataset = b.dataset
  WHERE a.mode = 'lora' AND b.mode = 'qlora')"""


def _cells(spark, sf):
    return runs(spark, sf).groupBy("model", "dataset", "mode").agg(F.max("best_value").alias("v"))


@query("j10_paired_compare", f"""{_PAIRED}
SELECT model, dataset, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b, round(delta, 6) AS delta, CASE WHEN delta > 0 THEN 'qlora' ELSE 'lora' END AS winner FROM paired""")
def _(spark, sf):
    return r6(J.paired_compare(_cells(spark, sf), "mode", ["model", "dataset"], "lora", "qlora", "v")[0], "value_a", "value_b", "delta")


@query("j10_paired_summary", f"""{_PAIRED}
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.5), 6) AS median, CAST(count(*) FILTER (delta > 0) AS BIGINT) AS wins_b FROM paired""")
def _(spark, sf):
    return r6(J.paired_compare(_cells(spark, sf), "mode", ["model", "dataset"], "lora", "qlora", "v")[1], "mean", "median")


@query("j11_align_predictions", f"""
WITH {RUNS} SELECT CAST(count(c.id) AS BIGINT) AS n_current, CAST(count(b.id) AS BIGINT) AS n_baseline, CAST(count(*) FILTER (c.id = b.id) AS BIGINT) AS n_common,
  CAST(count(*) FILTER (b.id IS NULL) AS BIGINT) AS n_only_current, CAST(count(*) FILTER (c.id IS NULL) AS BIGINT) AS n_only_baseline, 'ok' AS status
FROM current_run c FULL JOIN baseline_run b ON b.id = c.id""")
def _(spark, sf):
    return J.align_predictions(*two_runs(spark, sf))[1]


@query("j12_merge_validated", "SELECT d.doc_id AS id, d.source, b.h AS digest FROM documents d LEFT JOIN (SELECT doc_id, md5(text) AS h FROM documents WHERE lang = 'en') b ON b.doc_id = d.doc_id")
def _(spark, sf):
    d = table(spark, sf, "documents")
    right = d.where(F.col("lang") == "en").select(F.col("doc_id").alias("id"), F.col("text").alias("payload"), F.md5("text").alias("digest"))
    left = d.select(F.col("doc_id").alias("id"), "source")
    return J.merge_validated(left, right, "id", "payload", "digest").select("id", "source", "digest")


@query("j13_cohort_diff", f"""
WITH {STUDIES}, v0 AS (SELECT split, id FROM studies WHERE lang <> 'es'), v1 AS (SELECT split, id FROM studies WHERE lang <> 'de'),
v2 AS (SELECT split, id FROM studies WHERE label_str <> 'Toxic'), s AS (SELECT DISTINCT split FROM studies)
SELECT s.split, 'en_only' AS base, v.version, CAST((SELECT count(*) FROM (SELECT id FROM vv WHERE vv.split = s.split AND vv.version = v.version EXCEPT SELECT id FROM v0 WHERE v0.split = s.split)) AS BIGINT) AS added,
  CAST((SELECT count(*) FROM (SELECT id FROM v0 WHERE v0.split = s.split EXCEPT SELECT id FROM vv WHERE vv.split = s.split AND vv.version = v.version)) AS BIGINT) AS removed
FROM s, (VALUES ('v1'), ('v2')) v(version), LATERAL (SELECT 1) x""".replace("'en_only'", "'v0'").replace(
    "s AS (SELECT DISTINCT split FROM studies)",
    "s AS (SELECT DISTINCT split FROM studies), vv AS (SELECT 'v1' AS version, * FROM v1 UNION ALL SELECT 'v2', * FROM v2)").replace(", LATERAL (SELECT 1) x", ""))
def _(spark, sf):
    s = studies(spark, sf).select("split", "id", "lang", "label_str")
    member = F.array_compact(F.array(
        F.when(F.col("lang") != "es", "v0"), F.when(F.col("lang") != "de", "v1"), F.when(F.col("label_str") != "Toxic", "v2")
    ))
    return J.cohort_diff(s.select("split", "id", F.explode(member).alias("version")), ["v0", "v1", "v2"])


def _update_sides(spark, sf):
    s = studies(spark, sf).select("id", "report", F.when(F.col("label_str") != "Unlabeled", F.col("label_str")).alias("answer"))
    lang = studies(spark, sf).where(F.col("lang") == "fr")
    real = lang.select("id", F.when(F.col("label_str") == "No Finding", "").otherwise("done").alias("answer"))
    strange = lang.where(F.col("label_str") == "Toxic").select((-F.col("id") - 1).alias("id"), F.lit("done").alias("answer"))
    empty = lang.where(F.col("label_str") == "LowQuality").select(F.lit(None).cast("bigint").alias("id"), F.lit("done").alias("answer"))
    return s, real.unionByName(strange).unionByName(empty)


@query("j14_apply_updates", f"""
WITH {STUDIES} SELECT id, CASE WHEN lang = 'fr' THEN CASE WHEN label_str = 'No Finding' THEN '' ELSE 'done' END
  WHEN label_str <> 'Unlabeled' THEN label_str END AS answer FROM studies""")
def _(spark, sf):
    base, updates = _update_sides(spark, sf)
    return J.apply_updates(base, updates, "id", ["answer"], overwrite=True)[0].select("id", "answer")


@query("j14_update_violations", f"""
WITH {STUDIES}, f AS (SELECT * FROM studies WHERE lang = 'fr')
SELECT CAST(id AS VARCHAR) AS id, 'already_set:answer' AS violation FROM f WHERE label_str <> 'Unlabeled'
UNION ALL SELECT CAST(id AS VARCHAR), 'blank_output:answer' FROM f WHERE label_str = 'No Finding' AND {K.filled('report')}
UNION ALL SELECT CAST(id AS VARCHAR), 'unexpected_output:answer' FROM f WHERE label_str <> 'No Finding' AND NOT {K.filled('report')}
UNION ALL SELECT CAST(-id - 1 AS VARCHAR), 'unknown_id' FROM f WHERE label_str = 'Toxic'
UNION ALL SELECT NULL, 'empty_id' FROM f WHERE label_str = 'LowQuality'""")
def _(spark, sf):
    base, updates = _update_sides(spark, sf)
    return J.apply_updates(base, updates, "id", ["answer"], sources={"answer": "report"})[1]


def _cache_sides(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    cache = c.where(F.col("role") == "user").select(X.text_key(F.col("text")).alias("key"), F.lit("hit").alias("translation"))
    return c, cache  # a text that users write twice is in the cache twice


@query("j16_lookup_cache", f"""
WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN {K.filled('text')} THEN md5({K.squash('text')}) END AS key FROM conversations),
cache AS (SELECT DISTINCT key FROM c WHERE role = 'user')
SELECT conv_id, turn, c.key, CASE WHEN cache.key IS NOT NULL THEN 'hit' END AS translation FROM c LEFT JOIN cache ON cache.key = c.key""")
def _(spark, sf):
    c, cache = _cache_sides(spark, sf)
    return J.lookup_cache(c, "text", cache)[0].select("conv_id", "turn", "key", "translation")


@query("j16_cache_stats", f"""
WITH c AS (SELECT role, md5({K.squash('text')}) AS key FROM conversations WHERE {K.filled('text')}),
cache AS (SELECT DISTINCT key FROM c WHERE role = 'user'), u AS (SELECT key, count(*) AS n FROM c GROUP BY key)
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS "unique", CAST(count(*) FILTER (key IN (SELECT key FROM cache)) AS BIGINT) AS hit,
  CAST(count(*) FILTER (key NOT IN (SELECT key FROM cache)) AS BIGINT) AS miss FROM u""")
def _(spark, sf):
    c, cache = _cache_sides(spark, sf)
    return J.lookup_cache(c, "text", cache)[2]


@query("j17_cyclic_pairing", f"""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents),
k AS (SELECT *, 1 + CAST('0x' || substr(md5('42:offset'), 1, 15) AS BIGINT) % (n - 1) AS off FROM o)
SELECT a.doc_id AS id, b.doc_id AS source_id FROM k a JOIN k b ON b.idx = (a.idx + a.off) % a.n""")
def _(spark, sf):
    return J.cyclic_pairing(table(spark, sf, "documents").select("doc_id"), "doc_id", 42)


@query("j18_cross_review", f"""
WITH {PAIRS}, s AS (SELECT p.id, e.experiment, p.prediction FROM pairs p, (VALUES ('a'), ('b')) e(experiment) WHERE NOT (e.experiment = 'b' AND length(p.prediction) % 2 = 0)),
q AS (SELECT *, row_number() OVER (ORDER BY id, experiment) AS rn FROM s WHERE length(prediction) > 100)
SELECT id, experiment, 'R' || lpad(CAST(rn AS VARCHAR), CAST(greatest(4, length(CAST(rn AS VARCHAR))) AS INTEGER), '0') AS review_id, '' AS reviewer, '' AS verdict, '' AS note FROM q""")
def _(spark, sf):
    p = pairs(spark, sf)
    probe = p.where(F.length("prediction") > 100).select("id")
    both = F.when(F.length("prediction") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    samples = p.select("id", F.explode(both).alias("experiment"), "prediction")
    return J.cross_review(probe, samples, "id", ["id", "experiment"]).drop("prediction")


_FILES_ON_DISK = """
files AS (SELECT DISTINCT p AS path FROM (SELECT lang, unnest(image_path) AS p FROM imaged) WHERE lang <> 'fr' OR contains(p, 'lateral'))"""


@query("j19_require_files", f"""
WITH {IMAGED}, {_FILES_ON_DISK}, m AS (SELECT i.id, string_agg(i.p, ';' ORDER BY i.p) AS detail FROM (SELECT id, unnest(image_path) AS p FROM imaged) i
  WHERE i.p NOT IN (SELECT path FROM files) GROUP BY i.id)
SELECT id, 'skipped' AS side, 'file_missing' AS reason, detail FROM m
UNION ALL SELECT id, 'kept', NULL, NULL FROM imaged WHERE id NOT IN (SELECT id FROM m)""")
def _(spark, sf):
    s = imaged(spark, sf).select("id", "lang", "image_path")
    files = s.select("lang", F.explode("image_path").alias("path")).where((F.col("lang") != "fr") | F.contains("path", F.lit("lateral"))).select("path")
    kept, skipped = J.require_files(s.select("id", "image_path"), "id", "image_path", files)
    k = kept.select("id", F.lit("kept").alias("side"))
    return skipped.withColumn("side", F.lit("skipped")).unionByName(k, allowMissingColumns=True)


