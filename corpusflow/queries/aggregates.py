"""Counts, shares and summaries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import text_match
from ..functions.views import caption_views
from ..operators import aggregates as A
from ..operators import runs as R
from . import sqlkit as K
from .fixtures import CURVES, IMAGED, RUN_TABLE, RUNS, STUDIES, curves, imaged, r6, runs, studies, table, two_runs
from .registry import query
from .texts import _FRONT, _SIDE, CAPTIONS, _captions, _flag

N = "CAST(count(*) AS BIGINT)"


@query("a1_dataset_stats", f"""
WITH {STUDIES}
SELECT 'rows' AS kind, split, '' AS value, {N} AS n FROM studies GROUP BY split
UNION ALL SELECT 'lang', split, lang, {N} FROM studies GROUP BY ALL
UNION ALL SELECT 'label', split, l, {N} FROM (SELECT split, unnest(labels) AS l FROM studies) GROUP BY ALL""")
def _(spark, sf):
    return A.dataset_stats(studies(spark, sf), {"label": "labels"}, {"lang": "lang"})


def _matched(spark, sf):
    m = text_match(F.col("findings"), F.col("impression"))
    return studies(spark, sf).select("id", "split", "source", m.alias("m")).select("id", "split", "source", "m.*")


_TA, _TB = K.tokens("findings"), K.tokens("impression")
MATCHED = STUDIES + f""",
mk AS (SELECT id, split, source, findings, {K.alnum('findings')} AS ka, {K.alnum('impression')} AS kb, list_distinct({_TA}) AS ta, list_distinct({_TB}) AS tb FROM studies),
mn AS (SELECT *, len(list_intersect(ta, tb)) AS i, len(ta) + len(tb) - len(list_intersect(ta, tb)) AS u FROM mk),
mj AS (SELECT *, CASE WHEN u = 0 THEN 1.0 ELSE i / u END AS jaccard FROM mn),
matched AS (SELECT id, split, source, jaccard, CASE WHEN findings = '' THEN 'NO_SOURCE' WHEN ka = kb THEN 'EXACT' WHEN ka <> '' AND contains(kb, ka) THEN 'SUBSET'
  WHEN jaccard >= 0.9 THEN 'NEAR' WHEN jaccard >= 0.5 THEN 'PARTIAL' ELSE 'MISMATCH' END AS status FROM mj)"""


@query("a2_status_summary", f"""
WITH {MATCHED}, r AS (SELECT CASE WHEN grouping(split) = 1 THEN 'TOTAL' ELSE split END AS split,
  CASE WHEN grouping(status) = 1 THEN 'TOTAL' ELSE status END AS status, {N} AS n FROM matched GROUP BY ROLLUP (split, status))
SELECT split, status, n, round(n * 100.0 / max(CASE WHEN status = 'TOTAL' THEN n END) OVER (PARTITION BY split), 6) AS pct FROM r""")
def _(spark, sf):
    return r6(A.status_summary(_matched(spark, sf), "split"), "pct")


@query("a2_match_rate", f"""
WITH {MATCHED} SELECT split, {N} AS n, CAST(count(*) FILTER (status IN ('EXACT', 'SUBSET')) AS BIGINT) AS n_match,
  round(avg(CASE WHEN status IN ('EXACT', 'SUBSET') THEN 1.0 ELSE 0.0 END), 6) AS match_rate FROM matched GROUP BY split""")
def _(spark, sf):
    return r6(A.match_rate(_matched(spark, sf), "split", ["EXACT", "SUBSET"]), "match_rate")


@query("a3_tally", f"""
WITH {CAPTIONS}, f AS (SELECT 'frontal' AS flag, {_flag(_FRONT)} AS v FROM captions UNION ALL SELECT 'lateral', {_flag(_SIDE)} FROM captions)
SELECT flag, CAST(count(*) FILTER (v = 'yes') AS BIGINT) AS present, CAST(count(*) FILTER (v = 'no') AS BIGINT) AS absent,
  CAST(count(*) FILTER (v = 'unknown') AS BIGINT) AS unknown, {N} AS n, round(count(*) FILTER (v = 'yes') * 100.0 / count(*), 6) AS present_pct,
  round(count(*) FILTER (v = 'no') * 100.0 / count(*), 6) AS absent_pct, round(count(*) FILTER (v = 'unknown') * 100.0 / count(*), 6) AS unknown_pct FROM f GROUP BY flag""")
def _(spark, sf):
    flags = _captions(spark, sf).select(caption_views(F.col("c")).alias("v")).select("v.*")
    return r6(A.tally(flags, ["frontal", "lateral"]), "present_pct", "absent_pct", "unknown_pct")


_COMBO = f"""
flags AS (SELECT s.id, s.label_str, {_flag(_FRONT)} AS fr, {_flag(_SIDE)} AS la, s.findings <> '' AS hf, s.impression <> '' AS hi, len(s.image_path) AS files
  FROM imaged s JOIN captions c ON c.id = s.id)"""
_STATE = "CASE WHEN {a} THEN 'undetermined' WHEN {b} AND {c} THEN 'both' WHEN {b} THEN 'only_a' WHEN {c} THEN 'only_b' ELSE 'neither' END"


@query("a4_combination_counts", f"""
WITH {IMAGED}, {CAPTIONS[len(STUDIES) + 1:]}, {_COMBO}
SELECT 'views' AS kind, {_STATE.format(a="fr = 'unknown' OR la = 'unknown'", b="fr = 'yes'", c="la = 'yes'")} AS value, {N} AS n FROM flags GROUP BY ALL
UNION ALL SELECT 'sections', {_STATE.format(a="false", b="hf", c="hi")}, {N} FROM flags GROUP BY ALL
UNION ALL SELECT 'complete', CASE WHEN fr = 'yes' AND la = 'yes' AND hf AND hi THEN 'yes' ELSE 'no' END, {N} FROM flags GROUP BY ALL
UNION ALL SELECT 'files', CAST(files AS VARCHAR), {N} FROM flags GROUP BY ALL""")
def _(spark, sf):
    s = imaged(spark, sf).select("id", (F.col("findings") != "").alias("hf"), (F.col("impression") != "").alias("hi"), F.size("image_path").alias("files"))
    v = _captions(spark, sf).select("id", caption_views(F.col("c")).alias("v")).select("id", "v.*")
    return A.combination_counts(s.join(v, "id"), ("frontal", "lateral"), ("hf", "hi"), "files")


@query("a4_joint_cube", f"""
WITH {STUDIES} SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, CASE WHEN grouping(label_str) = 1 THEN 'ALL' ELSE label_str END AS label_str, {N} AS n
FROM studies GROUP BY CUBE (lang, label_str)""")
def _(spark, sf):
    return A.joint_cube(studies(spark, sf).select("lang", "label_str"), "lang", "label_str")


@query("a5_selection_audit", f"""
WITH {IMAGED}, m AS (SELECT *, label_str <> 'Unlabeled' AS u, impression <> '' AND len(image_path) >= 2 AS rule,
  CASE WHEN NOT {K.filled('impression')} THEN 'no_findings' WHEN len(image_path) < 2 THEN 'too_few_files' ELSE 'unexplained' END AS reason FROM imaged)
SELECT 'share' AS kind, 'english' AS name, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) FILTER (u), 6) AS included, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) FILTER (NOT u), 6) AS excluded FROM m
UNION ALL SELECT 'share', 'two_files', round(avg(CASE WHEN len(image_path) >= 2 THEN 1.0 ELSE 0.0 END) FILTER (u), 6), round(avg(CASE WHEN len(image_path) >= 2 THEN 1.0 ELSE 0.0 END) FILTER (NOT u), 6) FROM m
UNION ALL SELECT 'size', 'rows', count(*) FILTER (u), count(*) FILTER (NOT u) FROM m
UNION ALL SELECT 'rule', 'size', count(*) FILTER (rule), NULL FROM m
UNION ALL SELECT 'rule', 'false_positive', NULL, count(*) FILTER (rule AND NOT u) FROM m
UNION ALL SELECT 'rule', 'false_negative', count(*) FILTER (u AND NOT rule), NULL FROM m
UNION ALL SELECT 'rule', 'exact', 0.0, NULL FROM (SELECT 1)
UNION ALL SELECT 'reason', reason, NULL, count(*) FROM m WHERE NOT u GROUP BY reason""")
def _(spark, sf):
    from ..plans.curation import exclusion_reason

    s = imaged(spark, sf)
    used = s.where(F.col("label_str") != "Unlabeled").select("id")
    n = F.size("image_path")
    out = A.selection_audit(
        s, used, "id", {"english": F.col("lang") == "en", "two_files": n >= 2},
        (F.col("impression") != "") & (n >= 2), exclusion_reason(F.col("impression"), n),
    )
    return r6(out, "included", "excluded")


@query("a6_status_by_split", f"""
WITH {STUDIES}, s AS (SELECT split, CASE WHEN NOT {K.filled('impression')} THEN 'missing' WHEN label_str = 'Toxic' THEN 'placeholder' ELSE 'recoverable' END AS status FROM studies)
SELECT status, CAST(count(*) FILTER (split = 'train') AS BIGINT) AS train, CAST(count(*) FILTER (split = 'val') AS BIGINT) AS val, CAST(count(*) FILTER (split = 'test') AS BIGINT) AS test
FROM s GROUP BY status""")
def _(spark, sf):
    from ..plans.curation import impression_status

    status = impression_status(F.col("impression"), F.col("label_str") == "Toxic")
    s = studies(spark, sf).select("split", status.alias("status"))
    return A.status_by_split(s, ["missing", "placeholder", "recoverable"], ["train", "val", "test"])


@query("a6_equality_rate", f"""
WITH {STUDIES}, s AS (SELECT split, {K.alnum('findings')} = {K.alnum('report')} AS same FROM studies)
SELECT split, {N} AS n, CAST(count(*) FILTER (same) AS BIGINT) AS n_equal, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS equal_rate FROM s GROUP BY split""")
def _(spark, sf):
    return r6(A.equality_rate(studies(spark, sf), "findings", "report", "split"), "equal_rate")


@query("a7_similarity_stats", f"""
WITH {MATCHED}, m AS (SELECT * FROM matched WHERE status <> 'NO_SOURCE')
SELECT {N} AS n, round(avg(jaccard), 6) AS mean, CAST(count(DISTINCT source) AS BIGINT) AS n_keys,
  round(list_sort(list(jaccard))[CAST(count(*) // 2 + 1 AS BIGINT)], 6) AS median FROM m""")
def _(spark, sf):
    return r6(A.similarity_stats(_matched(spark, sf), "source"), "mean", "median")


@query("a10_mean_with_zeros", f"""
WITH {STUDIES}, s AS (SELECT split, CASE WHEN {K.filled('findings')} AND {K.filled('impression')} THEN length(findings) / length(report) END AS v FROM studies)
SELECT split, {N} AS n, CAST(count(v) AS BIGINT) AS n_scored, round(coalesce(sum(v), 0) / count(*), 6) AS score FROM s GROUP BY split""")
def _(spark, sf):
    s = studies(spark, sf).select("split", "report", "findings", "impression")
    return r6(A.mean_with_zeros(s, F.length("findings") / F.length("report"), "findings", "impression", ["split"]), "score")


@query("a14_percentiles", """
SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.975), 6) AS p975 FROM events GROUP BY event_type""")
def _(spark, sf):
    from ..operators.ordinal import exact_percentiles

    e = table(spark, sf, "events").select("event_type", "value")
    return r6(exact_percentiles(e, ["event_type"], "value", {"p05": 0.05, "p50": 0.5, "p975": 0.975}), "p05", "p50", "p975")


@query("a14_percentiles_by_digits", """
SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.975), 6) AS p975 FROM events GROUP BY event_type""")
def _(spark, sf):
    from ..operators.radix_select import percentiles_by_digits

    e = table(spark, sf, "events").select("event_type", "value")
    return r6(percentiles_by_digits(e, ["event_type"], "value", {"p05": 0.05, "p50": 0.5, "p975": 0.975}), "p05", "p50", "p975")


@query("a15_latency_summary", f"""
SELECT event_type, {N} AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS stdev, round(count(*) / sum(value), 6) AS throughput,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
FROM (SELECT CASE WHEN event_type <> 'error' THEN event_type END AS event_type, value FROM events) GROUP BY event_type""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), "value")
    return r6(A.latency_summary(e, ["event_type"], "value"), "mean", "stdev", "throughput", "p50", "p95", "p99")


@query("a15_load_curve", f"""
WITH b AS (SELECT CAST(l_linenumber AS BIGINT) AS batch_size, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS s, l_tax AS t FROM lineitem)
SELECT batch_size, {N} AS n_batches, CAST(count(*) FILTER (s IS NULL) AS BIGINT) AS n_failed, round(avg(s), 6) AS mean, min(s) AS min, max(s) AS max,
  round(sum(batch_size) FILTER (s IS NOT NULL) / sum(s), 6) AS throughput, round(sum(t) FILTER (s IS NOT NULL) / sum(s), 6) AS tokens_per_s, round(avg(s) / batch_size, 6) AS amortised
FROM b GROUP BY batch_size""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    b = l.select(F.col("l_linenumber").cast("bigint").alias("batch_size"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("seconds"), F.col("l_tax").alias("tokens"))
    return r6(A.load_curve(b), "mean", "throughput", "tokens_per_s", "amortised")


def _long_means(spark, sf, cond):
    return table(spark, sf, "events").where(cond).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))


@query("a18_compare_metrics", """
WITH c AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE user_id > 75 GROUP BY 1), b AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE user_id <= 75 GROUP BY 1)
SELECT metric, round(c.v, 6) AS current, round(b.v, 6) AS baseline, round(c.v - b.v, 6) AS delta, round((c.v - b.v) / nullif(b.v, 0) * 100, 6) AS rel_pct, c.v - b.v > 0 AS beats FROM c JOIN b USING (metric)""")
def _(spark, sf):
    out = A.compare_metrics(_long_means(spark, sf, F.col("user_id") > 75), _long_means(spark, sf, F.col("user_id") <= 75))
    return r6(out, "current", "baseline", "delta", "rel_pct")


@query("a19_format_compliance", f"""
WITH {RUNS} SELECT {N} AS total, CAST(count(*) FILTER (contains(prediction, chr(10))) AS BIGINT) AS compliant,
  CAST(count(*) FILTER (NOT contains(prediction, chr(10))) AS BIGINT) AS missing, round_even(count(*) FILTER (contains(prediction, chr(10))) / count(*), 4) AS ratio FROM current_run""")
def _(spark, sf):
    current, _ = two_runs(spark, sf)
    return A.format_compliance(current, F.contains("prediction", F.lit("\n")), True)[0]


@query("a19_format_breaches", f"WITH {RUNS} SELECT id FROM current_run WHERE NOT contains(prediction, chr(10))")
def _(spark, sf):
    current, _ = two_runs(spark, sf)
    return A.format_compliance(current, F.contains("prediction", F.lit("\n")), True)[1]


@query("a19_reference_violations", f"WITH {RUNS} SELECT 'reference_format' AS rule, CAST(id AS VARCHAR) AS id FROM current_run WHERE NOT contains(reference, chr(10))")
def _(spark, sf):
    current, _ = two_runs(spark, sf)
    return A.reference_violations(current, F.contains("reference", F.lit("\n")), True)


@query("a24_run_summary", f"""
WITH {RUN_TABLE}, ok AS (SELECT CASE WHEN user_id % 11 <> 0 THEN model END AS model, CASE WHEN model <> '8B' THEN hours END AS hours, status <> 'failed' AND best_value IS NOT NULL AS ok,
  CASE WHEN status <> 'failed' THEN best_value END AS best_value, early_stopped, epochs, best_epoch FROM runs)
SELECT model, CAST(count(*) FILTER (ok) AS BIGINT) AS n, round(sum(hours), 6) AS hours_total, round(avg(hours), 6) AS hours_mean, round(min(hours), 6) AS hours_min, round(max(hours), 6) AS hours_max,
  round(avg(best_value), 6) AS value_mean, min(best_value) AS value_min, max(best_value) AS value_max, CAST(count(*) FILTER (ok AND early_stopped) AS BIGINT) AS n_early_stopped,
  CAST(count(*) FILTER (ok AND NOT early_stopped) AS BIGINT) AS n_at_limit, CAST(count(*) FILTER (ok AND epochs <> 0 AND epochs - best_epoch < 1.5) AS BIGINT) AS n_still_improving,
  round(quantile_cont(hours, 0.5), 6) AS hours_median, round(quantile_cont(best_value, 0.5), 6) AS value_median FROM ok GROUP BY model""")
def _(spark, sf):
    # Runs without a model are a group of their own, and no run of one model tells its hours.
    known = runs(spark, sf).withColumn("hours", F.when(F.col("model") != "8B", F.col("hours"))).withColumn("model", F.when(F.col("user_id") % 11 != 0, F.col("model")))
    out = R.run_summary(known)
    return r6(out, "hours_total", "hours_mean", "hours_min", "hours_max", "value_mean", "hours_median", "value_median")


@query("a24_metric_pivot", f"""
WITH {RUN_TABLE}, ok AS (SELECT * FROM runs WHERE status <> 'failed')
SELECT model, round(avg(best_value) FILTER (dataset = 'F-F'), 6) AS "F-F", round(avg(best_value) FILTER (dataset = 'FL-F'), 6) AS "FL-F",
  round(avg(best_value) FILTER (dataset = 'F-FI'), 6) AS "F-FI", round(avg(best_value) FILTER (dataset = 'FL-FI'), 6) AS "FL-FI" FROM ok GROUP BY model""")
def _(spark, sf):
    names = ["F-F", "FL-F", "F-FI", "FL-FI"]
    return r6(R.metric_pivot(runs(spark, sf), "model", "dataset", names), *names)


@query("a25_acceptance_rules", f"""
WITH {RUN_TABLE}, b AS (SELECT experiment, n, model, dataset, user_id % 4 AS q, best_value / 1000 AS rouge FROM runs)
SELECT experiment, 'example_count' AS warning FROM b WHERE n <> 70
UNION ALL SELECT experiment, 'score_near_zero' FROM b WHERE rouge < 0.02
UNION ALL SELECT experiment, 'separator_ratio' FROM b WHERE dataset LIKE '%FI' AND q < 2
UNION ALL SELECT experiment, 'untracked' FROM b WHERE q = 3
UNION ALL SELECT experiment, 'model_mismatch' FROM b WHERE q = 1""")
def _(spark, sf):
    q = F.col("user_id") % 4
    b = runs(spark, sf).select(
        "experiment", "n", (F.col("best_value") / 1000).alias("rouge_l"),
        F.when(F.col("dataset").endswith("FI"), "findings_impression").otherwise("findings").alias("target"),
        F.when(q != 0, q / 4.0).alias("sep_ratio"), F.when(q != 3, F.col("experiment")).alias("tracking_id"),
        F.concat(F.lit("Model-"), "model").alias("model_folder"),
        F.when(q == 1, "other").otherwise(F.concat(F.lit("org/MODEL"), "model", F.lit("-chat"))).alias("model_loaded"),
    )
    return R.acceptance_rules(b, 70)


@query("a26_epoch_mean", f"""
WITH {CURVES} SELECT run, metric, greatest(1, CAST(ceil(step / 4.0) AS BIGINT)) AS epoch, round(avg(value), 6) AS mean_loss FROM curves GROUP BY ALL""")
def _(spark, sf):
    c = curves(spark, sf).select("run", "metric", (F.col("step") / 4.0).alias("epoch"), F.col("value").alias("loss"))
    return r6(A.epoch_mean(c, ["run", "metric"]), "mean_loss")


@query("a26_attached_loss", f"""
WITH {CURVES}, t AS (SELECT run, greatest(1, CAST(ceil(step / 4.0) AS BIGINT)) AS bucket, avg(value) AS m FROM curves WHERE metric = 'click' GROUP BY ALL)
SELECT v.run, v.step, round(v.value, 6) AS val_loss, round(t.m, 6) AS mean_loss FROM curves v LEFT JOIN t ON t.run = v.run AND t.bucket = greatest(1, CAST(ceil(v.step / 4.0) AS BIGINT)) WHERE v.metric = 'view'""")
def _(spark, sf):
    c = curves(spark, sf).withColumn("epoch", F.col("step") / 4.0)
    train = c.where(F.col("metric") == "click").select("run", "epoch", F.col("value").alias("loss"))
    evals = c.where(F.col("metric") == "view").select("run", "step", "epoch", F.col("value").alias("val_loss"))
    return r6(R.curve_with_train_loss(evals, train, ["run"]).select("run", "step", "val_loss", "mean_loss"), "val_loss", "mean_loss")


@query("a27_varying_keys", """
WITH e AS (SELECT conv_id AS run, role || turn AS k, CAST(CASE WHEN role = 'system' THEN 1 ELSE length(text) END AS VARCHAR) AS v FROM conversations),
n AS (SELECT count(DISTINCT conv_id) AS total FROM conversations),
g AS (SELECT k, count(*) AS c, count(DISTINCT v) AS d FROM e GROUP BY k)
SELECT k AS key, CAST(c AS BIGINT) AS n_set, CASE k WHEN 'user0' THEN 1 ELSE 2 END AS position FROM g, n WHERE d > 1 OR c < total
UNION ALL SELECT 'lang', CAST(count(*) AS BIGINT), 2 FROM (SELECT DISTINCT conv_id FROM conversations) WHERE false GROUP BY ALL HAVING count(*) > 0""")
def _(spark, sf):
    from ..operators.selection import varying_keys

    c = table(spark, sf, "conversations")
    value = F.when(F.col("role") == "system", 1).otherwise(F.length("text")).cast("string")
    key = F.concat("role", F.col("turn").cast("string"))
    turns = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("config"))  # the turns of a conversation
    fixed = F.map_concat("config", F.create_map(F.lit("lang"), F.lit("x")))
    return varying_keys(turns.withColumn("config", fixed), "config", "conv_id", ("user0",))


@query("a28_rare_label_weights", f"""
WITH {STUDIES}, x AS (SELECT id, unnest(labels) AS label FROM studies), c AS (SELECT label, count(*) AS n, 1 / sqrt(count(*)) AS raw FROM x GROUP BY label HAVING label IN ('LowQuality', 'Toxic')),
w AS (SELECT label, least(1.02, raw / (SELECT quantile_cont(raw, 0.5) FROM c)) AS w FROM c)
SELECT s.id, round(coalesce(max(w.w), 1.0), 6) AS weight FROM x s LEFT JOIN w ON w.label = s.label GROUP BY s.id""")
def _(spark, sf):
    s = studies(spark, sf).select("id", "labels")
    w = A.label_weights(s, "labels", ("LowQuality", "Toxic"), 1.02)
    return r6(A.record_weights(s, "labels", w, ("LowQuality", "Toxic")).select("id", "weight"), "weight")


@query("a29_label_frequencies", f"""
WITH {STUDIES} SELECT split, label, {N} AS n FROM (SELECT split, unnest(labels) AS label FROM studies) GROUP BY ALL""")
def _(spark, sf):
    return A.label_frequencies(studies(spark, sf), "labels", ["split"])


_LEN = f"len({K.words(K.squash('text'))})"


@query("a30_length_profile", f"""
WITH s AS (SELECT CASE WHEN lang <> 'es' THEN lang END AS lang, {_LEN} AS n FROM documents)
SELECT lang, {N} AS n, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, CAST(count(*) FILTER (n > 300) AS BIGINT) AS n_over,
  CAST(floor(round(quantile_cont(n, 0.5), 9)) AS BIGINT) AS median, CAST(floor(round(quantile_cont(n, 0.9), 9)) AS BIGINT) AS p90,
  CAST(floor(round(quantile_cont(n, 0.95), 9)) AS BIGINT) AS p95, CAST(floor(round(quantile_cont(n, 0.99), 9)) AS BIGINT) AS p99 FROM s GROUP BY lang""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("text", F.when(F.col("lang") != "es", F.col("lang")).alias("lang"))
    return r6(A.length_profile(d, "text", 300, ["lang"]), "mean")


@query("a30_over_limit", f"SELECT doc_id FROM documents WHERE {_LEN} > 300")
def _(spark, sf):
    return A.over_limit(table(spark, sf, "documents"), "text", 300, "doc_id")


@query("a31_weighted_mean", f"""
SELECT event_type, {N} AS n, CAST(count(*) FILTER (user_id = 0) AS BIGINT) AS n_zero, round(sum(value * user_id) / nullif(sum(user_id), 0), 6) AS mean FROM events GROUP BY event_type""")
def _(spark, sf):
    return r6(A.weighted_mean(table(spark, sf, "events"), "value", "user_id", ["event_type"]), "mean")


@query("a32_translation_qc", f"""
WITH {STUDIES}, c AS (SELECT 'findings' AS "column", findings AS s, CASE WHEN lang = 'en' THEN '' ELSE 'x' END AS o FROM studies UNION ALL SELECT 'impression', impression, CASE WHEN lang = 'fr' THEN ' ' ELSE 'x' END FROM studies)
SELECT "column", CAST(count(*) FILTER ({K.filled('s')}) AS BIGINT) AS n_source, CAST(count(*) FILTER ({K.filled('o')}) AS BIGINT) AS n_output,
  CAST(count(*) FILTER ({K.filled('s')} AND NOT {K.filled('o')}) AS BIGINT) AS n_missing, CAST(count(*) FILTER ({K.filled('s')} AND {K.filled('o')}) AS BIGINT) AS n_both,
  round(avg(length(s)) FILTER ({K.filled('s')}), 6) AS mean_len, min(length(s)) FILTER ({K.filled('s')}) AS min_len, max(length(s)) FILTER ({K.filled('s')}) AS max_len FROM c GROUP BY "column" """)
def _(spark, sf):
    s = studies(spark, sf).select(
        "findings", "impression", F.when(F.col("lang") == "en", "").otherwise("x").alias("findings_it"), F.when(F.col("lang") == "fr", " ").otherwise("x").alias("impression_it")
    )
    return r6(A.translation_qc(s, {"findings": "findings_it", "impression": "impression_it"}), "mean_len")


@query("w9_upper_totals", f"""
WITH {STUDIES}, g AS (SELECT split, label_str, {N} AS n FROM studies GROUP BY ALL) SELECT split, label_str, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share FROM g""")
def _(spark, sf):
    return r6(A.group_share(studies(spark, sf), "split", "label_str"), "share")


