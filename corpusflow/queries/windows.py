"""Ordered operators, top-k, set operations and reshaping over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators import selection as S
from ..operators import windows as W
from ..operators.frequent import top_values
from . import sqlkit as K
from .fixtures import CURVES, RUN_METRICS, RUN_TABLE, STUDIES, curves, joined, r6, run_metrics, runs, studies, table
from .registry import query

_FILES = """
f AS (SELECT doc_id, source AS study, CASE lang WHEN 'en' THEN 'frontal' ELSE 'lateral' END AS view,
  CASE WHEN lang = 'fr' THEN 'scan_' || doc_id ELSE CAST(doc_id AS VARCHAR) END || '.png' AS file FROM documents),
named AS (SELECT *, row_number() OVER (PARTITION BY study, view ORDER BY try_cast(replace(file, '.png', '') AS BIGINT) IS NULL,
  coalesce(try_cast(replace(file, '.png', '') AS BIGINT), 0), file) AS rn FROM f)"""


def _files(spark, sf):
    fr = F.col("lang") == "fr"
    stem = F.when(fr, F.concat(F.lit("scan_"), "doc_id")).otherwise(F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("study"), F.when(F.col("lang") == "en", "frontal").otherwise("lateral").alias("view"),
        F.concat(stem, F.lit(".png")).alias("file"),
    )


@query("w1_number_within", f"""
WITH {_FILES} SELECT doc_id, study, file, view || CASE WHEN rn = 1 THEN '' ELSE '_' || rn END || '.png' AS new_name FROM named""")
def _(spark, sf):
    return W.new_names(_files(spark, sf), "study", "view", "file").select("doc_id", "study", "file", "new_name")


@query("w1_apply_renames", f"""
WITH {_FILES} SELECT doc_id, 'img/' || study || '/' || view || CASE WHEN rn = 1 THEN '' ELSE '_' || rn END || '.png|img/' || study || '/other.png' AS renamed,
  'img/' || study || '/' || file || '|img/' || study || '/other.png' AS restored FROM named""")
def _(spark, sf):
    n = W.new_names(_files(spark, sf), "study", "view", "file")
    names = F.create_map("file", "new_name")
    paths = F.array(F.concat(F.lit("img/"), "study", F.lit("/"), "file"), F.concat(F.lit("img/"), "study", F.lit("/other.png")))
    new = W.apply_renames(paths, names)
    return n.select("doc_id", joined(new).alias("renamed"), joined(W.apply_renames(new, W.reverse_map(names))).alias("restored"))


@query("w2_early_stop_fold", f"""
WITH RECURSIVE {CURVES}, e AS (SELECT run || ':' || metric AS run, step, CASE WHEN value < 1 OR event_id % 11 = 3 THEN NULL ELSE value END AS v FROM curves),
fold AS (
  SELECT run, step, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS since, v AS best, CASE WHEN v IS NULL THEN NULL ELSE step END AS best_step, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS n_improved FROM e WHERE step = 1
  UNION ALL
  SELECT e.run, e.step, CASE WHEN e.v IS NOT NULL AND (f.best IS NULL OR e.v - f.best > 0.5) THEN 0 ELSE f.since + 1 END,
    CASE WHEN e.v IS NOT NULL AND (f.best IS NULL OR e.v - f.best > 0.5) THEN e.v ELSE f.best END,
    CASE WHEN e.v IS NOT NULL AND (f.best IS NULL OR e.v - f.best > 0.5) THEN e.step ELSE f.best_step END,
    CASE WHEN e.v IS NOT NULL AND (f.best IS NULL OR e.v - f.best > 0.5) THEN f.n_improved + 1 ELSE f.n_improved END
  FROM fold f JOIN e ON e.run = f.run AND e.step = f.step + 1 WHERE f.since < 4),
last AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM fold)
SELECT l.run, (SELECT count(*) FROM e WHERE e.run = l.run) AS n_evals, l.best_step, round(l.best, 6) AS best_value, CAST(l.n_improved AS BIGINT) AS n_improved,
  CAST(l.since AS BIGINT) AS since_improved, l.since >= 4 AS stopped, CASE WHEN l.since >= 4 THEN l.step END AS stop_step FROM last l WHERE rn = 1""")
def _(spark, sf):
    value = F.when(F.col("event_id") % 11 == 3, F.lit(float("nan"))).when(F.col("value") >= 1, F.col("value"))
    c = curves(spark, sf).select(F.concat_ws(":", "run", "metric").alias("run"), "step", value.alias("value"))
    return r6(W.early_stop_fold(c, "run", "step", "value", "max", 0.5, 4), "best_value")


@query("w3_best_step", f"""
WITH {CURVES}, r AS (SELECT *, row_number() OVER (PARTITION BY run, metric ORDER BY value DESC, step) AS rn FROM curves)
SELECT run, metric, step AS best_step, value AS best_value FROM r WHERE rn = 1""")
def _(spark, sf):
    return W.best_step(curves(spark, sf), ["run", "metric"], "step", "value")


@query("w3_best_agreement", f"""
WITH {CURVES}, p AS (SELECT a.run, a.step, a.value AS o, b.value AS s FROM curves a LEFT JOIN curves b ON b.run = a.run AND b.step = a.step AND b.metric = 'view' WHERE a.metric = 'click'),
x AS (SELECT run, step, o, row_number() OVER (PARTITION BY run ORDER BY o DESC, step) AS rn FROM p), y AS (SELECT run, step, s, row_number() OVER (PARTITION BY run ORDER BY s DESC, step) AS rn FROM p WHERE s IS NOT NULL)
SELECT x.run, x.step AS step_overall, x.o AS value_overall, y.step AS step_subgroup, y.s AS value_subgroup, x.step = y.step AS agree FROM x JOIN y ON y.run = x.run AND y.rn = 1 WHERE x.rn = 1""")
def _(spark, sf):
    c = curves(spark, sf).where(F.col("metric").isin("click", "view"))
    p = c.groupBy("run", "step").agg(
        F.max(F.when(F.col("metric") == "click", F.col("value"))).alias("o"), F.max(F.when(F.col("metric") == "view", F.col("value"))).alias("s")
    ).where(F.col("o").isNotNull())
    return W.best_agreement(p, "run", "step", "o", "s")


@query("w4_last_point", f"""
WITH {CURVES}, r AS (SELECT *, row_number() OVER (PARTITION BY run, metric ORDER BY step) AS a, row_number() OVER (PARTITION BY run, metric ORDER BY step DESC) AS b FROM curves)
SELECT run, metric, CAST(count(*) AS BIGINT) AS n, max(CASE WHEN a = 1 THEN value END) AS first_value, max(CASE WHEN b = 1 THEN value END) AS last_value, max(step) AS last_step FROM r GROUP BY run, metric""")
def _(spark, sf):
    return W.last_point(curves(spark, sf), ["run", "metric"], ["step"], "value")


@query("w5_per_item_latency", """
WITH m AS (SELECT o_custkey AS run, o_orderkey AS ord, sum(CASE WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS done,
  o_totalprice / 1000000 + o_orderkey AS t FROM orders),
g AS (SELECT run, ord, done - lag(done, 1, 0) OVER (PARTITION BY run ORDER BY ord) AS d, t - lag(t, 1, 0) OVER (PARTITION BY run ORDER BY ord) AS dt FROM m)
SELECT run, ord, unnest(range(1, CAST(d AS BIGINT) + 1)) AS item, round(dt / greatest(d, 1), 6) AS latency FROM g WHERE d >= 1""")
def _(spark, sf):
    from ..operators.ordinal import join_groups, with_running_total

    # The orders of a customer stand for the progress marks of a run.
    o = table(spark, sf, "orders")
    step = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    slim = o.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("ord"), step.alias("step"), (F.col("o_totalprice") / 1000000 + F.col("o_orderkey")).alias("t"))
    placed = with_running_total(slim, ["run", "ord"], "step")
    marks = join_groups(placed, placed.groupBy("run").agg(F.min("lo").alias("start")), ["run"])
    marks = marks.select("run", "ord", (F.col("lo") + F.col("step") - F.col("start")).alias("done"), "t")
    return r6(W.per_item_latency(marks, ["run"], "ord", "done", "t"), "latency")


@query("w6_examples_per_status", f"""
WITH {STUDIES}, r AS (SELECT label_str AS status, id, row_number() OVER (PARTITION BY label_str ORDER BY id) AS rn FROM studies) SELECT status, id, rn FROM r WHERE rn <= 5""")
def _(spark, sf):
    s = studies(spark, sf).select(F.col("label_str").alias("status"), "id")
    return W.examples_per_status(s, "status", ["id"], 5)


_PANEL = f"""
WITH {STUDIES}, hit AS (SELECT min(id) AS f FROM studies WHERE label_str <> 'No Finding' AND regexp_matches(report, '(?i)tion')),
sick AS (SELECT id, list_sort([l for l in labels if l NOT IN ('No Finding', 'Unlabeled')])[1] AS category FROM studies),
r AS (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY id) AS round, count(*) OVER (PARTITION BY category) AS size FROM sick WHERE category IS NOT NULL),
d AS (SELECT coalesce(min(round), 2147483647) AS dead FROM (SELECT round, count(*) FILTER (id <> (SELECT f FROM hit)) AS n FROM r GROUP BY round) WHERE n = 0),
p AS (SELECT * FROM r WHERE id <> (SELECT f FROM hit) AND round < (SELECT dead FROM d)),
c AS (SELECT '' AS category, 0 AS round, f AS id, 0 AS size FROM hit UNION ALL SELECT category, round, id, size FROM p)
SELECT 'healthy' AS kind, '' AS category, 0 AS round, id FROM (SELECT id FROM studies WHERE label_str = 'No Finding' ORDER BY id LIMIT 6)
UNION ALL SELECT 'pathological', category, round, id FROM (SELECT * FROM c ORDER BY round, size DESC, category LIMIT 9)"""


@query("w7_round_robin_panel", _PANEL)
def _(spark, sf):
    return W.round_robin_panel(studies(spark, sf), "id", "labels", F.col("report"), "tion", 6, 9)


@query("w8_run_index", f"""
WITH {RUN_TABLE}, a AS (SELECT experiment, started_at, false AS live FROM runs WHERE status <> 'failed'),
u AS (SELECT * FROM a UNION ALL SELECT experiment, started_at, true FROM runs WHERE mode = 'lora' AND experiment NOT IN (SELECT experiment FROM a))
SELECT experiment, CAST(row_number() OVER (ORDER BY live, started_at, experiment) AS BIGINT) AS run_idx FROM u""")
def _(spark, sf):
    r = runs(spark, sf).select("experiment", "started_at", "status", "mode")
    archive = r.where(F.col("status") != "failed").drop("status", "mode")
    live = r.where(F.col("mode") == "lora").drop("status", "mode")
    return W.run_index(archive, live, "experiment", "started_at").select("experiment", "run_idx")


@query("o1_top_k", f"""
SELECT w AS value, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({K.tokens('text')}) AS w FROM documents) GROUP BY w ORDER BY n DESC, value LIMIT 25""")
def _(spark, sf):
    from ..functions.text import key_tokens

    words = table(spark, sf, "documents").select(F.explode(key_tokens(F.col("text"))).alias("value"))
    return S.top_k(words.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "value", "n", 25)


@query("o1_top_values", f"""
SELECT w AS value, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({K.tokens('text')}) AS w FROM documents) GROUP BY w ORDER BY n DESC, value LIMIT 40""")
def _(spark, sf):
    from ..functions.text import key_tokens

    return top_values(table(spark, sf, "documents").select(F.explode(key_tokens(F.col("text"))).alias("value")), "value", 40)


@query("o2_leaderboard", f"""
WITH {RUN_TABLE} SELECT experiment, best_value, round(hours, 6) AS hours, round(best_value / nullif(hours, 0), 6) AS ratio_to_baseline FROM runs ORDER BY best_value DESC NULLS LAST, experiment""")
def _(spark, sf):
    rows = runs(spark, sf).select("experiment", "best_value", "hours")
    return r6(S.leaderboard(rows, "experiment", "best_value", "hours"), "hours", "ratio_to_baseline")


@query("o3_experiment_order", f"""
WITH {RUN_TABLE}, n AS (SELECT 'en_' || CASE WHEN user_id % 11 = 0 THEN 'big' ELSE model END || '_' || mode || '_' || dataset || CASE WHEN user_id % 5 = 0 THEN '' ELSE '_' || user_id END AS name FROM runs)
SELECT DISTINCT name, CAST(coalesce(list_position(['2B', '8B', '32B'], split_part(name, '_', 2)) - 1, 99) AS BIGINT) AS model_rank,
  CAST(coalesce(list_position(['lora', 'qlora'], split_part(name, '_', 3)) - 1, 99) AS BIGINT) AS mode_rank,
  CAST(coalesce(list_position(['F-F', 'FL-F', 'F-FI', 'FL-FI'], split_part(name, '_', 4)) - 1, 99) AS BIGINT) AS data_rank FROM n""")
def _(spark, sf):
    u = F.col("user_id")
    tail = F.when(u % 5 == 0, "").otherwise(F.concat(F.lit("_"), u))
    name = F.concat(F.lit("en_"), F.when(u % 11 == 0, "big").otherwise(F.col("model")), F.lit("_"), "mode", F.lit("_"), "dataset", tail)
    keys = S.experiment_order(F.col("name"))
    ranks = dict(zip(("model_rank", "mode_rank", "data_rank"), keys))
    return runs(spark, sf).select(name.alias("name")).distinct().withColumns(ranks).orderBy(*keys)


@query("o4_numeric_stem_order", f"""
WITH {_FILES} SELECT doc_id, file, coalesce(try_cast(replace(file, '.png', '') AS BIGINT), 0) AS stem FROM f""")
def _(spark, sf):
    stem = S.numeric_stem(F.col("file"))
    return _files(spark, sf).select("doc_id", "file", stem.alias("stem")).orderBy("stem", "file")


@query("o5_limit_records", "SELECT doc_id, lang FROM documents ORDER BY source, doc_id LIMIT 50")
def _(spark, sf):
    return S.limit_records(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["source", "doc_id"], 50).drop("source")


@query("o6_seeded_sample", f"SELECT doc_id FROM documents ORDER BY {K.draw(42, 'doc_id')}, doc_id LIMIT 60")
def _(spark, sf):
    return S.seeded_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 60, 42)


# One pathological case after the other, by a list of those taken: seven with several labels, as far as there are, and single ones.
@query("o7_greedy_cover", f"""
WITH RECURSIVE {STUDIES}, base AS (SELECT CAST(id AS VARCHAR) AS id, labels, list_sort(list_distinct([l for l in labels if l NOT IN ('No Finding', 'Other', 'Unlabeled', 'Support Devices')])) AS path FROM studies),
well AS (SELECT id FROM base WHERE labels = ['No Finding'] ORDER BY {K.draw('42', 'id')}, id LIMIT 10),
sick AS (SELECT id, path, CASE WHEN len(path) > 1 THEN 'multi' ELSE 'single' END AS kind, {K.draw('42', 'id')} AS tie FROM base WHERE len(path) > 0),
freq AS (SELECT kind, label, count(*) AS n FROM (SELECT kind, unnest(path) AS label FROM sick) GROUP BY ALL),
c AS (SELECT count(*) FILTER (kind = 'single') AS s, count(*) FILTER (kind = 'multi') AS m FROM sick), w AS (SELECT least(s, 18 - least(m, 7)) AS s, m FROM c),
want AS (SELECT 'single' AS kind, s AS n FROM w UNION ALL SELECT 'multi', least(m, 18 - s) FROM w),
rare AS (SELECT s.id, s.kind, s.tie, s.path, list(f.label ORDER BY f.label) AS ls, list(1.0::DOUBLE / sqrt(f.n) ORDER BY f.label) AS rs
  FROM (SELECT *, unnest(path) AS label FROM sick) s JOIN freq f ON f.kind = s.kind AND f.label = s.label GROUP BY ALL),
picks AS (SELECT kind, 0 AS step, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS used, n FROM want
  UNION ALL SELECT kind, step + 1, list_append(ids, best.id), list_concat(used, best.path), n FROM (
    SELECT p.kind, p.step, p.ids, p.used, p.n, max({{'gain': list_sum([r.rs[i] / (len(list_filter(p.used, lambda u : u = r.ls[i])) + 1) for i in range(1, len(r.ls) + 1)]), 'tie': r.tie, 'id': r.id, 'path': r.path}}) AS best
    FROM picks p JOIN rare r ON r.kind = p.kind AND NOT list_contains(p.ids, r.id) WHERE p.step < p.n GROUP BY ALL))
SELECT id, 'healthy' AS kind FROM well UNION ALL SELECT unnest(ids), kind FROM picks WHERE step = n""")
def _(spark, sf):
    return S.select_probe(studies(spark, sf), "id", "labels", 10, 18, 42)


_POINTS = f"""
WITH {CURVES}, c AS (SELECT run, step, max(CASE WHEN metric = 'click' THEN value END) AS loss, max(CASE WHEN metric = 'view' THEN value END) AS learning_rate,
  max(CASE WHEN metric = 'purchase' THEN value END) AS val_loss, max(CASE WHEN metric = 'error' THEN value END) AS err, max(CASE WHEN metric = 'signup' THEN value END) AS up FROM curves GROUP BY run, step)"""


def _curve_sides(spark, sf):
    c = curves(spark, sf)

    def of(metric):
        return F.max(F.when(F.col("metric") == metric, F.col("value")))

    wide = c.groupBy("run", "step").agg(
        of("click").alias("loss"), of("view").alias("learning_rate"), of("purchase").alias("val_loss"), of("error").alias("err"), of("signup").alias("up")
    ).withColumns({"epoch": F.col("step") / 4.0, "elapsed_s": F.lit(None).cast("double")})
    train = wide.select("run", "step", "epoch", "elapsed_s", "loss", "learning_rate")
    metrics = F.create_map(F.lit("rouge"), F.col("err"), F.lit("num_examples"), F.lit(5.0))
    section = F.create_map(F.lit("rouge"), F.col("up"))
    return train, wide.select("run", "step", "epoch", "elapsed_s", "val_loss", metrics.alias("metrics"), section.alias("findings"))


@query("u1_union_long", f"""{_POINTS}
SELECT 'train' AS curve, run, step, 'loss' AS metric, loss AS value FROM c WHERE loss IS NOT NULL UNION ALL SELECT 'train', run, step, 'learning_rate', learning_rate FROM c WHERE learning_rate IS NOT NULL
UNION ALL SELECT 'validation', run, step, 'val_loss', val_loss FROM c WHERE val_loss IS NOT NULL UNION ALL SELECT 'validation', run, step, 'rouge', err FROM c WHERE err IS NOT NULL
UNION ALL SELECT 'validation', run, step, 'findings.rouge', up FROM c WHERE up IS NOT NULL""")
def _(spark, sf):
    train, validation = _curve_sides(spark, sf)
    return R.curve_points(train, validation, ["run"], ["findings"]).select("curve", "run", "step", "metric", "value")


@query("u2_unpivot_metrics", f"""
WITH {RUN_TABLE} SELECT experiment, 'best.best_value' AS metric, best_value AS value FROM runs UNION ALL SELECT experiment, 'best.epochs', epochs FROM runs""")
def _(spark, sf):
    r = runs(spark, sf).select("experiment", F.struct("best_value", "epochs", "status", F.col("n").alias("num_examples")).alias("best"))
    return S.unpivot_metrics(r, ["experiment"], "best", "best.")


@query("u2_missing_metrics", f"""
WITH {RUN_METRICS}, k AS (SELECT DISTINCT metric FROM run_metrics UNION SELECT 'findings.bleu')
SELECT metric FROM k EXCEPT SELECT metric FROM run_metrics WHERE metric <> 'click'""")
def _(spark, sf):
    m = run_metrics(spark, sf).select("metric")
    wanted = m.unionByName(spark.createDataFrame([("findings.bleu",)], "metric string"))
    return S.missing_metrics(wanted, m.where(F.col("metric") != "click"))


_IDS = "a AS (SELECT doc_id AS id FROM documents WHERE lang <> 'es'), b AS (SELECT doc_id AS id FROM labels)"


def _id_sides(spark, sf):
    a = table(spark, sf, "documents").where(F.col("lang") != "es").select(F.col("doc_id").alias("id"))
    return a, table(spark, sf, "labels").select(F.col("doc_id").alias("id"))


@query("u3_except_ids", f"WITH {_IDS} SELECT id FROM a EXCEPT SELECT id FROM b")
def _(spark, sf):
    return S.except_ids(*_id_sides(spark, sf))


@query("u3_intersect_ids", f"WITH {_IDS} SELECT id FROM a INTERSECT SELECT id FROM b")
def _(spark, sf):
    return S.intersect_ids(*_id_sides(spark, sf))


@query("u3_symmetric_diff", f"""
WITH {_IDS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON b.id = a.id WHERE a.id IS NULL OR b.id IS NULL""")
def _(spark, sf):
    return S.symmetric_diff(*_id_sides(spark, sf))


@query("u4_dedupe_last", """
WITH r AS (SELECT doc_id, text, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS rn FROM documents) SELECT doc_id, md5(text) AS k, lang FROM r WHERE rn = 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("k"), "lang")
    return S.dedupe_last(d, "k", ["doc_id"])


@query("run_window", f"""
WITH {RUN_TABLE} SELECT model, CAST(count(*) AS BIGINT) AS n, strftime(min(started_at), '%Y-%m-%d %H:%M:%S') AS first_start, strftime(max(finished_at), '%Y-%m-%d %H:%M:%S') AS last_end, round(sum(hours), 6) AS hours FROM runs GROUP BY model""")
def _(spark, sf):
    r = runs(spark, sf).withColumn("wall_clock_s", F.col("hours") * 3600.0)
    show = "yyyy-MM-dd HH:mm:ss"
    w = R.run_window(r, ["model"])
    return r6(w, "hours").withColumns({c: F.date_format(c, show) for c in ("first_start", "last_end")})
