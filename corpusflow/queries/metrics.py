"""Scores, subgroups and significance over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import render_label_target
from ..functions.scalars import float_ratio
from ..functions.table_functions import gram_rows, register_gram_table
from ..functions.text import alnum_key, format_target, sentences
from ..functions.vocabulary import Vocabulary
from ..operators import bootstrap as B
from ..operators import joins as J
from ..operators import metrics as M
from ..plans import evaluation as E
from . import sqlkit as K
from .fixtures import IMAGED, PAIRS, RUNS, STUDIES, VOCAB, joined, pairs, r6, studies, table, two_runs
from .labels import LABEL_OUTPUTS, label_outputs
from .registry import query

BLEU_KEYS = ("bleu", "bleu_1", "bleu_2", "bleu_3", "bleu_4")


def gram_counts(name: str, tokens: str, orders: tuple[int, ...]) -> str:
    """A query counting the n-grams of a token list column per row key, by shifted joins of the positions."""
    shifted = ", ".join(f"lead(w, {i}) OVER (PARTITION BY k ORDER BY i) AS w{i}" for i in range(1, max(orders)))

    def gram(n: int) -> str:
        parts = ["w"] + [f"w{i}" for i in range(1, n)]
        keep = f" WHERE w{n - 1} IS NOT NULL" if n > 1 else ""
        return f"SELECT k, {n} AS n, concat_ws(' ', {', '.join(parts)}) AS g FROM shifted{keep}"

    union = " UNION ALL ".join(gram(n) for n in orders)
    return f"""WITH pos AS (SELECT k, unnest({tokens}) AS w, generate_subscripts({tokens}, 1) AS i FROM {name}_t),
  shifted AS (SELECT k, w, {shifted} FROM pos) SELECT k, n, g, count(*) AS c FROM ({union}) GROUP BY ALL"""


def bleu_rows(source: str, pred: str = "prediction", ref: str = "reference", name: str = "bleu_rows", key: str = "id", norm=K.squash) -> str:
    """CTEs giving per-row n-gram statistics of a pair table."""
    cells = ", ".join(
        f"coalesce(max(CASE WHEN n = {n} THEN m END), 0) AS m{n}, greatest(any_value(lp) - {n - 1}, 0) AS g{n}" for n in range(1, 5)
    )
    return f"""
{name}_t AS (SELECT {key} AS k, {K.words(norm(pred))} AS p, {K.words(norm(ref))} AS r FROM {source}),
{name}_m AS (SELECT a.k, a.n, sum(least(a.c, b.c)) AS m FROM ({gram_counts(name, 'p', (1, 2, 3, 4))}) a JOIN ({gram_counts(name, 'r', (1, 2, 3, 4))}) b
  ON a.k = b.k AND a.n = b.n AND a.g = b.g GROUP BY ALL),
{name} AS (SELECT k, {cells}, any_value(lp) AS lp, any_value(lr) AS lr FROM
  (SELECT t.k, len(t.p) AS lp, len(t.r) AS lr, m.n, m.m FROM {name}_t t LEFT JOIN {name}_m m ON m.k = t.k) GROUP BY k)"""


SUMS = ", ".join([f"sum({p}m{n}) AS {p}m{n}, sum({p}g{n}) AS {p}g{n}" for p in ("",) for n in range(1, 5)] + ["sum(lp) AS lp", "sum(lr) AS lr"])


def bleu_of(order: int, p: str = "") -> str:
    product = " * ".join(f"((CAST({p}m{n} AS DOUBLE) + 1e-15) / (CAST({p}g{n} AS DOUBLE) + 1e-9))" for n in range(1, order + 1))
    length = f"((CAST({p}lp AS DOUBLE) + 1e-15) / (CAST({p}lr AS DOUBLE) + 1e-9))"
    return f"pow({product}, 1.0 / {order}) * CASE WHEN {length} < 1 THEN exp(1 - 1 / {length}) ELSE 1.0 END"


def bleu_cells(p: str = "") -> str:
    return ", ".join(f"round({bleu_of(n, p)}, 6) AS {k}" for k, n in zip(BLEU_KEYS, (4, 1, 2, 3, 4)))


def _current(spark, sf):
    s = studies(spark, sf).select("id", "split", "lang", "labels")
    return two_runs(spark, sf)[0].join(s, "id")


@query("a8_corpus_bleu", f"""
WITH {RUNS}, {bleu_rows('current_run')}, g AS (SELECT s.split, CAST(count(*) AS BIGINT) AS num_examples, {SUMS} FROM bleu_rows b JOIN studies s ON s.id = b.k GROUP BY s.split)
SELECT split, num_examples, {bleu_cells()} FROM g""")
def _(spark, sf):
    return r6(M.score(_current(spark, sf), [M.BLEU], ["split"]), *BLEU_KEYS)


def rouge_rows(source: str, name: str = "rouge_rows", key: str = "id") -> str:
    """CTEs giving per-row unigram and bigram F1."""
    t = f"SELECT {key} AS k, {K.tokens('prediction')} AS p, {K.tokens('reference')} AS r FROM {source}"

    def f1(n: int) -> str:
        total = f"greatest(any_value(lp) - {n - 1}, 0) + greatest(any_value(lr) - {n - 1}, 0)"
        m = f"coalesce(max(CASE WHEN n = {n} THEN m END), 0)"
        return f"CASE WHEN any_value(lp) > 0 AND any_value(lr) > 0 AND {total} > 0 THEN 2.0 * {m} / ({total}) ELSE 0.0 END AS r{n}"

    return f"""
{name}_t AS ({t}),
{name}_m AS (SELECT a.k, a.n, sum(least(a.c, b.c)) AS m FROM ({gram_counts(name, 'p', (1, 2))}) a JOIN ({gram_counts(name, 'r', (1, 2))}) b
  ON a.k = b.k AND a.n = b.n AND a.g = b.g GROUP BY ALL),
{name} AS (SELECT k, {f1(1)}, {f1(2)} FROM (SELECT t.k, len(t.p) AS lp, len(t.r) AS lr, m.n, m.m FROM {name}_t t LEFT JOIN {name}_m m ON m.k = t.k) GROUP BY k)"""


@query("a9_rouge_ngrams", f"""
WITH {RUNS}, {rouge_rows('current_run')}
SELECT s.lang, CAST(count(*) AS BIGINT) AS num_examples, round(avg(r1), 6) AS rouge1, round(avg(r2), 6) AS rouge2 FROM rouge_rows r JOIN studies s ON s.id = r.k GROUP BY s.lang""")
def _(spark, sf):
    return r6(M.score(_current(spark, sf), [M.ROUGE_N], ["lang"]), "rouge1", "rouge2")


# The common subsequence is the longest rising run through the match positions of one text in the other.
ROUGE_L = f"""
lt AS (SELECT id, {K.tokens('prediction')} AS p, {K.tokens('reference')} AS r FROM pairs),
lp AS (SELECT id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM lt), lr AS (SELECT id, unnest(r) AS w, generate_subscripts(r, 1) AS j FROM lt),
ls AS (SELECT lp.id, list([CAST(j AS BIGINT)] ORDER BY i, j DESC) AS s FROM lp JOIN lr ON lr.id = lp.id AND lr.w = lp.w GROUP BY lp.id),
lcs AS (SELECT id, len(list_reduce(s, lambda t, x: list_concat([y for y in t if y < x[1]], x, [y for y in t if y >= x[1]][2:]), CAST([] AS BIGINT[]))) AS c FROM ls),
rouge_l AS (SELECT lt.id, CASE WHEN len(p) > 0 AND len(r) > 0 THEN 2.0 * coalesce(c, 0) / (len(p) + len(r)) ELSE 0.0 END AS rl FROM lt LEFT JOIN lcs ON lcs.id = lt.id)"""


@query("a9_rouge_l_pairs", f"WITH {PAIRS}, {ROUGE_L} SELECT id, round(rl, 6) AS rougeL FROM rouge_l")
def _(spark, sf):
    p = M.with_stats(pairs(spark, sf), [M.ROUGE_L])
    return p.select("id", F.round("rouge_l__rougeL", 6).alias("rougeL"))


# Where one text ends with the other, that one is the common subsequence; only other pairs go through their matches.
ROUGE_L_DOCUMENTS = f"""
lt AS (SELECT id, {K.tokens('prediction')} AS p, {K.tokens('reference')} AS r FROM current_run),
lx AS (SELECT id, p, r, len(p) <= len(r) AND r[len(r) - len(p) + 1 :] = p AS inside FROM lt),
lp AS (SELECT id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM lx WHERE NOT inside), lr AS (SELECT id, unnest(r) AS w, generate_subscripts(r, 1) AS j FROM lx WHERE NOT inside),
ls AS (SELECT lp.id, list([CAST(j AS BIGINT)] ORDER BY i, j DESC) AS s FROM lp JOIN lr ON lr.id = lp.id AND lr.w = lp.w GROUP BY lp.id),
lcs AS (SELECT id, len(list_reduce(s, lambda t, x: list_concat([y for y in t if y < x[1]], x, [y for y in t if y >= x[1]][2:]), CAST([] AS BIGINT[]))) AS c FROM ls),
rouge_l AS (SELECT lx.id, CASE WHEN len(p) > 0 AND len(r) > 0 THEN 2.0 * CASE WHEN inside THEN len(p) ELSE coalesce(c, 0) END / (len(p) + len(r)) ELSE 0.0 END AS rl FROM lx LEFT JOIN lcs ON lcs.id = lx.id)"""


@query("a9_rouge_l_documents", f"""
WITH {RUNS}, {rouge_rows('current_run')}, {ROUGE_L_DOCUMENTS}
SELECT s.split, CAST(count(*) AS BIGINT) AS num_examples, round(avg(r1), 6) AS rouge1, round(avg(r2), 6) AS rouge2, round(avg(rl), 6) AS "rougeL"
FROM rouge_rows r JOIN rouge_l l ON l.id = r.k JOIN studies s ON s.id = r.k GROUP BY s.split""")
def _(spark, sf):
    return r6(M.score(_current(spark, sf), [M.ROUGE], ["split"]), "rouge1", "rouge2", "rougeL")


def _predicted(lang="lang"):
    """Labels predicted in four ways, by language."""
    l = F.col("labels")
    none = F.array().cast("array<string>")
    return (
        F.when(F.col(lang) == "en", l).when(F.col(lang) == "fr", F.array(F.lit("No Finding")))
        .when(F.col(lang) == "de", F.array_distinct(F.concat(F.array(F.lit("Toxic")), l))).otherwise(none)
    )


def _labelled(spark, sf):
    return studies(spark, sf).select("id", "split", "lang", "labels", _predicted().alias("predicted"))


_PRED = """CASE lang WHEN 'en' THEN labels WHEN 'fr' THEN ['No Finding'] WHEN 'de' THEN list_distinct(list_concat(['Toxic'], labels)) ELSE [] END"""
MULTI = STUDIES + f""",
lp AS (SELECT id, split, lang, labels, {_PRED} AS predicted FROM studies),
counts AS (SELECT v.label, count(*) FILTER (list_contains(predicted, v.label) AND list_contains(labels, v.label)) AS tp,
  count(*) FILTER (list_contains(predicted, v.label) AND NOT list_contains(labels, v.label)) AS fp,
  count(*) FILTER (NOT list_contains(predicted, v.label) AND list_contains(labels, v.label)) AS fn
  FROM lp, (VALUES ('LowQuality'), ('Toxic'), ('No Finding'), ('Unlabeled')) v(label) GROUP BY v.label),
prf AS (SELECT label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, CAST(tp + fn AS BIGINT) AS support, tp, fp, fn FROM counts)"""
PRF = [f"{k}_{a}" for a in ("macro", "micro") for k in ("precision", "recall", "f1")]


def _summary_sql(labels: str, extra: str = "") -> str:
    return f"""SELECT CAST((SELECT count(*) FROM lp) AS BIGINT) AS num_examples, {extra}
  round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
  round(sum(tp) / sum(tp + fp), 6) AS precision_micro, round(sum(tp) / sum(tp + fn), 6) AS recall_micro, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) AS f1_micro
  FROM prf WHERE label IN ({labels})"""


@query("a11_multilabel_summary", f"""
WITH {MULTI} {_summary_sql("'LowQuality', 'Toxic', 'No Finding'", '''(SELECT round(avg(CASE WHEN list_sort(list_distinct(labels)) = list_sort(list_distinct(predicted)) THEN 1.0 ELSE 0.0 END), 6) FROM lp) AS accuracy_exact,
  (SELECT round(avg(CASE WHEN list_contains(predicted, 'Unlabeled') THEN 1.0 ELSE 0.0 END), 6) FROM lp) AS fallback_prediction_rate,''')}""")
def _(spark, sf):
    out = M.multilabel_summary(_labelled(spark, sf), "predicted", "labels", VOCAB.allowed, VOCAB.scored, VOCAB.fallbacks)
    return r6(out, "accuracy_exact", "fallback_prediction_rate", *PRF)


@query("a11_multilabel_classes", f"WITH {MULTI} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM prf")
def _(spark, sf):
    return r6(M.multilabel_classes(_labelled(spark, sf), "predicted", "labels", VOCAB.allowed), "precision", "recall", "f1")


@query("a11_multilabel_subset", f"""
WITH {MULTI} {_summary_sql("'LowQuality', 'Toxic'", '''(SELECT round(avg(CASE WHEN list_contains(labels, 'LowQuality') = list_contains(predicted, 'LowQuality')
  AND list_contains(labels, 'Toxic') = list_contains(predicted, 'Toxic') THEN 1.0 ELSE 0.0 END), 6) FROM lp) AS accuracy_exact,''')}""")
def _(spark, sf):
    out = M.multilabel_summary(_labelled(spark, sf), "predicted", "labels", VOCAB.labels)
    return r6(out, "accuracy_exact", *PRF)


@query("a12_disaggregate", f"""
WITH {RUNS}, {bleu_rows('current_run')}, f AS (SELECT s.id, 'lang' AS factor, s.lang AS value FROM studies s UNION ALL SELECT id, 'label', unnest(labels) FROM studies),
g AS (SELECT f.factor, f.value, CAST(count(*) AS BIGINT) AS n, {SUMS} FROM bleu_rows b JOIN f ON f.id = b.k GROUP BY ALL),
known AS (SELECT 'lang' AS factor, lang AS value FROM studies UNION SELECT 'lang', 'it')
SELECT coalesce(g.factor, k.factor) AS factor, coalesce(g.value, k.value) AS value, coalesce(n, 0) AS n, CASE WHEN n >= 100 THEN 'ok' ELSE 'not_estimable' END AS status,
  {', '.join(f"CASE WHEN n >= 100 THEN round({bleu_of(o)}, 6) END AS {k}" for k, o in zip(BLEU_KEYS, (4, 1, 2, 3, 4)))}
FROM g FULL JOIN known k ON k.factor = g.factor AND k.value = g.value""")
def _(spark, sf):
    langs = studies(spark, sf).select(F.lit("lang").alias("factor"), F.col("lang").alias("value"))
    known = langs.unionByName(spark.createDataFrame([("lang", "it")], "factor string, value string"))
    return r6(M.disaggregate(_current(spark, sf), {"lang": "lang", "label": "labels"}, [M.BLEU], 100, known), *BLEU_KEYS)


@query("a13_sectioned_metrics", f"""
WITH {STUDIES}, sec AS (SELECT id || ':f' AS id, {K.strip('impression')} AS prediction, {K.strip('findings')} AS reference FROM studies
  UNION ALL SELECT id || ':i', {K.strip('findings')}, {K.strip('impression')} FROM studies), {bleu_rows('sec')},
g AS (SELECT CASE WHEN k LIKE '%:f' THEN 'findings' ELSE 'impression' END AS section, CAST(count(*) AS BIGINT) AS num_examples, {SUMS} FROM bleu_rows GROUP BY 1)
SELECT section, num_examples, {bleu_cells()} FROM g""")
def _(spark, sf):
    f, i = F.col("findings"), F.col("impression")
    both = studies(spark, sf).select(
        "id", format_target(f, i, "findings_impression").alias("reference"), format_target(i, f, "findings_impression").alias("prediction")
    )
    return r6(M.sectioned_metrics(both, "findings_impression", [M.BLEU]), *BLEU_KEYS)


def _aligned(spark, sf):
    return J.align_predictions(*two_runs(spark, sf))[0]


_BOTH = RUNS + """,
al AS (SELECT c.id, c.reference, c.prediction, b.prediction AS baseline_prediction, row_number() OVER (ORDER BY c.id) - 1 AS idx, count(*) OVER () AS n
  FROM current_run c JOIN baseline_run b ON b.id = c.id)"""


_GOLDEN = f"{B._GOLDEN}::UHUGEINT"


def _mix64(x: str) -> str:
    """SQL of the mix that draws come from; ``x`` has 64 bits."""
    def step(y: str, shift: int, factor: int) -> str:
        return f"((xor({y}, {y} >> {shift}) * {factor}::UHUGEINT) & 18446744073709551615::UHUGEINT)"
    return f"list_transform([{step('h', 27, 0x94D049BB133111EB)} FOR h IN [{step('g', 30, 0xBF58476D1CE4E5B9)} FOR g IN [{x}]]], lambda k : xor(k, k >> 31))[1]"


def _keyed(key: str, part: str) -> str:
    return _mix64(f"xor(({key} + {_GOLDEN}) & 18446744073709551615::UHUGEINT, {part}::UHUGEINT)")


def _draws(resamples: int) -> str:
    """Draws of all resamples where all pairs are one block."""
    return f"""
sd AS (SELECT {_keyed('0::UHUGEINT', '42')} AS s), sr AS (SELECT r, {_keyed('s', 'r')} AS s FROM sd, range({resamples}) b(r)), sb AS (SELECT r, {_keyed('s', '0')} AS s FROM sr),
ct AS (SELECT {_mix64(f"((t + 1)::UHUGEINT * {_GOLDEN}) & 18446744073709551615::UHUGEINT")} AS c FROM range((SELECT max(n) FROM al)) d(t)),
draws AS (SELECT r AS resample, CAST({_mix64('xor(s, c)')} % (SELECT max(n) FROM al)::UHUGEINT AS BIGINT) AS idx FROM sb, ct)"""


def _verdict(resamples: int) -> str:
    return f"""round(quantile_cont(d, 0.025), 6) AS ci95_low, round(quantile_cont(d, 0.975), 6) AS ci95_high,
  round((1 + count(*) FILTER (d <= 0)) / {resamples + 1}, 6) AS p_value, quantile_cont(d, 0.025) > 0 AS significant, (SELECT max(n) FROM al) AS n, CAST({resamples} AS BIGINT) AS n_resamples"""


@query("a16_paired_bootstrap_mean", f"""
WITH {_BOTH}, s AS (SELECT idx, (length(prediction) - length(baseline_prediction)) / length(reference) AS diff FROM al), {_draws(1000)},
r AS (SELECT resample, sum(s.diff) / (SELECT max(n) FROM al) AS d FROM draws JOIN s ON s.idx = draws.idx GROUP BY resample)
SELECT round((SELECT avg(diff) FROM s), 6) AS delta, {_verdict(1000)} FROM r""")
def _(spark, sf):
    size = F.length("reference")  # 0 for an empty text, whose score is no number
    out = B.paired_bootstrap_mean(
        _aligned(spark, sf), "id", float_ratio(F.length("prediction"), size), float_ratio(F.length("baseline_prediction"), size), 1000, 42
    )
    return r6(out, "delta", "ci95_low", "ci95_high", "p_value")


_C = ", ".join(f"c.m{n} AS cm{n}, c.g{n} AS cg{n}, b.m{n} AS bm{n}, b.g{n} AS bg{n}" for n in range(1, 5)) + ", c.lp AS clp, c.lr AS clr, b.lp AS blp, b.lr AS blr"
_CSUM = ", ".join(f"sum({x}) AS {x}" for n in range(1, 5) for x in (f"cm{n}", f"cg{n}", f"bm{n}", f"bg{n}")) + ", " + ", ".join(f"sum({x}) AS {x}" for x in ("clp", "clr", "blp", "blr"))


@query("a17_paired_bootstrap_corpus", f"""
WITH {_BOTH}, {bleu_rows('al', name='cur')}, {bleu_rows('al', 'baseline_prediction', name='bas')},
s AS (SELECT al.idx, {_C} FROM al JOIN cur c ON c.k = al.id JOIN bas b ON b.k = al.id), {_draws(1000)},
o AS (SELECT {bleu_of(4, 'c')} - {bleu_of(4, 'b')} AS delta FROM (SELECT {_CSUM} FROM s)),
r AS (SELECT {bleu_of(4, 'c')} - {bleu_of(4, 'b')} AS d FROM (SELECT resample, {_CSUM} FROM draws JOIN s ON s.idx = draws.idx GROUP BY resample))
SELECT round((SELECT delta FROM o), 6) AS delta, {_verdict(1000)} FROM r""")
def _(spark, sf):
    return r6(B.paired_bootstrap_corpus(_aligned(spark, sf), "id", M.BLEU, "bleu"), "delta", "ci95_low", "ci95_high", "p_value")


@query("a33_calibration_verdict", f"""
WITH {MULTI}, c AS (SELECT lp.*, CASE WHEN lang = 'es' THEN ['No Finding'] ELSE labels END AS back FROM lp),
v AS (SELECT unnest(['LowQuality', 'Toxic', 'No Finding', 'Unlabeled']) AS l),
t AS (SELECT sum(2 * CAST(list_contains(back, l) AND list_contains(labels, l) AS INT)) AS a, sum(CAST(list_contains(back, l) AS INT) + CAST(list_contains(labels, l) AS INT)) AS b,
  sum(2 * CAST(list_contains(predicted, l) AND list_contains(labels, l) AS INT)) AS x, sum(CAST(list_contains(predicted, l) AS INT) + CAST(list_contains(labels, l) AS INT)) AS y FROM c, v)
SELECT CAST((SELECT count(*) FROM c) AS BIGINT) AS num_examples, round(a / b, 6) AS f1_round_trip, round(x / y, 6) AS f1_raw,
  CASE WHEN a / b >= 0.85 THEN 'usable' WHEN a / b >= 0.7 THEN 'with_caution' ELSE 'not_usable' END AS verdict FROM t""")
def _(spark, sf):
    l = _labelled(spark, sf).withColumn("back", F.when(F.col("lang") == "es", F.array(F.lit("No Finding"))).otherwise(F.col("labels")))
    return r6(E.calibration_verdict(l, "labels", "back", "predicted", VOCAB.allowed), "f1_round_trip", "f1_raw")


@query("c17_contrast_eval", f"""
WITH {MULTI}, o AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS idx, count(*) OVER () AS n FROM lp),
k AS (SELECT *, 1 + CAST('0x' || substr(md5('7:offset'), 1, 15) AS BIGINT) % (n - 1) AS off FROM o),
moved AS (SELECT a.id, b.id AS source_id, a.labels, b.predicted FROM k a JOIN k b ON b.idx = (a.idx + a.off) % a.n),
x AS (SELECT 'p' AS side, id, labels, predicted FROM lp UNION ALL SELECT 'm', id, labels, predicted FROM moved),
cc AS (SELECT side, v.label, count(*) FILTER (list_contains(predicted, v.label) AND list_contains(labels, v.label)) AS tp,
  count(*) FILTER (list_contains(predicted, v.label) AND NOT list_contains(labels, v.label)) AS fp, count(*) FILTER (NOT list_contains(predicted, v.label) AND list_contains(labels, v.label)) AS fn
  FROM x, (VALUES ('LowQuality'), ('Toxic'), ('No Finding')) v(label) GROUP BY ALL),
cs AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f FROM cc),
sc AS (SELECT side, avg(p) AS precision_macro, avg(r) AS recall_macro, avg(f) AS f1_macro, sum(tp) / sum(tp + fp) AS precision_micro, sum(tp) / sum(tp + fn) AS recall_micro, 2 * sum(tp) / sum(2 * tp + fp + fn) AS f1_micro FROM cs GROUP BY side),
ac AS (SELECT side, avg(CASE WHEN list_sort(list_distinct([l for l in labels if l IN ('LowQuality', 'Toxic', 'No Finding', 'Unlabeled')])) = list_sort(list_distinct([l for l in predicted if l IN ('LowQuality', 'Toxic', 'No Finding', 'Unlabeled')])) THEN 1.0 ELSE 0.0 END) AS accuracy_exact FROM x GROUP BY side),
lo AS (UNPIVOT (SELECT sc.side, precision_macro::DOUBLE AS precision_macro, recall_macro::DOUBLE AS recall_macro, f1_macro::DOUBLE AS f1_macro, precision_micro::DOUBLE AS precision_micro, recall_micro::DOUBLE AS recall_micro, f1_micro::DOUBLE AS f1_micro,
  accuracy_exact::DOUBLE AS accuracy_exact FROM sc JOIN ac ON ac.side = sc.side) ON COLUMNS(* EXCLUDE (side)) INTO NAME metric VALUE v)
SELECT metric, round(max(CASE WHEN side = 'm' THEN v END), 6) AS current, round(max(CASE WHEN side = 'p' THEN v END), 6) AS baseline,
  round(max(CASE WHEN side = 'm' THEN v END) - max(CASE WHEN side = 'p' THEN v END), 6) AS delta FROM lo GROUP BY metric""")
def _(spark, sf):
    l = _labelled(spark, sf).select("id", "labels", F.col("predicted").alias("predicted_labels"))
    out = E.contrast_eval(l, VOCAB, 7)[0]
    return r6(out.select("metric", "current", "baseline", "delta"), "current", "baseline", "delta")


_PAYLOAD_VOCAB = Vocabulary(labels=("LowQuality", "Toxic"), fallbacks=())


@query("c18_validation_payload", f"""
WITH {IMAGED} SELECT id, {K.strip('findings')} AS reference_findings, {K.strip('impression')} AS reference_impression, CASE WHEN lang = 'fr' THEN '- toxic.' ELSE {K.strip('impression')} END AS prediction_findings,
  CASE WHEN lang = 'en' THEN {K.strip('findings')} END AS prediction_impression, CASE WHEN lang = 'fr' THEN 'Toxic' ELSE '' END AS predicted_labels, 0 AS recognized_count, false AS complete, CAST(2.0 AS DOUBLE) AS epoch, 40 AS step FROM imaged""")
def _(spark, sf):
    from ..functions.text import strip_ws

    f, i = F.col("findings"), F.col("impression")
    lang = F.col("lang")
    one = F.when(lang == "fr", F.lit("Findings:\n- toxic.")).otherwise(F.concat(F.lit("Findings:\n"), strip_ws(i)))
    pred = F.when(lang == "en", format_target(i, f, "findings_impression")).otherwise(one)
    s = studies(spark, sf).select("id", format_target(f, i, "findings_impression").alias("reference"), pred.alias("prediction"))
    return E.validation_payload(s, _PAYLOAD_VOCAB, "positive_only", 2.0, 40).select(
        "id", "reference_findings", "reference_impression", "prediction_findings", "prediction_impression", joined("predicted_labels").alias("predicted_labels"),
        "recognized_count", "complete", "epoch", "step",
    )


@query("c18_validation_payload_dense", f"""
WITH {STUDIES}, {LABEL_OUTPUTS}
SELECT f.id, CASE WHEN len([l for l in labels if l IN ('LowQuality', 'Toxic')]) = 0 THEN 'No Finding' ELSE array_to_string([l for l in ['LowQuality', 'Toxic'] if list_contains(labels, l)], '|') END AS labels,
  array_to_string(CASE WHEN len(d) > 0 THEN CASE WHEN len(present) > 0 THEN [v for v in ['LowQuality', 'Toxic'] if list_contains(present, lower(v))]
    WHEN len(missing) = 0 AND len(dup) = 0 AND len(invalid) = 0 THEN ['No Finding'] ELSE [] END ELSE [] END, '|') AS predicted_labels,
  len(missing) = 0 AND len(dup) = 0 AND len(invalid) = 0 AS complete, CAST(len(list_distinct(seen)) AS INT) AS recognized_count, CAST(2.5 AS DOUBLE) AS epoch, 50 AS step
FROM fmt f JOIN studies s ON s.id = f.id""")
def _(spark, sf):
    reference = render_label_target(F.col("labels"), VOCAB, "dense_binary")
    df = studies(spark, sf).select("id", reference.alias("reference")).join(label_outputs(spark, sf).withColumnRenamed("x", "prediction"), "id")
    return E.validation_payload(df, VOCAB, "dense_binary", 2.5, 50).select(
        "id", joined("labels").alias("labels"), joined("predicted_labels").alias("predicted_labels"), "complete", "recognized_count", "epoch", "step")


def _vowels(preds: list[str], refs: list[str]) -> list[tuple[float, float]]:
    def share(t: str) -> float:
        return sum(ch in "aeiou" for ch in t) / len(t) if t else 0.0

    return [(share(p), abs(share(p) - share(r))) for p, r in zip(preds, refs)]


_SHARE = "(length({x}) - length(regexp_replace({x}, '[aeiou]', '', 'g'))) / length({x})"


@query("g1_python_metric", f"""
WITH {RUNS} SELECT s.lang, CAST(count(*) AS BIGINT) AS num_examples, round(avg({_SHARE.format(x='prediction')}), 6) AS vowels,
  round(avg(abs({_SHARE.format(x='prediction')} - {_SHARE.format(x='reference')})), 6) AS gap FROM current_run c JOIN studies s ON s.id = c.id GROUP BY s.lang""")
def _(spark, sf):
    return r6(M.score(_current(spark, sf), [M.python_metric("vowel", ("vowels", "gap"), _vowels)], ["lang"]), "vowels", "gap")


@query("g1_mean_metric", f"""
WITH {RUNS} SELECT s.split, CAST(count(*) AS BIGINT) AS num_examples, round(avg(least(length(prediction), length(reference)) / length(reference)), 6) AS size FROM current_run c JOIN studies s ON s.id = c.id GROUP BY s.split""")
def _(spark, sf):
    size = M.mean_metric("size", lambda p, r: F.least(F.length(p), F.length(r)) / F.length(r))
    return r6(M.score(_current(spark, sf), [size], ["split"]), "size")


@query("g2_normaliser", f"""
WITH {PAIRS}, {bleu_rows('pairs', norm=K.alnum)}, g AS (SELECT CAST(count(*) AS BIGINT) AS num_examples, {SUMS} FROM bleu_rows) SELECT num_examples, {bleu_cells()} FROM g""")
def _(spark, sf):
    return r6(M.score(pairs(spark, sf), [M.BLEU], normalise=alnum_key), *BLEU_KEYS)


@query("g3_metrics_by_name", f"""
WITH {PAIRS}, {bleu_rows('pairs')}, {rouge_rows('pairs')}, {ROUGE_L}, g AS (SELECT CAST(count(*) AS BIGINT) AS num_examples, {SUMS} FROM bleu_rows)
SELECT num_examples, {bleu_cells()}, round((SELECT avg(r1) FROM rouge_rows), 6) AS rouge1, round((SELECT avg(r2) FROM rouge_rows), 6) AS rouge2, round((SELECT avg(rl) FROM rouge_l), 6) AS rougeL FROM g""")
def _(spark, sf):
    out = M.score(pairs(spark, sf), M.select_metrics(["bleu", "rougeL", "rouge"]))
    return r6(out, *BLEU_KEYS, "rouge1", "rouge2", "rougeL")


@query("g4_sentence_rows", f"""
SELECT doc_id AS id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS pos FROM (SELECT doc_id, {K.sentences_sql('text')} AS s FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def _make_tokenizer():
    """Runs of letters or of digits, as a tokenizer that a user might bring."""
    import re

    kinds = re.compile("[a-z]+|[0-9]+")
    return lambda text: kinds.findall(text.lower())


_GRAM_SQL = """
t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+|[0-9]+') AS w FROM conversations),
g AS (SELECT conv_id, turn, 1 AS n, unnest(range(0, len(w))) AS pos, unnest(w) AS gram FROM t
  UNION ALL SELECT conv_id, turn, 2, unnest(range(0, len(w) - 1)), unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM t WHERE len(w) > 1)"""


@query("g4_tokenizer_rows", f"WITH {_GRAM_SQL} SELECT conv_id, turn, n, pos, gram FROM g")
def _(spark, sf):
    return gram_rows(table(spark, sf, "conversations"), "text", ["conv_id", "turn"], _make_tokenizer, (1, 2))


@query("g4_tokenizer_lateral", f"WITH {_GRAM_SQL}, c AS (SELECT n, gram, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT conv_id) AS BIGINT) AS conversations FROM g GROUP BY n, gram) SELECT * FROM c WHERE conversations > 1")
def _(spark, sf):
    register_gram_table(spark, "corpusflow_grams", _make_tokenizer, (1, 2))
    return spark.sql("""
        SELECT t.n, t.gram, count(*) AS occurrences, count(DISTINCT c.conv_id) AS conversations
        FROM {conversations} c, LATERAL corpusflow_grams(c.text) t GROUP BY t.n, t.gram HAVING count(DISTINCT c.conv_id) > 1""",
        conversations=table(spark, sf, "conversations"))


def _make_scorer():
    return lambda texts: [float(sum(ch in "aeiou" for ch in t)) for t in texts]


@query("g5_score_distinct", "SELECT conv_id, turn, CAST(length(text) - length(regexp_replace(text, '[aeiou]', '', 'g')) AS DOUBLE) AS score FROM conversations")
def _(spark, sf):
    return M.score_distinct(table(spark, sf, "conversations"), "text", _make_scorer).select("conv_id", "turn", "score")
