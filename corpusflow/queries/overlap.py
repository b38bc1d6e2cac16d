"""Phrase profiles and overlap over the studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlap as O
from ..session import cut
from . import sqlkit as K
from .fixtures import STUDIES, r6, studies
from .registry import query

SECTIONS = {"findings": "findings", "impression": "impression"}
PROFILE = ("repetition", "top10_share", "hapax_share")

PHRASES = STUDIES + f""",
sent AS (SELECT split, lang, 'findings' AS section, unnest({K.sentences_sql('findings')}) AS phrase FROM studies
  UNION ALL SELECT split, lang, 'impression', unnest({K.sentences_sql('impression')}) FROM studies)"""


def profile_sql(source: str, by: str) -> str:
    """Profile of a count table (by.., phrase, n)."""
    return f"""
SELECT {by}, CAST(sum(n) AS BIGINT) AS occurrences, CAST(count(*) AS BIGINT) AS n_distinct, round(sum(n) / count(*), 6) AS repetition,
  round(sum(n) FILTER (rk <= 10) / sum(n), 6) AS top10_share, round(count(*) FILTER (n = 1) / count(*), 6) AS hapax_share,
  CAST(count(*) FILTER (n = 1) AS BIGINT) AS band_once, CAST(count(*) FILTER (n BETWEEN 2 AND 4) AS BIGINT) AS band_2_4,
  CAST(count(*) FILTER (n BETWEEN 5 AND 9) AS BIGINT) AS band_5_9, CAST(count(*) FILTER (n BETWEEN 10 AND 49) AS BIGINT) AS band_10_49,
  CAST(count(*) FILTER (n >= 50) AS BIGINT) AS band_50_up
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, phrase) AS rk FROM {source}) GROUP BY {by}"""


@query("a20_phrase_profile", f"WITH {PHRASES}, c AS (SELECT CASE WHEN split <> 'val' THEN split END AS split, section, phrase, count(*) AS n FROM sent GROUP BY ALL) {profile_sql('c', 'split, section')}")
def _(spark, sf):
    s = studies(spark, sf).withColumn("split", F.when(F.col("split") != "val", F.col("split")))  # the null group stands for one
    counts = O.phrases(s, SECTIONS, by=["split"])
    return r6(O.phrase_profile(counts, ["split", "section"]), *PROFILE)


@query("a20_section_profile", f"""
WITH {STUDIES}, sec AS (SELECT 'findings' AS section, findings AS t FROM studies UNION ALL SELECT 'impression', impression FROM studies),
c AS (SELECT section, regexp_replace(lower({K.squash('t')}), '^[.,;: ]+|[.,;: ]+\\z', '', 'g') AS phrase, count(*) AS n FROM sec WHERE {K.filled('t')} GROUP BY ALL) {profile_sql('c', 'section')}""")
def _(spark, sf):
    return r6(O.phrase_profile(O.phrases(studies(spark, sf), SECTIONS, "section"), ["section"]), *PROFILE)


_SIDES = PHRASES + """,
tr AS (SELECT section, phrase, count(*) AS n FROM sent WHERE split = 'train' GROUP BY ALL),
te AS (SELECT section, phrase, count(*) AS n FROM sent WHERE split = 'test' GROUP BY ALL),
va AS (SELECT section, phrase, count(*) AS n FROM sent WHERE split = 'val' GROUP BY ALL)"""


def overlap_sql(train: str, pred: str, by: str, name: str) -> str:
    """CTEs of the overlap of two count tables; ``by`` holds section, maybe more on the predicted side."""
    return f"""
{name}_tt AS (SELECT section, sum(n) AS t FROM {train} GROUP BY section), {name}_pt AS (SELECT {by}, sum(n) AS t FROM {pred} GROUP BY {by}),
{name}_hot AS (SELECT section, phrase FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, phrase) AS rk FROM {train}) WHERE rk <= 10),
{name}_j AS (SELECT {', '.join('p.' + c.strip() for c in by.split(','))}, p.phrase, p.n, t.n AS tn, (p.n / {name}_pt.t) / (t.n / {name}_tt.t) AS amp, h.phrase IS NOT NULL AS hot
  FROM {pred} p JOIN {name}_pt ON {' AND '.join(f'{name}_pt.{c.strip()} = p.{c.strip()}' for c in by.split(','))} LEFT JOIN {train} t ON t.section = p.section AND t.phrase = p.phrase
  LEFT JOIN {name}_tt ON {name}_tt.section = p.section LEFT JOIN {name}_hot h ON h.section = p.section AND h.phrase = p.phrase),
{name} AS (SELECT {by}, sum(n) AS occurrences, count(*) AS n_distinct, coalesce(sum(n) FILTER (tn IS NOT NULL), 0) / sum(n) AS copied_share,
  count(tn) / count(*) AS copied_distinct_share, count(*) - count(tn) AS n_new, (count(*) - count(tn)) / count(*) AS new_share, avg(amp) FILTER (hot) AS amp_top10 FROM {name}_j GROUP BY {by})"""


@query("a21_phrase_overlap", f"""
WITH {_SIDES}, {overlap_sql('tr', 'te', 'section', 'ov')}
SELECT section, CAST(occurrences AS BIGINT) AS occurrences, CAST(n_distinct AS BIGINT) AS n_distinct, round(copied_share, 6) AS copied_share, round(copied_distinct_share, 6) AS copied_distinct_share,
  CAST(n_new AS BIGINT) AS n_new, round(new_share, 6) AS new_share, round(amp_top10, 6) AS amp_top10 FROM ov""")
def _(spark, sf):
    counts = cut(O.phrases(studies(spark, sf), SECTIONS, by=["split"]))  # read several times below
    train, test = (counts.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    return r6(O.phrase_overlap(train, test, ["section"]), "copied_share", "copied_distinct_share", "new_share", "amp_top10")


@query("a21_amplification", f"""
WITH {_SIDES}, tt AS (SELECT section, sum(n) AS t FROM tr GROUP BY section), pt AS (SELECT section, sum(n) AS t FROM te GROUP BY section)
SELECT p.section, p.phrase, p.n AS n_pred, round(p.n / pt.t, 6) AS share_pred, coalesce(t.n, 0) AS n_train, round(coalesce(t.n / tt.t, 0), 6) AS share_train,
  round((p.n / pt.t) / (t.n / tt.t), 6) AS amplification FROM te p JOIN pt ON pt.section = p.section LEFT JOIN tr t ON t.section = p.section AND t.phrase = p.phrase LEFT JOIN tt ON tt.section = p.section""")
def _(spark, sf):
    counts = cut(O.phrases(studies(spark, sf), SECTIONS, by=["split"]))  # read several times below
    train, test = (counts.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    return r6(O.phrase_amplification(train, test, ["section"]), "share_pred", "share_train", "amplification")


SYNTH = ("diversity", "vocab_train", "repetition", "top10", "top10_ref", "copy", "copy_ref", "delta_copy", "new_share", "amp_top10", "section_repetition")


def _experiments(spark, sf):
    """Test studies as the output of one experiment per language; Spanish has no impression."""
    s = studies(spark, sf).where(F.col("split") == "test")
    keep = F.when(F.col("lang") != "es", F.col("impression")).otherwise("")
    return s.select(F.col("lang").alias("experiment"), "findings", keep.alias("impression"))


_EXP = _SIDES + f""",
ex AS (SELECT lang AS experiment, section, phrase, count(*) AS n FROM sent WHERE split = 'test' AND NOT (lang = 'es' AND section = 'impression') GROUP BY ALL)"""


@query("a22_overlap_synthesis", f"""
WITH {_EXP}, secs AS (SELECT lang AS experiment, 'findings' AS section, findings AS t FROM studies WHERE split = 'test'
  UNION ALL SELECT lang, 'impression', CASE WHEN lang <> 'es' THEN impression ELSE '' END FROM studies WHERE split = 'test'),
sc AS (SELECT experiment, section, regexp_replace(lower({K.squash('t')}), '^[.,;: ]+|[.,;: ]+\\z', '', 'g') AS phrase, count(*) AS n FROM secs WHERE {K.filled('t')} GROUP BY ALL),
pp AS ({profile_sql('ex', 'experiment, section')}), pr AS ({profile_sql('va', 'section')}), pt AS ({profile_sql('tr', 'section')}), ps AS ({profile_sql('sc', 'experiment, section')}),
{overlap_sql('tr', 'ex', 'experiment, section', 'ov')}, {overlap_sql('tr', 'va', 'section', 'rv')}
SELECT pp.experiment, pp.section, pp.n_distinct, pr.n_distinct AS distinct_ref, round(pp.n_distinct / pr.n_distinct, 6) AS diversity, round(pp.n_distinct / pt.n_distinct, 6) AS vocab_train,
  pp.repetition, pp.top10_share AS top10, pr.top10_share AS top10_ref, round(ov.copied_share, 6) AS "copy", round(rv.copied_share, 6) AS copy_ref, round(ov.copied_share - rv.copied_share, 6) AS delta_copy,
  round(ov.new_share, 6) AS new_share, round(ov.amp_top10, 6) AS amp_top10, ps.repetition AS section_repetition
FROM pp LEFT JOIN pr USING (section) LEFT JOIN pt USING (section) LEFT JOIN ov ON ov.experiment = pp.experiment AND ov.section = pp.section LEFT JOIN rv ON rv.section = pp.section
LEFT JOIN ps ON ps.experiment = pp.experiment AND ps.section = pp.section""")
def _(spark, sf):
    counts = cut(O.phrases(studies(spark, sf), SECTIONS, by=["split"]))  # read several times below
    train, ref = (counts.where(F.col("split") == s).drop("split") for s in ("train", "val"))
    e = _experiments(spark, sf)
    pred, whole = (cut(O.phrases(e, SECTIONS, level, ["experiment"])) for level in ("sentence", "section"))
    return r6(O.overlap_synthesis(train, pred, ref, whole), *SYNTH)


@query("a22_anomalies", f"""
WITH {_EXP}, t AS (SELECT DISTINCT lang AS experiment, CASE WHEN lang = 'en' THEN 'findings' ELSE 'findings_impression' END AS target FROM studies UNION SELECT 'it', 'findings'),
h AS (SELECT t.*, EXISTS (SELECT 1 FROM ex WHERE ex.experiment = t.experiment AND section = 'findings') AS f, EXISTS (SELECT 1 FROM ex WHERE ex.experiment = t.experiment AND section = 'impression') AS i FROM t)
SELECT experiment, 'missing_findings' AS anomaly FROM h WHERE NOT f UNION ALL SELECT experiment, 'missing_impression' FROM h WHERE target <> 'findings' AND NOT i
UNION ALL SELECT experiment, 'unrequested_impression' FROM h WHERE target = 'findings' AND i""")
def _(spark, sf):
    pred = O.phrases(_experiments(spark, sf), SECTIONS, by=["experiment"])
    kinds = F.when(F.col("lang") == "en", "findings").otherwise("findings_impression")
    e = studies(spark, sf).select(F.col("lang").alias("experiment"), kinds.alias("target")).distinct()
    return O.synthesis_anomalies(pred, e.unionByName(spark.createDataFrame([("it", "findings")], "experiment string, target string")))


@query("a23_panel_rates", f"""
WITH {STUDIES}, m AS (SELECT lang, label_str = 'No Finding' AS well, regexp_matches(CASE WHEN impression <> '' THEN impression ELSE findings END, '(?i)(tion|der )') AS neg,
  CASE WHEN list_contains(labels, 'Toxic') THEN 1 ELSE 0 END + CASE WHEN list_contains(labels, 'LowQuality') THEN 1 ELSE 0 END AS opens,
  CASE WHEN list_contains(labels, 'Toxic') AND regexp_matches(findings || ' ' || impression, '(?i)the') THEN 1 ELSE 0 END
  + CASE WHEN list_contains(labels, 'LowQuality') AND regexp_matches(findings || ' ' || impression, '(?i)eau|ich') THEN 1 ELSE 0 END AS cites FROM studies),
g AS (SELECT lang, count(*) FILTER (well) AS h, count(*) FILTER (well AND neg) AS hn, count(*) FILTER (NOT well) AS p, count(*) FILTER (NOT well AND neg) AS fnn,
  coalesce(sum(opens) FILTER (NOT well), 0) AS o, coalesce(sum(cites) FILTER (NOT well), 0) AS c FROM m GROUP BY lang)
SELECT lang, h AS n_healthy, hn AS healthy_negative, p AS n_pathological, fnn AS false_negative, CAST(o AS BIGINT) AS n_mentionable, CAST(c AS BIGINT) AS n_cited,
  round(CASE WHEN h > 0 THEN hn / h ELSE 0 END, 6) AS healthy_negative_share, round(CASE WHEN p > 0 THEN fnn / p ELSE 0 END, 6) AS false_negative_share, round(CASE WHEN o > 0 THEN c / o ELSE 0 END, 6) AS cited_share FROM g""")
def _(spark, sf):
    lexicon = {"Toxic": "the", "LowQuality": "eau|ich"}
    out = O.panel_rates(studies(spark, sf), lexicon, "(tion|der )", "No Finding", ["lang"])
    return r6(out, "healthy_negative_share", "false_negative_share", "cited_share")
