"""Label functions over the studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L

from ..functions.vocabulary import TagRules
from . import sqlkit as K
from .fixtures import STUDIES, VOCAB, joined, studies
from .registry import query

# Word prefixes of the invented prose as a rule table.
PROSE_RULES = TagRules(
    rules=(("Ending", ("tion", "ment")), ("Article", ("the", "der", "les")), ("Vowel", ("eau", "ou")), ("Linked", ("und",))),
    whole_tag_keywords=frozenset({"und"}),
    aliases={"eau": ("eau", "eaux")},
    residual=("Vowel", ("ai",)),
    unindexed_tokens=("no indexing",),
)


def _tags(spark, sf):
    """Words of the first line as tags, with a slash part."""
    s = studies(spark, sf)
    words = F.split("findings", " ")
    tags = (
        F.when(F.col("label_str") == "No Finding", F.array(F.lit("Normal")))
        .when(F.col("label_str") == "Toxic", F.array(F.lit("no indexing"), F.lit("normal")))
        .otherwise(F.transform(words, lambda w: F.concat(w, F.lit("/"), F.col("lang"), F.lit(" und"))))
    )
    return s.select("id", F.when(F.col("lang") == "es", F.transform(words, lambda w: F.concat(w, F.lit("/x")))).otherwise(tags).alias("tags"))


_WORDS = "string_split(findings, ' ')"


def _has(scope: str, words: str) -> str:
    return K.word_start(scope, words)


def _any(cond: str) -> str:
    return f"len([t for t in tags if {cond}]) > 0"


_P = "split_part(t, '/', 1)"
_DIRECT = f"({_has(_P, 'tion|ment')} OR {_has(_P, 'the|der|les')} OR {_has(_P, 'eau|eaux|ou')} OR {_has('t', 'und')})"


@query("p20_tag_labels", f"""
WITH {STUDIES}, raw AS (SELECT id, CASE WHEN lang = 'es' THEN [w || '/x' for w in {_WORDS}] WHEN label_str = 'No Finding' THEN ['Normal']
  WHEN label_str = 'Toxic' THEN ['no indexing', 'normal'] ELSE [w || '/' || lang || ' und' for w in {_WORDS}] END AS r FROM studies),
t0 AS (SELECT id, [lower(x) for x in r] AS tags FROM raw),
f AS (SELECT id, tags, list_filter([CASE WHEN {_any(_has(_P, 'tion|ment'))} THEN 'Ending' END, CASE WHEN {_any(_has(_P, 'the|der|les'))} THEN 'Article' END,
  CASE WHEN {_any(_has(_P, 'eau|eaux|ou'))} OR {_any(f"NOT {_DIRECT} AND {_has('t', 'ai')}")} THEN 'Vowel' END, CASE WHEN {_any(_has('t', 'und'))} THEN 'Linked' END],
  lambda l: l IS NOT NULL) AS found FROM t0)
SELECT id, CASE WHEN len(found) > 0 THEN array_to_string(found, '|') WHEN len([t for t in tags if t <> 'normal']) = 0 THEN 'No Finding'
  WHEN len([t for t in tags if t NOT IN ('normal', 'no indexing')]) = 0 THEN 'Unlabeled' ELSE 'Other' END AS labels FROM f""")
def _(spark, sf):
    return _tags(spark, sf).select("id", joined(L.tag_labels(F.col("tags"), PROSE_RULES)).alias("labels"))


@query("p21_map_vocabulary", f"""
WITH {STUDIES} SELECT id, CASE WHEN contains(label_str, 'Unlabeled') THEN NULL
  ELSE replace(replace(replace(label_str, 'No Finding', 'Nessun Reperto'), 'LowQuality', 'Scarsa'), 'Toxic', 'Tossico') END AS labels,
  CASE WHEN contains(label_str, 'Unlabeled') THEN 'unknown_label' END AS violation FROM studies""")
def _(spark, sf):
    names = {"No Finding": "Nessun Reperto", "LowQuality": "Scarsa", "Toxic": "Tossico"}
    m = L.map_vocabulary(F.col("labels"), names)
    return studies(spark, sf).select("id", m.alias("m")).select("id", joined("m.labels").alias("labels"), "m.violation")


@query("p22_canonical_labels", f"""
WITH {STUDIES} SELECT id, CASE WHEN label_str = 'Unlabeled' THEN NULL WHEN label_str = 'No Finding' THEN 'No Finding' ELSE label_str END AS labels,
  CASE WHEN label_str = 'Unlabeled' THEN 'unknown_label' END AS violation FROM studies""")
def _(spark, sf):
    # Reversed and doubled, with the exclusive label mixed in.
    messy = F.concat(F.reverse("labels"), F.col("labels"), F.array(F.lit("No Finding")))
    m = L.canonical_labels(messy, VOCAB.scored)
    return studies(spark, sf).select("id", m.alias("m")).select("id", joined("m.labels").alias("labels"), "m.violation")


LEXICON = {"Article": r"\bthe\b", "Ending": r"tion", "Vowels": r"eau|ou", "Number": r"[0-9]{2}"}
_LEX_SQL = f"""list_filter([CASE WHEN {K.whole_word('report', 'the')} THEN 'Article' END, CASE WHEN regexp_matches(report, '(?i)tion') THEN 'Ending' END,
  CASE WHEN regexp_matches(report, '(?i)eau|ou') THEN 'Vowels' END, CASE WHEN regexp_matches(report, '[0-9]{{2}}') THEN 'Number' END], lambda l: l IS NOT NULL)"""


@query("p25_mentions", f"""
WITH {STUDIES} SELECT id, array_to_string({_LEX_SQL}, '|') AS mentioned,
  regexp_matches(CASE WHEN impression <> '' THEN impression ELSE findings END, '(?i)(sans|ohne|no the)') AS negative FROM studies""")
def _(spark, sf):
    neg = L.is_negative(F.col("findings"), F.col("impression"), "(sans|ohne|no the)")
    return studies(spark, sf).select("id", joined(L.mentions(F.col("report"), LEXICON)).alias("mentioned"), neg.alias("negative"))


LABEL_OUTPUTS = f"""
outputs AS (SELECT id, CASE
  WHEN lang = 'en' THEN 'Clinical findings:' || chr(10) || 'LowQuality: ' || CASE WHEN list_contains(labels, 'LowQuality') THEN 'Present' ELSE 'Absent' END
       || chr(10) || 'Toxic: ' || CASE WHEN list_contains(labels, 'Toxic') THEN 'Present' ELSE 'Absent' END
  WHEN lang = 'fr' THEN 'Clinical findings:' || chr(10) || '- ' || array_to_string(labels, ',  * ') || '.'
  WHEN lang = 'de' THEN '1. toxic: ' || CASE WHEN list_contains(labels, 'Toxic') THEN 'PRESENT.' ELSE 'maybe' END || '; 2) TOXIC : absent'
  ELSE findings || '; no finding' END AS x FROM studies),
lined AS (SELECT id, [regexp_replace({K.strip("regexp_replace(l, '^\\s*([-*•]|[0-9]+[.)])\\s*', '')")}, '[.:]+\\z', '') for l in
  regexp_split_to_array(regexp_replace(x, '[;,]', chr(10), 'g'), '\\r\\n|[\\n\\r\\x{{0B}}\\x{{0C}}\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]')] AS ls FROM outputs),
dense0 AS (SELECT id, ls, [{{'label': lower({K.strip("regexp_extract(l, '(?s)^(.*):(.*)\\z', 1)")}), 'status': lower(regexp_replace({K.strip("regexp_extract(l, '(?s)^(.*):(.*)\\z', 2)")}, '[.]+\\z', ''))}}
  for l in ls if contains(l, ':')] AS d FROM lined),
dense AS (SELECT id, ls, [r for r in d if r.label IN ('lowquality', 'toxic')] AS d FROM dense0),
sets AS (SELECT id, ls, d, [r.label for r in d if r.status = 'present'] AS present, [r.label for r in d if r.status IN ('present', 'absent')] AS seen,
  [r.label for r in d if r.status NOT IN ('present', 'absent')] AS bad FROM dense),
fmt AS (SELECT *, [v for v in ['LowQuality', 'Toxic'] if NOT list_contains(seen, lower(v))] AS missing,
  [v for v in ['LowQuality', 'Toxic'] if len([s for s in seen if s = lower(v)]) > 1] AS dup, [v for v in ['LowQuality', 'Toxic'] if list_contains(bad, lower(v))] AS invalid FROM sets)"""


def label_outputs(spark, sf):
    """Label texts in four styles: dense, bulleted, broken dense, loose."""
    s = studies(spark, sf)
    dense = L.render_label_target(F.col("labels"), VOCAB, "dense_binary")
    bullets = F.concat(F.lit("Clinical findings:\n- "), F.array_join("labels", ",  * "), F.lit("."))
    has = F.array_contains("labels", "Toxic")
    broken = F.concat(F.lit("1. toxic: "), F.when(has, "PRESENT.").otherwise("maybe"), F.lit("; 2) TOXIC : absent"))
    loose = F.concat("findings", F.lit("; no finding"))
    lang = F.col("lang")
    return s.select("id", F.when(lang == "en", dense).when(lang == "fr", bullets).when(lang == "de", broken).otherwise(loose).alias("x"))


@query("p26_parse_label_lines", f"""
WITH {STUDIES}, {LABEL_OUTPUTS}
SELECT id, array_to_string(CASE WHEN len(d) > 0 THEN CASE WHEN len(present) > 0 THEN [v for v in ['LowQuality', 'Toxic'] if list_contains(present, lower(v))]
    WHEN len(missing) = 0 AND len(dup) = 0 AND len(invalid) = 0 THEN ['No Finding'] ELSE [] END
  ELSE [v for v in ['LowQuality', 'Toxic', 'No Finding'] if list_contains([lower(l) for l in ls], lower(v))] END, '|') AS labels,
  array_to_string(CASE WHEN len(d) > 0 THEN CASE WHEN len(present) > 0 THEN [v for v in ['LowQuality', 'Toxic'] if list_contains(present, lower(v))]
    WHEN len(missing) = 0 AND len(dup) = 0 AND len(invalid) = 0 THEN ['No Finding'] ELSE [] END ELSE [] END, '|') AS dense_labels FROM fmt""")
def _(spark, sf):
    x = F.col("x")
    return label_outputs(spark, sf).select(
        "id", joined(L.parse_label_lines(x, VOCAB)).alias("labels"), joined(L.parse_label_lines(x, VOCAB, "dense_binary")).alias("dense_labels")
    )


@query("p27_dense_format_report", f"""
WITH {STUDIES}, {LABEL_OUTPUTS}
SELECT id, len(missing) = 0 AND len(dup) = 0 AND len(invalid) = 0 AS complete, CAST(len(list_distinct(seen)) AS BIGINT) AS recognized,
  array_to_string(missing, '|') AS missing, array_to_string(dup, '|') AS duplicate, array_to_string(invalid, '|') AS invalid FROM fmt""")
def _(spark, sf):
    return label_outputs(spark, sf).select("id", L.dense_format_report(F.col("x"), VOCAB).alias("r")).select(
        "id", "r.complete", F.col("r.recognized_count").alias("recognized"), joined("r.missing_labels").alias("missing"),
        joined("r.duplicate_labels").alias("duplicate"), joined("r.invalid_labels").alias("invalid"),
    )


@query("p28_render_label_target", f"""
WITH {STUDIES} SELECT id, 'Clinical findings:' || chr(10) || CASE WHEN label_str = 'Unlabeled' THEN '' ELSE replace(label_str, '|', chr(10)) END AS positive,
  'Clinical findings:' || chr(10) || 'LowQuality: ' || CASE WHEN list_contains(labels, 'LowQuality') THEN 'Present' ELSE 'Absent' END || chr(10) ||
  'Toxic: ' || CASE WHEN list_contains(labels, 'Toxic') THEN 'Present' ELSE 'Absent' END AS dense,
  'Clinical findings:' || chr(10) || replace(label_str, '|', chr(10)) AS positive_all FROM studies""")
def _(spark, sf):
    l = F.col("labels")
    return studies(spark, sf).select(
        "id", L.render_label_target(l, VOCAB).alias("positive"), L.render_label_target(l, VOCAB, "dense_binary").alias("dense"),
        L.render_label_target(l, VOCAB, "positive_only", True).alias("positive_all"),
    )


@query("p32_label_policy", f"""
WITH {STUDIES} SELECT 'all' AS variant, CAST(count(*) AS BIGINT) AS n FROM studies
UNION ALL SELECT 'no_residual', CAST(count(*) AS BIGINT) FROM studies WHERE NOT list_contains(labels, 'Unlabeled')""")
def _(spark, sf):
    from ..plans.curation import filter_by_label_policy

    s = studies(spark, sf)
    parts = [
        filter_by_label_policy(s, "labels", v, "Unlabeled").agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("variant"), "n")
        for v in ("all", "no_residual")
    ]
    return parts[0].unionByName(parts[1])


@query("c7_stratum", f"""
WITH {STUDIES} SELECT id, CASE WHEN label_str = 'No Finding' THEN 'healthy' WHEN label_str = 'Unlabeled' THEN 'other' ELSE 'pathological' END AS stratum FROM studies""")
def _(spark, sf):
    return studies(spark, sf).select("id", L.stratum(F.col("labels"), VOCAB).alias("stratum"))


