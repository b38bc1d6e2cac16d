"""Draws and mixes over the studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as P
from ..operators.selection import allocate
from . import sqlkit as K
from .fixtures import STUDIES, VOCAB, r6, studies, table
from .registry import query

SEED = 42


@query("c8_allocate", """
WITH r AS (SELECT o_orderstatus AS status, lang AS name, count(*) AS c FROM (SELECT DISTINCT o_orderstatus FROM orders), documents GROUP BY ALL),
s AS (SELECT status, name, c / sum(c) OVER (PARTITION BY status) AS ratio FROM r), f AS (SELECT *, floor(ratio * 997) AS lo, ratio * 997 - floor(ratio * 997) AS frac FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY frac DESC, name DESC) AS rk, 997 - sum(lo) OVER (PARTITION BY status) AS spare FROM f)
SELECT name, round(ratio, 6) AS ratio, CAST(lo + CASE WHEN rk <= spare THEN 1 ELSE 0 END AS BIGINT) AS n FROM k WHERE status = 'F'""")
def _(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("c"))
    total = d.agg(F.sum("c")).scalar()
    return r6(allocate(d.select("name", (F.col("c") / total).alias("ratio")), 997), "ratio")


def uniform_sql(pool: str, n: str, stream: str) -> str:
    """``slot, id`` of n uniform draws from a pool of ids."""
    return f"""(WITH o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM {pool}),
  s AS (SELECT range AS slot, {K.draw(f'{SEED}:{stream}', 'range')} % (SELECT count(*) FROM {pool}) AS idx FROM range({n})) SELECT s.slot, o.id FROM s JOIN o ON o.idx = s.idx)"""


def weighted_sql(pool: str, weight: str, n: str, stream: str) -> str:
    """``slot, id`` of n draws from a pool by weight."""
    wide = f"CAST({K.draw(f'{SEED}:{stream}', 'range')} AS HUGEINT) * 1152921504606846976 + CAST({K.draw(f'{SEED}:{stream}:low', 'range')} AS HUGEINT)"
    return f"""(WITH w AS (SELECT id, greatest(CAST(ceil({weight} / (SELECT max({weight}) FROM {pool}) * 1099511627776.0::DOUBLE) AS HUGEINT), 1) AS w FROM {pool} WHERE {weight} > 0),
  i AS (SELECT id, sum(w) OVER (ORDER BY id) - w AS lo, sum(w) OVER (ORDER BY id) AS hi FROM w),
  s AS (SELECT range AS slot, ({wide}) % (SELECT CAST(sum(w) AS HUGEINT) FROM w) AS u FROM range({n})) SELECT s.slot, i.id FROM s JOIN i ON s.u >= i.lo AND s.u < i.hi)"""


# Weights from a billionth to several tens.
_SPREAD = "CASE WHEN source = 'src3' THEN 1e-9::DOUBLE WHEN lang = 'fr' THEN n_chars * 1e-6::DOUBLE ELSE n_chars / 1000.0::DOUBLE END"


@query("c9_sample_weighted", f"WITH p AS (SELECT doc_id AS id, {_SPREAD} AS weight FROM documents) SELECT slot, id FROM {weighted_sql('p', 'weight', '5000', 'weighted')}")
def _(spark, sf):
    weight = F.when(F.col("source") == "src3", F.lit(1e-9)).when(F.col("lang") == "fr", F.col("n_chars") * F.lit(1e-6)).otherwise(F.col("n_chars") / F.lit(1000.0))
    return P.sample_weighted(table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang"), "doc_id", weight, 5000, SEED)


@query("c9_sample_uniform", f"WITH p AS (SELECT doc_id AS id FROM documents) SELECT slot, id FROM {uniform_sql('p', '3000', 'uniform')}")
def _(spark, sf):
    return P.sample_uniform(table(spark, sf, "documents").select("doc_id"), "doc_id", 3000, SEED)


_QUOTA = f"""
pools AS (SELECT id, unnest(labels) AS label FROM {{pool}}), live AS (SELECT label, count(*) AS c FROM pools WHERE label IN ('LowQuality', 'Toxic') GROUP BY label),
ln AS (SELECT label, c, row_number() OVER (ORDER BY label) - 1 AS o, count(*) OVER () AS k FROM live),
sl AS (SELECT range AS slot, {K.draw(f'{SEED}:quota', 'range')} AS d FROM range({{n}})),
ob AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS rn FROM pools),
quota AS (SELECT sl.slot, ob.id, ln.label FROM sl JOIN ln ON ln.o = sl.slot % ln.k JOIN ob ON ob.label = ln.label AND ob.rn = sl.d % ln.c + 1)"""


@query("c10_sample_label_quota", f"WITH {STUDIES}, {_QUOTA.format(pool='studies', n=1000)} SELECT slot, id, label FROM quota")
def _(spark, sf):
    return P.sample_label_quota(studies(spark, sf), "id", "labels", VOCAB.labels, 1000, SEED)[0]


_WEIGHTS = """
wc AS (SELECT label, 1 / sqrt(count(*)) AS raw FROM (SELECT unnest(labels) AS label FROM {pool}) WHERE label IN ('LowQuality', 'Toxic') GROUP BY label),
wl AS (SELECT label, least(3.0, raw / (SELECT quantile_cont(raw, 0.5) FROM wc)) AS w FROM wc),
{name} AS (SELECT s.id, coalesce(max(wl.w), 1.0) AS weight FROM (SELECT id, unnest(labels) AS label FROM {pool}) s LEFT JOIN wl ON wl.label = s.label GROUP BY s.id)"""
_SUPERVISED = STUDIES + """,
sup AS (SELECT * FROM studies WHERE label_str <> 'Unlabeled'), well AS (SELECT id FROM sup WHERE label_str = 'No Finding'), sick AS (SELECT * FROM sup WHERE label_str <> 'No Finding'),
k AS (SELECT count(*) AS t FROM sup), a AS (SELECT t, floor(t * 0.3) AS h0, floor(t * 0.7) AS p0, t * 0.3 - floor(t * 0.3) AS fh, t * 0.7 - floor(t * 0.7) AS fp FROM k),
n AS (SELECT CAST(h0 + CASE WHEN t - h0 - p0 > 0 AND fh > fp THEN 1 ELSE 0 END AS BIGINT) AS nh, CAST(p0 + CASE WHEN t - h0 - p0 > 0 AND NOT fh > fp THEN 1 ELSE 0 END AS BIGINT) AS np FROM a)"""


def _supervised(spark, sf):
    return studies(spark, sf).where(F.col("label_str") != "Unlabeled").select("id", "labels")


@query("c11_balanced_weighted", f"""
WITH {_SUPERVISED}, {_WEIGHTS.format(pool='sick', name='sw')}
SELECT 'healthy' AS stratum, slot, id FROM {uniform_sql('well', '(SELECT nh FROM n)', 'healthy')} x
UNION ALL SELECT 'pathological', slot, id FROM {weighted_sql('sw', 'weight', '(SELECT np FROM n)', 'pathological')} y""")
def _(spark, sf):
    return P.balanced_mix(_supervised(spark, sf), VOCAB, 0.3, SEED, "weighted").select("stratum", "slot", "id")


@query("c11_balanced_quota", f"""
WITH {_SUPERVISED}, {_QUOTA.format(pool='sick', n='(SELECT np FROM n)')}
SELECT 'healthy' AS stratum, slot, id FROM {uniform_sql('well', '(SELECT nh FROM n)', 'healthy')} x UNION ALL SELECT 'pathological', slot, id FROM quota""")
def _(spark, sf):
    return P.balanced_mix(_supervised(spark, sf), VOCAB, 0.3, SEED, "label_quota").select("stratum", "slot", "id")


_RATIOS = {"healthy": 0.25, "pathological": 0.5, "other": 0.25}
_STAGE = STUDIES + """,
hl AS (SELECT id FROM studies WHERE label_str = 'No Finding'), ot AS (SELECT id FROM studies WHERE label_str = 'Unlabeled'), sk AS (SELECT * FROM studies WHERE label_str NOT IN ('No Finding', 'Unlabeled')),
t AS (SELECT count(*) AS t, {rehearsal} AS nr FROM studies), q AS (SELECT *, t - nr AS m FROM t),
al AS (SELECT name, floor(m * r) AS lo, m * r - floor(m * r) AS frac, m FROM q, (VALUES ('healthy', 0.25), ('pathological', 0.5), ('other', 0.25)) v(name, r)),
n AS (SELECT name, CAST(lo + CASE WHEN row_number() OVER (ORDER BY frac DESC, name DESC) <= m - sum(lo) OVER () THEN 1 ELSE 0 END AS BIGINT) AS c FROM al)"""


def _n(name: str) -> str:
    return f"(SELECT c FROM n WHERE name = '{name}')"


_STAGE_BODY = f"""{_WEIGHTS.format(pool='sk', name='skw')}
SELECT 'healthy' AS stratum, 'report_generation' AS task, slot, id FROM {uniform_sql('hl', _n('healthy'), 'healthy')} x
UNION ALL SELECT 'pathological', 'report_generation', slot, id FROM {weighted_sql('skw', 'weight', _n('pathological'), 'pathological')} y
UNION ALL SELECT 'other', 'report_generation', slot, id FROM {uniform_sql('ot', _n('other'), 'other')} z"""


@query("c12_stage_balanced", f"WITH {_STAGE.format(rehearsal='0')}, {_STAGE_BODY}")
def _(spark, sf):
    s = studies(spark, sf).select("id", "labels")
    return P.stage_mix(s, s, VOCAB, "balanced", SEED, _RATIOS).select("stratum", "task", "slot", "id")


@query("c12_stage_clinical", f"""
WITH {_STAGE.format(rehearsal='CAST(round_even(count(*) * 0.2, 0) AS BIGINT)')}, {_STAGE_BODY}
UNION ALL SELECT 'rehearsal', 'clinical_classification', slot, id FROM {weighted_sql('skw', 'weight', '(SELECT nr FROM t)', 'rehearsal')} r""")
def _(spark, sf):
    s = studies(spark, sf).select("id", "labels")
    labelled = s.where(~F.array_contains("labels", "Unlabeled"))
    return P.stage_mix(s, labelled, VOCAB, "clinical", SEED, _RATIOS, 0.2).select("stratum", "task", "slot", "id")


@query("c12_stage_standard", f"""
WITH {STUDIES} SELECT id, row_number() OVER (ORDER BY id) - 1 AS slot, CASE WHEN label_str = 'No Finding' THEN 'healthy' WHEN label_str = 'Unlabeled' THEN 'other' ELSE 'pathological' END AS stratum FROM studies""")
def _(spark, sf):
    s = studies(spark, sf).select("id", "labels")
    return P.stage_mix(s, s, VOCAB, "standard", SEED).select("id", "slot", "stratum")


@query("a29_mix_statistics", f"""
WITH {_STAGE.format(rehearsal='0')}, {_STAGE_BODY.replace("SELECT 'healthy' AS stratum", ", mix AS (SELECT 'healthy' AS stratum", 1)})
SELECT 'stratum' AS kind, stratum AS value, CAST(count(*) AS BIGINT) AS n FROM mix GROUP BY stratum
UNION ALL SELECT 'label', label, CAST(count(*) AS BIGINT) FROM (SELECT unnest(s.labels) AS label FROM mix JOIN studies s ON s.id = mix.id) GROUP BY label""")
def _(spark, sf):
    s = studies(spark, sf).select("id", "labels")
    return P.mix_statistics(P.stage_mix(s, s, VOCAB, "balanced", SEED, _RATIOS), s)
