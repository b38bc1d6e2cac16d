"""Text, view and scalar functions over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import scalars as S
from ..functions import text as X
from ..functions import views as V
from . import sqlkit as K
from .fixtures import IMAGED, PAIRS, STUDIES, imaged, joined, pairs, r6, studies, table
from .registry import query


@query("p1_squash_ws", f"""
SELECT doc_id AS id, {K.squash('text')} AS squashed, lower({K.squash('text')}) AS lowered FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("id"), X.squash_ws(F.col("text")).alias("squashed"), X.squash_ws(F.col("text"), True).alias("lowered")
    )


@query("p2_alnum_key", f"SELECT doc_id AS id, {K.alnum('text')} AS k FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.alnum_key(F.col("text")).alias("k"))


STUDY_IDS = """
ids AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'CXR' || doc_id || '_IM-' || n_chars WHEN 'fr' THEN 'cxr' || doc_id || '_1'
  WHEN 'de' THEN 'CXR' || doc_id ELSE source || '_' || doc_id END AS name FROM documents)"""


def _study_ids(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id").cast("string")
    name = (
        F.when(F.col("lang") == "en", F.concat(F.lit("CXR"), i, F.lit("_IM-"), F.col("n_chars").cast("string")))
        .when(F.col("lang") == "fr", F.concat(F.lit("cxr"), i, F.lit("_1")))
        .when(F.col("lang") == "de", F.concat(F.lit("CXR"), i))
        .otherwise(F.concat(F.col("source"), F.lit("_"), i))
    )
    return d.select("doc_id", name.alias("name"))


@query("p3_study_key", f"""
WITH {STUDY_IDS}
SELECT doc_id, name, split_part(name, '_', 1) AS k_prefix, replace(split_part(name, '_', 1), 'CXR', '') AS k_number,
  nullif(regexp_extract(name, '^CXR([0-9]+)_', 1), '') AS k_strict,
  upper(coalesce(nullif(regexp_extract(name, '(?i)^(CXR[0-9]+)', 1), ''), name)) AS k_patient,
  CASE WHEN regexp_matches(name, '^CXR[0-9]+_') THEN 'OK' ELSE 'BAD_ID' END AS id_state
FROM ids""")
def _(spark, sf):
    n = F.col("name")
    keys = {f"k_{r}": X.study_key(n, r) for r in X.STUDY_KEY_RULES}
    out = _study_ids(spark, sf).withColumns(keys)
    return out.withColumn("id_state", F.when(F.col("k_strict").isNull(), "BAD_ID").otherwise("OK"))


_FRONT = "(" + K.whole_word("c", "pa|ap|frontal|postero-?anterior|antero-?posterior") + rf" OR regexp_matches(c, '(?i)(^|{K.NOT_WORD})(p\.a\.|a\.p\.){K.WORD}'))"
_SIDE = K.whole_word("c", "lateral|lat|decubitus|oblique")
_TWO = K.whole_word("c", r"(2|two|ii)\s*-?\s*(v|view|views)")


def _flag(own: str) -> str:
    return f"CASE WHEN c = '' THEN 'unknown' WHEN {_TWO} THEN 'yes' WHEN NOT ({_FRONT} OR {_SIDE}) THEN 'unknown' WHEN {own} THEN 'yes' ELSE 'no' END"


CAPTIONS = STUDIES + """,
captions AS (SELECT id, CASE label_str WHEN 'No Finding' THEN 'PA and lateral' WHEN 'LowQuality' THEN 'frontal view, ' || findings
  WHEN 'Toxic' THEN 'Chest 2 views' WHEN 'Unlabeled' THEN findings ELSE 'lat. decubitus' END AS c FROM studies)"""


def _captions(spark, sf):
    l = F.col("label_str")
    c = (
        F.when(l == "No Finding", "PA and lateral").when(l == "LowQuality", F.concat(F.lit("frontal view, "), F.col("findings")))
        .when(l == "Toxic", "Chest 2 views").when(l == "Unlabeled", F.col("findings")).otherwise("lat. decubitus")
    )
    return studies(spark, sf).select("id", c.alias("c"))


def _tri(c):
    return F.when(c.isNull(), "unknown").when(c, "yes").otherwise("no")


@query("p4_caption_views", f"WITH {CAPTIONS} SELECT id, {_flag(_FRONT)} AS frontal, {_flag(_SIDE)} AS lateral FROM captions")
def _(spark, sf):
    v = V.caption_views(F.col("c"))
    return _captions(spark, sf).select("id", _tri(v.frontal).alias("frontal"), _tri(v.lateral).alias("lateral"))


@query("p5_view_of", f"""
WITH {IMAGED}, files AS (SELECT id, unnest(image_path) AS path FROM imaged)
SELECT id, path, {K.view_of('path')} AS view,
  CASE WHEN contains(lower({K.base_name('path')}), 'frontal') AND contains(lower({K.base_name('path')}), 'lateral') THEN 'ambiguous'
       WHEN ({K.view_of('path')}) IS NULL THEN 'none' END AS reason FROM files""")
def _(spark, sf):
    p = F.col("path")
    return imaged(spark, sf).select("id", F.explode("image_path").alias("path")).select(
        "id", "path", V.view_of(p).alias("view"), V.view_reason(p).alias("reason")
    )


@query("p6_classify_views", f"""
WITH {IMAGED}, counted AS (
  SELECT id, len(image_path) AS n, {K.n_view('image_path', 'frontal')} AS n_frontal, {K.n_view('image_path', 'lateral')} AS n_lateral,
         {K.n_view('image_path', 'unknown')} AS n_unknown FROM imaged)
SELECT id, n_frontal, n_lateral, n_unknown, CASE WHEN n_unknown > 0 THEN 'UNCLASSIFIED' WHEN n_frontal = 1 AND n_lateral = 1 THEN 'OK'
  WHEN n <> 2 THEN 'WRONG_COUNT' WHEN n_frontal = 2 OR n_lateral = 2 THEN 'SAME_VIEW' WHEN n_frontal = 0 THEN 'MISSING_FRONTAL'
  WHEN n_lateral = 0 THEN 'MISSING_LATERAL' ELSE 'DUPLICATE_VIEW' END AS status FROM counted""")
def _(spark, sf):
    return imaged(spark, sf).select("id", V.classify_views(F.col("image_path")).alias("v")).select("id", "v.*")


PAIR_SQL = f"""CASE WHEN files IS NULL THEN 'DIR_MISSING' WHEN len(files) <> 2 THEN 'OTHER'
  WHEN {K.n_view('files', 'frontal')} = 2 THEN 'FRONTAL_PAIR' WHEN {K.n_view('files', 'lateral')} = 2 THEN 'LATERAL_PAIR'
  WHEN {K.n_view('files', 'frontal')} = 1 AND {K.n_view('files', 'lateral')} = 1 THEN 'MIXED_PAIR' ELSE 'OTHER' END"""


@query("p7_classify_pair", f"""
WITH {IMAGED}, folders AS (SELECT s.id, CASE WHEN s.lang = 'es' THEN NULL ELSE s.image_path END AS files FROM imaged s)
SELECT id, {PAIR_SQL} AS pair FROM folders""")
def _(spark, sf):
    # Spanish studies have no folder.
    files = F.when(F.col("lang") != "es", F.col("image_path"))
    return imaged(spark, sf).select("id", V.classify_pair(files).alias("pair"))


SECTION_TEXT = """CASE label_str WHEN 'Toxic' THEN 'N/A - XXXX' WHEN 'LowQuality' THEN 'none.' WHEN 'LowQuality|Toxic' THEN NULL ELSE impression END"""


@query("p8_section_status", f"""
WITH {STUDIES}, t AS (SELECT id, label_str <> 'LowQuality|Toxic' AS tagged, {K.strip(f"coalesce({SECTION_TEXT}, '')")} AS x FROM studies)
SELECT id, CASE WHEN NOT tagged THEN 'MISSING_TAG' WHEN x = '' THEN 'EMPTY'
  WHEN len([w for w in {K.words("trim(regexp_replace(lower(x), '[^a-z0-9/]+', ' ', 'g'))")} if NOT regexp_matches(w, '^(none|n/?a|xxxx|[.]|-|_)+$')]) = 0
  THEN 'PLACEHOLDER' ELSE 'OK' END AS status FROM t""")
def _(spark, sf):
    l = F.col("label_str")
    text = F.when(l == "Toxic", "N/A - XXXX").when(l == "LowQuality", "none.").otherwise(F.col("impression"))
    both = F.create_map(F.lit("FINDINGS"), F.col("findings"), F.lit("IMPRESSION"), text)
    sections = F.when(l == "LowQuality|Toxic", F.create_map(F.lit("FINDINGS"), F.col("findings"))).otherwise(both)
    return studies(spark, sf).select("id", X.section_status(sections, "IMPRESSION").alias("status"))


@query("p9_placeholder_only", f"""
WITH {STUDIES}, t AS (SELECT id, CASE label_str WHEN 'Toxic' THEN 'XXXX, XXXX.' ELSE impression END AS x FROM studies)
SELECT id, NOT regexp_matches(replace(x, 'XXXX', ' '), '[\\p{{L}}\\p{{N}}]') AS placeholder FROM t""")
def _(spark, sf):
    x = F.when(F.col("label_str") == "Toxic", "XXXX, XXXX.").otherwise(F.col("impression"))
    return studies(spark, sf).select("id", X.is_placeholder_only(x).alias("placeholder"))


# Messages of a pair as they arrive: JSON text with a list content for the user.
def _chats(spark, sf):
    p = pairs(spark, sf)
    image = F.concat(F.lit("scans/"), F.replace("id", F.lit(":"), F.lit("_")), F.lit(".png"))
    none = F.lit(None).cast("string")
    parts = F.to_json(F.array(
        F.struct(F.lit("image").alias("type"), image.alias("image"), none.alias("text")),
        F.struct(F.lit("text").alias("type"), none.alias("image"), F.col("reference").alias("text")),
    ))
    listed = F.to_json(F.array(F.col("prediction"), F.lit("End.")))
    answer = F.when(F.length("prediction") % 2 == 0, F.col("prediction")).otherwise(listed)
    chat = F.to_json(F.array(
        F.struct(F.lit("system").alias("role"), F.lit("Be brief.").alias("content")),
        F.struct(F.lit("user").alias("role"), parts.alias("content")),
        F.struct(F.lit("assistant").alias("role"), answer.alias("content")),
    ))
    return p.withColumn("messages", M.parse_messages(chat))


_ANSWER = "CASE WHEN length(prediction) % 2 = 0 THEN prediction ELSE prediction || chr(10) || 'End.' END"


@query("p11_message_text", f"""
WITH {PAIRS} SELECT id, 'Be brief.' AS system_text, reference AS user_text, {_ANSWER} AS assistant_text, '' AS tool_text FROM pairs""")
def _(spark, sf):
    m = F.col("messages")
    return _chats(spark, sf).select(
        "id", M.message_text(m, "system").alias("system_text"), M.message_text(m, "user").alias("user_text"),
        M.message_text(m, "assistant").alias("assistant_text"), M.message_text(m, "tool").alias("tool_text"),
    )


@query("p12_reference_and_images", f"""
WITH {PAIRS} SELECT id, CASE WHEN contains(reference, 'the') THEN reference ELSE {_ANSWER} END AS ref_text,
  CASE WHEN length(reference) % 3 = 0 THEN 'a.png|b.png' WHEN length(reference) % 3 = 1 THEN 'c.png'
       ELSE 'scans/' || replace(id, ':', '_') || '.png' END AS image_list FROM pairs""")
def _(spark, sf):
    n = F.length("reference") % 3
    given = F.when(n == 0, '["a.png","b.png",""]').when(n == 1, "c.png")
    override = F.when(F.contains("reference", F.lit("the")), F.col("reference")).otherwise("  ")
    c = _chats(spark, sf)
    return c.select(
        "id", M.reference_text(override, F.col("messages")).alias("ref_text"),
        joined(M.image_paths(given, F.col("messages"))).alias("image_list"),
    )


@query("p13_resolve_paths", f"""
WITH {PAIRS} SELECT id, '/data/root/a/' || id || '|/abs/' || id AS paths,
  '/data/root/scans/' || replace(id, ':', '_') || '.png' AS in_messages FROM pairs""")
def _(spark, sf):
    listed = F.array(F.concat(F.lit("a/"), "id"), F.concat(F.lit("/abs/"), "id"))
    moved = M.resolve_message_paths(F.col("messages"), "/data/root/")
    return _chats(spark, sf).select(
        "id", joined(M.resolve_paths(listed, "/data/root")).alias("paths"),
        joined(M.image_paths(F.lit(None).cast("string"), moved)).alias("in_messages"),
    )


_BOTH = f"'Findings:' || chr(10) || {K.strip('findings')} || chr(10) || '<SEP>' || chr(10) || 'Impression:' || chr(10) || {K.strip('impression')}"


@query("p14_format_target", f"""
WITH {STUDIES} SELECT id, 'Findings:' || chr(10) || {K.strip('findings')} AS one, {_BOTH} AS two FROM studies""")
def _(spark, sf):
    f, i = F.col("findings"), F.col("impression")
    return studies(spark, sf).select(
        "id", X.format_target(f, i, "findings").alias("one"), X.format_target(f, i, "findings_impression").alias("two")
    )


_HEADER = f"regexp_replace({K.strip('{x}')}, '(?i)^(findings|impression|reperti|impressione)\\s*:\\s*', '')"


def _bare(x: str) -> str:
    return K.strip(_HEADER.replace("{x}", x))


_SPLIT_INPUT = STUDIES + f""",
inputs AS (SELECT id, CASE lang WHEN 'en' THEN {_BOTH} WHEN 'fr' THEN 'Findings: ' || findings || ' IMPRESSION : ' || impression
  ELSE report END AS x FROM studies),
marks AS (SELECT id, x, position('<SEP>' IN x) AS s, regexp_extract(x, '(?i)(impression|impressione)\\s*:', 0) AS h FROM inputs),
cuts AS (SELECT id, x, s, CASE WHEN h <> '' THEN position(h IN x) ELSE 0 END AS p FROM marks)"""


def _split_inputs(spark, sf):
    f, i = F.col("findings"), F.col("impression")
    return studies(spark, sf).select(
        "id",
        F.when(F.col("lang") == "en", X.format_target(f, i, "findings_impression"))
        .when(F.col("lang") == "fr", F.concat(F.lit("Findings: "), f, F.lit(" IMPRESSION : "), i))
        .otherwise(F.col("report")).alias("x"),
    )


@query("p15_split_sections", f"""
WITH {_SPLIT_INPUT}
SELECT id, {_bare("CASE WHEN s > 0 THEN substring(x, 1, s - 1) WHEN p > 0 THEN substring(x, 1, p - 1) ELSE x END")} AS findings,
  CASE WHEN s > 0 THEN {_bare("substring(x, s + 5)")} WHEN p > 0 THEN {_bare("substring(x, p)")} END AS impression FROM cuts""")
def _(spark, sf):
    return _split_inputs(spark, sf).select("id", X.split_sections(F.col("x")).alias("s")).select("id", "s.*")


@query("p16_strip_blocks", f"""
WITH {STUDIES} SELECT id, {K.strip("findings || ' ' || impression")} AS text FROM studies""")
def _(spark, sf):
    raw = F.concat(F.lit("<think>"), "report", F.lit("</think>\n"), "findings", F.lit(" <think>a\nb</think>  "), "impression")
    return studies(spark, sf).select("id", X.strip_blocks(raw).alias("text"))


@query("p17_build_record", f"""
WITH {IMAGED} SELECT CAST(id AS VARCHAR) AS id, 'system|user|assistant' AS roles, findings AS target, len(image_path) AS n_parts,
  array_to_string([coalesce({K.view_of('p')}, 'unknown') for p in image_path], '+') AS projection,
  label_str AS labels, 'report_generation' AS task_type, lang AS target_lang FROM imaged""")
def _(spark, sf):
    r = M.build_record(
        F.col("id"), F.col("image_path"), F.col("labels"), F.col("findings"), F.lit("sys"), F.lit("ask"),
        source_lang=F.lit("en"), target_lang=F.col("lang"),
    )
    return imaged(spark, sf).select(r.alias("r")).select(
        "r.id", joined(F.transform("r.messages", lambda m: m.role)).alias("roles"),
        M.message_text(F.col("r.messages"), "assistant").alias("target"),
        F.size(F.filter(F.get("r.messages", F.lit(1)).content_parts, lambda p: p.type == "image")).alias("n_parts"),
        "r.factors.projection", joined(F.col("r.factors.diagnostic_category")).alias("labels"),
        "r.factors.task_type", "r.provenance.target_lang",
    )


@query("p18_select_images", f"""
WITH {IMAGED}, s AS (SELECT id, list_sort([{K.base_name('p')} for p in image_path]) AS names FROM imaged)
SELECT id, array_to_string(names, '|') AS all_names, array_to_string([coalesce({K.view_of('p')}, 'unknown') for p in names], '|') AS all_views,
  coalesce([p for p in names if coalesce(({K.view_of('p')}) = 'frontal', false)][1], '') AS first_frontal FROM s""")
def _(spark, sf):
    both, one = (V.select_images(F.col("image_path"), m) for m in ("frontal_lateral", "frontal"))
    return imaged(spark, sf).select(
        "id", joined(both.names).alias("all_names"), joined(both["views"]).alias("all_views"), joined(one.names).alias("first_frontal")
    )


@query("p19_order_pair", f"""
WITH {IMAGED}, flipped AS (SELECT id, CASE WHEN source < 'src15' THEN list_reverse(image_path) ELSE image_path END AS image_path FROM imaged),
o AS (SELECT id, image_path AS p0, [p for p in image_path if coalesce(({K.view_of('p')}) = 'frontal', false)] AS f,
  [p for p in image_path if coalesce(({K.view_of('p')}) = 'lateral', false)] AS l FROM flipped)
SELECT id, array_to_string(CASE WHEN len(p0) = 2 AND len(f) = 1 AND len(l) = 1 THEN list_concat(f, l) ELSE p0 END, '|') AS paths,
  CASE WHEN NOT (len(p0) = 2 AND len(f) = 1 AND len(l) = 1) THEN 'NOT_ORDERABLE' WHEN list_concat(f, l) = p0 THEN 'ALREADY_OK' ELSE 'REORDERED' END AS state
FROM o""")
def _(spark, sf):
    flipped = F.when(F.col("source") < "src15", F.reverse("image_path")).otherwise(F.col("image_path"))
    return imaged(spark, sf).select("id", V.order_pair(flipped).alias("o")).select("id", joined("o.paths").alias("paths"), "o.state")


@query("p23_experiment_identity", """
WITH paths AS (SELECT doc_id AS id, lang, CASE WHEN n_chars % 2 = 0 THEN 'Large-3-XL-2B-Instruct' ELSE 'Small' END AS model,
  CASE WHEN source < 'src15' THEN 'lora' ELSE 'baseline' END AS mode, CASE lang WHEN 'en' THEN 'set_FL-FI' ELSE 'set_F-F' END AS data FROM documents),
p AS (SELECT *, CASE WHEN model = 'Small' THEN 'Small' ELSE '2B' END AS short, split_part(data, '_', 2) AS code FROM paths)
SELECT id, lang, short AS model_short, mode, code, CASE code WHEN 'FL-FI' THEN 'frontal_lateral' ELSE 'frontal' END AS views,
  CASE code WHEN 'FL-FI' THEN 'findings_impression' ELSE 'findings' END AS target,
  CASE WHEN mode = 'baseline' THEN concat_ws('_', lang, short, code) ELSE concat_ws('_', lang, short, mode, code) END AS name,
  mode = 'baseline' AS is_baseline, concat_ws('/', 'training', lang, model, 'baseline', data) AS baseline_path FROM p""")
def _(spark, sf):
    from ..operators.runs import experiment_identity

    d = table(spark, sf, "documents")
    model = F.when(F.col("n_chars") % 2 == 0, "Large-3-XL-2B-Instruct").otherwise("Small")
    mode = F.when(F.col("source") < "src15", "lora").otherwise("baseline")
    data = F.when(F.col("lang") == "en", "set_FL-FI").otherwise("set_F-F")
    path = F.concat_ws("/", F.lit("/work/training/x/training"), "lang", model, mode, data, F.lit("results/results.json"))
    return d.select(F.col("doc_id").alias("id"), experiment_identity(path).alias("i")).select(
        "id", "i.lang", "i.model_short", "i.mode", "i.code", "i.views", "i.target", "i.name", "i.is_baseline", "i.baseline_path"
    )


@query("p24_flatten_columns", f"""
WITH {STUDIES} SELECT id AS "run.id", split AS "run.config.split", lang AS "run.config.lang",
  array_to_string(labels, '; ') AS "run.labels" FROM studies""")
def _(spark, sf):
    from ..operators.selection import flatten_columns

    nested = studies(spark, sf).select(F.struct("id", F.struct("split", "lang").alias("config"), "labels").alias("run"))
    return flatten_columns(nested)


@query("p29_report_text", f"""
WITH {STUDIES} SELECT id, concat_ws(' ', nullif({K.strip('findings')}, ''), nullif({K.strip('impression')}, '')) AS plain,
  CASE WHEN {K.filled('findings')} THEN findings WHEN {K.filled('report')} THEN report ELSE '' END AS shown_findings,
  CASE WHEN {K.filled('findings')} OR {K.filled('impression')} THEN concat_ws(chr(10),
    'Findings: ' || CASE WHEN {K.filled('findings')} THEN findings END, 'Impression: ' || CASE WHEN {K.filled('impression')} THEN impression END)
    ELSE report END AS shown_both FROM studies""")
def _(spark, sf):
    f, i, r = F.col("findings"), F.col("impression"), F.col("report")
    return studies(spark, sf).select(
        "id", X.report_text(f, i).alias("plain"), X.display_text(f, i, r, "findings").alias("shown_findings"),
        X.display_text(f, i, r, "both").alias("shown_both"),
    )


@query("p30_build_llm_requests", f"""
WITH {STUDIES} SELECT id, CAST(id AS VARCHAR) AS custom_id, 'model-a' AS model, 512 AS max_tokens, findings AS report, impression, 3 AS n_enum FROM studies""")
def _(spark, sf):
    body = M.build_llm_request(
        F.col("id"), F.col("findings"), F.col("impression"), "model-a", "Label the report.", 512, ("LowQuality", "Toxic", "No Finding")
    )
    schema = (
        "custom_id string, params struct<model:string,max_tokens:int,messages:array<struct<role:string,content:string>>,"
        "output_config:struct<format:struct<schema:struct<properties:struct<diagnostic_label:struct<items:struct<enum:array<string>>>>>>>>"
    )
    r = studies(spark, sf).select("id", F.from_json(body, schema).alias("r"))
    texts = F.from_json(F.get("r.params.messages", F.lit(0)).content, "report string, impression string")
    return r.select(
        "id", "r.custom_id", "r.params.model", "r.params.max_tokens", texts.alias("t"),
        F.size("r.params.output_config.format.schema.properties.diagnostic_label.items.enum").alias("n_enum"),
    ).select("id", "custom_id", "model", "max_tokens", "t.report", "t.impression", "n_enum")


@query("p33_select_first_and_globs", """
SELECT doc_id AS id, source FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100)
WHERE regexp_matches(source, '^src1.*$') OR regexp_matches(source, '^s..2$') OR regexp_matches(source, '^src[3-5]$') OR regexp_matches(source, '^src[^0-7]$')""")
def _(spark, sf):
    from ..operators.selection import first_n

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    first = first_n(d, [F.desc("n_chars"), "id"], 100)
    return first.where(X.glob_match(F.col("source"), ["src1*", "s??2", "src[3-5]", "src[!0-7]"])).select("id", "source")


_TA, _TB = K.tokens("a"), K.tokens("b")


@query("f1_text_match", f"""
WITH {STUDIES}, s AS (SELECT id, findings AS a, impression AS b FROM studies),
k AS (SELECT id, a, {K.alnum('a')} AS ka, {K.alnum('b')} AS kb, list_distinct({_TA}) AS ta, list_distinct({_TB}) AS tb FROM s),
n AS (SELECT *, len(list_intersect(ta, tb)) AS i, len(ta) + len(tb) - len(list_intersect(ta, tb)) AS u FROM k),
m AS (SELECT *, CASE WHEN u = 0 THEN 1.0 ELSE i / u END AS j, CASE WHEN u = 0 THEN 1.0 WHEN len(ta) = 0 THEN 0.0 ELSE i / len(ta) END AS c FROM n)
SELECT id, CASE WHEN a = '' THEN 'NO_SOURCE' WHEN ka = kb THEN 'EXACT' WHEN ka <> '' AND contains(kb, ka) THEN 'SUBSET'
  WHEN j >= 0.9 THEN 'NEAR' WHEN j >= 0.5 THEN 'PARTIAL' ELSE 'MISMATCH' END AS status,
  round(CASE WHEN a = '' THEN 0.0 ELSE j END, 6) AS jaccard, round(CASE WHEN a = '' THEN 0.0 ELSE c END, 6) AS coverage FROM m""")
def _(spark, sf):
    m = X.text_match(F.col("findings"), F.col("impression"))
    return r6(studies(spark, sf).select("id", m.alias("m")).select("id", "m.*"), "jaccard", "coverage")


@query("f2_sentences", f"""
SELECT doc_id AS id, CAST(len(s) AS BIGINT) AS n, array_to_string(s, '|') AS sentences FROM (SELECT doc_id, {K.sentences_sql('text')} AS s FROM documents)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.sentences(F.col("text")).alias("s"))
    return d.select("id", F.size("s").alias("n"), joined("s").alias("sentences"))


_GAP = chr(0xE002)
_CLAUSES = rf"""[p for p in string_split(regexp_replace({K.strip('text')}, '([.;:!?])[{K.SPACE}]+', '\1{_GAP}', 'g'), '{_GAP}') if p <> '']"""


@query("f3_pack_chunks", f"""
WITH RECURSIVE pieces AS (
  SELECT conv_id, turn, unnest(c) AS piece, generate_subscripts(c, 1) AS i FROM (SELECT conv_id, turn, {_CLAUSES} AS c FROM conversations)),
sized AS (SELECT *, len({K.words(K.squash('piece'))}) AS n FROM pieces),
packed AS (
  SELECT conv_id, turn, i, piece, 1 AS chunk, n AS used FROM sized WHERE i = 1
  UNION ALL
  SELECT s.conv_id, s.turn, s.i, s.piece, CASE WHEN p.used + s.n > 25 THEN p.chunk + 1 ELSE p.chunk END,
         CASE WHEN p.used + s.n > 25 THEN s.n ELSE p.used + s.n END
  FROM packed p JOIN sized s ON s.conv_id = p.conv_id AND s.turn = p.turn AND s.i = p.i + 1)
SELECT conv_id, turn, CAST(chunk AS BIGINT) AS chunk, string_agg(piece, ' ' ORDER BY i) AS text FROM packed GROUP BY conv_id, turn, chunk""")
def _(spark, sf):
    chunks = X.pack_chunks(X.clauses(F.col("text")), 25)
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(chunks).alias("i", "text"))
    return c.select("conv_id", "turn", (F.col("i") + 1).cast("bigint").alias("chunk"), "text")


@query("f4_ngrams", f"""
WITH t AS (SELECT doc_id, {K.tokens('text')} AS w FROM documents),
g AS (SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS gram FROM t)
SELECT doc_id AS id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT gram) AS BIGINT) AS n_distinct, min(gram) AS first_gram FROM g GROUP BY doc_id""")
def _(spark, sf):
    grams = X.ngrams(X.key_tokens(F.col("text")), 3)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), grams.alias("g")).where(F.size("g") > 0)
    return d.select("id", F.size("g").alias("n"), F.size(F.array_distinct("g")).alias("n_distinct"), F.array_min("g").alias("first_gram"))


@query("f7_text_key", f"SELECT doc_id AS id, md5({K.squash('text')}) AS k, 'sha256:' || sha256(text) AS content FROM documents")
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.text_key(t).alias("k"), X.content_hash(t).alias("content"))


@query("f8_finite_or_null", """
SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN NULL ELSE value END AS value, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS other FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    bad = F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") == "click", float("-inf")).otherwise(F.col("value"))
    other = F.when(F.col("event_type") == "error", float("inf")).otherwise(F.col("value"))
    return S.finite_frame(e.select("event_id", bad.alias("value"), other.alias("other")))


@query("f9_string_functions", f"""
SELECT page_id, {K.base_name("split_part(url, '?', 1)")} AS base,
  regexp_replace({K.base_name("split_part(url, '?', 1)")}, '([^.])\\.[^.]*\\z', '\\1') AS stem,
  lower(url) AS low, upper(split_part(url, '/', 4)) AS up, lpad(CAST(page_id AS VARCHAR), 6, '0') AS padded,
  starts_with(url, 'http:') AS plain_http, regexp_extract(url, 'page=([0-9]+)', 1) AS page FROM pages""")
def _(spark, sf):
    bare = F.split_part("url", F.lit("?"), F.lit(1))
    return table(spark, sf, "pages").select(
        "page_id", X.base_name(bare).alias("base"), X.file_stem(bare).alias("stem"), F.lower("url").alias("low"),
        F.upper(F.split_part("url", F.lit("/"), F.lit(4))).alias("up"), F.lpad(F.col("page_id").cast("string"), 6, "0").alias("padded"),
        F.startswith("url", F.lit("http:")).alias("plain_http"), F.regexp_extract("url", "page=([0-9]+)", 1).alias("page"),
    )


@query("f10_array_functions", f"""
WITH t AS (SELECT doc_id, {K.tokens('text')} AS w FROM documents)
SELECT doc_id AS id, array_to_string(list_sort(list_distinct(w))[1:5], '|') AS first_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct,
  list_contains(w, 'the') AS has_the, CAST(coalesce(list_position(w, 'the'), 0) AS BIGINT) AS at_the,
  CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS n_letters, CAST(len([x for x in w if length(x) > 7]) AS BIGINT) AS n_long,
  coalesce(w[3], 'none') AS third FROM t""")
def _(spark, sf):
    w = F.col("w")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.key_tokens(F.col("text")).alias("w"))
    return d.select(
        "id", joined(F.slice(F.array_sort(F.array_distinct(w)), 1, 5)).alias("first_words"), F.size(F.array_distinct(w)).alias("n_distinct"),
        F.array_contains(w, "the").alias("has_the"), F.array_position(w, "the").alias("at_the"),
        F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("n_letters"),
        F.size(F.filter(w, lambda x: F.length(x) > 7)).alias("n_long"), F.coalesce(F.get(w, F.lit(2)), F.lit("none")).alias("third"),
    )


@query("f11_math_functions", """
SELECT event_id, CAST(floor(value) AS BIGINT) AS lo, CAST(ceil(value) AS BIGINT) AS hi, round(sqrt(value), 6) AS root, round(ln(1 + value), 6) AS log1,
  round_even(floor(value) / 2.0, 0) AS half_even, least(value, 5.0) AS capped, greatest(value, 5.0) AS floored,
  round(CASE WHEN user_id = 0 THEN 0.0 ELSE value / user_id END, 6) AS per_user FROM events""")
def _(spark, sf):
    v, five = F.col("value"), F.lit(5.0)
    return table(spark, sf, "events").select(
        "event_id", F.floor(v).alias("lo"), F.ceil(v).alias("hi"), F.round(F.sqrt(v), 6).alias("root"), F.round(F.log(1 + v), 6).alias("log1"),
        F.bround(F.floor(v) / 2.0, 0).alias("half_even"), F.least(v, five).alias("capped"), F.greatest(v, five).alias("floored"),
        F.round(S.ratio(v, F.col("user_id")), 6).alias("per_user"),
    )


@query("f12_json_functions", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS packed FROM events""")
def _(spark, sf):
    from ..operators.selection import parse_json_field

    # Error events carry truncated JSON.
    raw = F.when(F.col("event_type") == "error", F.expr("substring(props, 1, 4)")).otherwise(F.col("props"))
    return table(spark, sf, "events").select(
        "event_id", parse_json_field(raw, "k bigint").k.alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("packed")
    )


@query("f13_date_functions", """
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS hours FROM events GROUP BY user_id""")
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    e = table(spark, sf, "events").select("user_id", S.parse_iso(iso).alias("t"))
    g = e.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    show = "yyyy-MM-dd HH:mm:ss"
    return g.select(
        "user_id", F.date_format("a", show).alias("first_ts"), F.date_format("b", show).alias("last_ts"),
        F.round(S.hours_between(F.col("a"), F.col("b")), 6).alias("hours"),
    )
