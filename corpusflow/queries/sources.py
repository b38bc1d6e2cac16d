"""Sources and sinks: tables written by Spark and read back."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from ..functions.text import squash_ws, text_key
from ..session import cut, scratch_path
from ..sources import merkle as M
from ..sources import readers as R
from ..sources import sinks as W
from . import sqlkit as K
from .fixtures import IMAGED, PAIRS, STUDIES, imaged, joined, pairs, studies, table
from .registry import query


@query("s1_read_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, sf):
    path = scratch_path(spark, "conversations")
    c = table(spark, sf, "conversations")
    # Every line is followed by a blank one.
    c.select(F.concat(F.to_json(F.struct(*c.columns)), F.lit("\n")).alias("value")).write.text(path)
    return R.read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query("s2_read_splits", f"""
WITH {IMAGED} SELECT id, split, lang, array_to_string(['/data/' || p for p in image_path], '|') AS images FROM imaged WHERE split <> 'train'""")
def _(spark, sf):
    path = scratch_path(spark, "splits")
    W.write_splits(imaged(spark, sf).select("id", "split", "lang", F.col("image_path").alias("images")), path)
    df = R.read_splits(spark, path, ["val", "test", "dev"], "id bigint, lang string, images array<string>", "/data")
    return df.select("id", "split", "lang", joined("images").alias("images"))


@query("s3_read_annotation", f"""
WITH {IMAGED} SELECT CAST(id AS VARCHAR) AS id, CASE WHEN lang = 'fr' THEN 'held_out' ELSE split END AS split, findings AS report,
  array_to_string(image_path, '|') AS images FROM imaged""")
def _(spark, sf):
    path = scratch_path(spark, "annotation")
    s = imaged(spark, sf).select(
        F.col("id").cast("string").alias("id"), F.col("split"), F.col("findings").alias("report"), "image_path",
        F.expr("id div 200").alias("shard"), F.when(F.col("lang") == "fr", "held_out").alias("own"),
    )
    records = s.withColumnsRenamed({"split": "key"}).withColumnsRenamed({"own": "split"})
    grouped = records.groupBy("shard", "key").agg(
        F.collect_list(F.struct("id", "report", "image_path", "split")).alias("r")  # at most 200 ids per shard
    )
    grouped.select(F.to_json(F.create_map("key", "r")).alias("value")).write.text(path)
    rows = R.read_annotation(spark, path, "id string, report string, image_path array<string>, split string", whole_file=False)
    return rows.select("id", "split", "report", joined("image_path").alias("images"))


# Characters that XML cannot carry are left out on both sides.
_NO_CONTROL = r"[\x{01}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{FFFE}\x{FFFF}]"


def _clean(c):
    return F.regexp_replace(c, _NO_CONTROL, "")


def _reports(spark, sf):
    """Studies written as XML reports by Spark and read back."""
    path = scratch_path(spark, "reports")
    s = studies(spark, sf)
    image = F.concat(F.lit("CXR"), F.col("id").cast("string"))
    xml = s.select(
        F.struct(F.col("id").cast("string").alias("_id")).alias("uId"),
        F.struct(F.struct(F.struct(F.array(
            F.struct(F.lit("Findings ").alias("_Label"), _clean("findings").alias("_VALUE")),
            F.struct(F.lit("IMPRESSION").alias("_Label"), F.lit("first").alias("_VALUE")),
            F.struct(F.lit("impression").alias("_Label"), _clean("impression").alias("_VALUE")),
        ).alias("AbstractText")).alias("Abstract")).alias("Article")).alias("MedlineCitation"),
        F.struct(F.array(F.lit("Normal"), F.col("source")).alias("major")).alias("MeSH"),
        F.array(
            F.struct(F.concat(image, F.lit("_1")).alias("_id"), F.lit("PA  view").alias("caption")),
            F.struct(F.concat(image, F.lit("_2")).alias("_id"), F.lit("PA view").alias("caption")),
            F.struct(F.lit(None).cast("string").alias("_id"), F.col("lang").alias("caption")),
        ).alias("parentImage"),
    )
    xml.write.format("xml").option("rootTag", "reports").option("rowTag", "eCitation").save(path)
    return R.read_reports_xml(spark, path)


def _xml_text(c: str) -> str:
    return K.squash(f"regexp_replace({c}, '{_NO_CONTROL}', '', 'g')")


@query("s4_read_reports_xml", f"""
WITH {STUDIES} SELECT CAST(id AS VARCHAR) AS uid, {_xml_text('findings')} AS findings, {_xml_text('impression')} AS impression,
  'PA view | ' || lang AS caption, 'CXR' || id || '_1|CXR' || id || '_2' AS images, lower(source) AS tags, 'IMPRESSION|FINDINGS' AS sections FROM studies""")
def _(spark, sf):
    return _reports(spark, sf).select(
        "uid", "findings", "impression", "caption", joined("parent_images").alias("images"), joined("mesh_majors").alias("tags"),
        joined(F.map_keys("sections")).alias("sections"),
    )


@query("s5_extract_sections", f"""
WITH {STUDIES} SELECT CAST(id AS VARCHAR) AS uid, {_xml_text('findings')} AS findings, {_xml_text('impression')} AS impression FROM studies""")
def _(spark, sf):
    return R.extract_sections(_reports(spark, sf)).select("uid", "findings", "impression")


@query("s6_read_translation_csv", f"""
WITH {STUDIES} SELECT CAST(id AS VARCHAR) AS uid, {K.strip('findings')} AS findings, {K.strip('impression')} AS impression,
  CASE WHEN label_str = 'No Finding' THEN 'normal' ELSE lower(replace(label_str, '|', ';')) END AS tags, {K.filled('impression')} AS has_impression FROM studies""")
def _(spark, sf):
    path = scratch_path(spark, "translated")
    tags = F.when(F.col("label_str") == "No Finding", "Normal; normal").otherwise(F.replace("label_str", F.lit("|"), F.lit(" ; ")))
    rows = studies(spark, sf).select(
        F.col("id").cast("string").alias("uid"), F.lit("-").alias("findings"), F.lit("-").alias("impression"),
        F.col("findings").alias("findings_it"), F.col("impression").alias("impression_it"), tags.alias("MeSH"),
    )
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    t = R.read_translation_csv(spark, path)
    f, i = R.report_in("it")
    return t.select("uid", f, i, joined(R.tag_list(F.col("MeSH")), ";").alias("tags")).withColumn("has_impression", F.col("impression") != "")


def png(values, width: int) -> bytes:
    """An 8-bit grey PNG of the pixel rows."""
    rows = [bytes(values[i:i + width]) for i in range(0, len(values), width)]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    data = zlib.compress(b"".join(b"\0" + r for r in rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def _png_files(spark, sf):
    """Embeddings written as 8 x 8 images, one file each, in one folder per label."""
    root = scratch_path(spark, "images")
    level = F.transform("embedding", lambda x: F.floor((F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) + 1) * 127).cast("int"))
    make = F.udf(lambda v: png(v, 8), "binary")
    view = F.when(F.col("vec_id") % 2 == 0, "frontal").otherwise("lateral")
    name = F.concat(F.lit("study"), "label", F.lit("/"), view, F.lit("_"), "vec_id", F.lit(".png"))
    W.save_files(table(spark, sf, "embeddings").select(name.alias("path"), make(level).alias("content")), root)
    return root


@query("s7_list_images", """
WITH f AS (SELECT 'study' || label AS study, CASE WHEN vec_id % 2 = 0 THEN 'frontal_' ELSE 'lateral_' END || vec_id || '.png' AS file, vec_id % 2 AS odd FROM embeddings)
SELECT study, file, CAST(count(*) OVER s AS BIGINT) AS n_files, CAST(count(*) FILTER (odd = 0) OVER s AS BIGINT) AS n_frontal,
  CAST(count(*) FILTER (odd = 1) OVER s AS BIGINT) AS n_lateral, CAST(0 AS BIGINT) AS n_other, min(file) OVER s AS first_file FROM f WINDOW s AS (PARTITION BY study)""")
def _(spark, sf):
    listing = R.list_images(spark, _png_files(spark, sf))
    return listing.select("study", "file").join(R.image_folders(listing), "study")


@query("s8_read_images", """
SELECT 'study' || label AS study, CASE WHEN vec_id % 2 = 0 THEN 'frontal_' ELSE 'lateral_' END || vec_id || '.png' AS file, 'OK' AS state, '8x8x1' AS shape,
  md5(from_hex(array_to_string([lpad(to_hex(CAST(floor((greatest(least(CAST(x AS DOUBLE), 1.0), -1.0) + 1) * 127) AS BIGINT)), 2, '0') for x in embedding], ''))) AS digest
FROM embeddings""")
def _(spark, sf):
    return R.read_images(spark, _png_files(spark, sf)).select("study", "file", "state", "shape", "digest")


_RUNS_SQL = """
runs AS (SELECT user_id, CAST(count(*) AS BIGINT) AS n, max(value) AS best_value, min(ts) AS started, max(ts) AS ended FROM events GROUP BY user_id)"""


@query("s9_read_runs", f"""
WITH {_RUNS_SQL} SELECT 'run_' || user_id AS experiment, n AS n_evaluations, round(best_value, 6) AS best_value, 'mode' || (user_id % 2) AS mode, true AS readable FROM runs WHERE user_id % 10 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, false FROM runs WHERE user_id % 10 = 0""")
def _(spark, sf):
    path = scratch_path(spark, "runs")
    runs = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"))
    doc = F.to_json(F.struct(
        F.concat(F.lit("run_"), "user_id").alias("experiment"), F.col("n").alias("n_evaluations"),
        F.struct(F.col("best").alias("value")).alias("best"),
        F.struct(F.concat(F.lit("mode"), F.col("user_id") % 2).alias("mode")).alias("identity"),
    ))
    # Every tenth document is cut short, as by a crash.
    cut = F.when(F.col("user_id") % 10 == 0, F.substring(doc, F.lit(1), F.length(doc) - 5)).otherwise(doc)
    runs.select(cut.alias("value")).write.text(path)
    schema = "experiment string, n_evaluations bigint, best struct<value:double>, identity struct<mode:string>"
    good, bad = R.read_runs(spark, path, schema, whole_file=False)
    fine = good.select("experiment", "n_evaluations", F.round("best.value", 6).alias("best_value"), "identity.mode", F.lit(True).alias("readable"))
    return fine.unionByName(bad.select(F.lit(False).alias("readable")), allowMissingColumns=True)


@query("s10_read_predictions", f"""
WITH {PAIRS}, p AS (SELECT *, CAST(split_part(id, ':', 2) AS BIGINT) AS step FROM pairs)
SELECT 'exp_b' AS experiment, step, id, reference, prediction FROM p WHERE step >= 2
UNION ALL SELECT 'csv' AS experiment, NULL, id, reference, prediction FROM pairs""")
def _(spark, sf):
    path, table_path = scratch_path(spark, "steps"), scratch_path(spark, "predictions")
    p = pairs(spark, sf).withColumn("step", F.split_part("id", F.lit(":"), F.lit(2)).cast("bigint"))
    docs = p.select(
        F.explode(F.array(F.lit("exp_a"), F.lit("exp_b"))).alias("experiment"), F.col("step").cast("double").alias("epoch"), "step",
        F.array(F.struct("id", "reference", "prediction")).alias("samples"),
    )
    docs.write.json(path)
    steps = R.read_prediction_steps(spark, path, whole_file=False)
    early = p.select("step").distinct().where(F.col("step") < 2)
    fresh = R.select_units(steps, ["exp_b*"], early, ["step"]).select("experiment", "step", "id", "reference", "prediction")
    p.select("id", "reference", "prediction", F.lit("true").alias("has_sep")).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(table_path)
    from_csv = R.read_predictions_csv(spark, table_path).select(
        F.lit("csv").alias("experiment"), F.lit(None).cast("bigint").alias("step"), "id", "reference", "prediction"
    )
    return fresh.unionByName(from_csv)


@query("s10_step_violations", f"""
WITH {PAIRS} SELECT 'unreadable_step' AS rule, '{{"experiment":"' || id || '","samples":' AS text FROM pairs WHERE id LIKE '%3:%'""")
def _(spark, sf):
    path = scratch_path(spark, "steps")
    p = pairs(spark, sf)
    # Documents of some conversations are cut short.
    doc = F.when(p.id.like("%3:%"), F.concat(F.lit('{"experiment":"'), "id", F.lit('","samples":'))).otherwise(
        F.to_json(F.struct(F.col("id").alias("experiment"), F.array(F.struct("id", "reference", "prediction")).alias("samples"))))
    p.select(doc.alias("value")).write.text(path)
    return R.unreadable_steps(spark, path, whole_file=False).select("rule", "text")


@query("s11_read_cache", f"""
SELECT DISTINCT md5({K.squash('text')}) AS key, 'v2' AS translation FROM conversations WHERE {K.filled('text')}""")
def _(spark, sf):
    path = scratch_path(spark, "cache")
    t = table(spark, sf, "conversations").select(text_key(F.col("text")).alias("key"), squash_ws(F.col("text")).alias("source")).where("source <> ''")
    line = [F.to_json(F.struct("key", "source", F.lit(v).alias("translation"))) for v in ("v1", "v2")]
    broken = F.substring(line[1], F.lit(1), F.length(line[1]) - 9)
    # Three lines per text: an older entry, a newer one, and one cut short.
    t.select(F.concat_ws("\n", line[0], line[1], broken).alias("value")).write.text(path)
    return R.read_cache(spark, path).select("key", "translation")


@query("k1_write_splits", f"WITH {STUDIES} SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(report)) AS BIGINT) AS n_chars FROM studies GROUP BY split")
def _(spark, sf):
    path = scratch_path(spark, "split_files")
    W.write_splits(studies(spark, sf).select("id", "split", "report"), path)
    back = spark.read.schema("id bigint, report string, split string").json(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("report")).alias("n_chars"))


def _fingerprint_sql(text: str) -> str:
    limbs = [f"sum(CAST(CAST('0x' || substr(sha256({text}), {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT))" for i in range(4)]
    return "sha256(concat_ws(':', CAST(count(*) AS VARCHAR), " + ", ".join(f"CAST({l} AS VARCHAR)" for l in limbs) + "))"


@query("k2_fingerprint", f"""
SELECT lang, CAST(count(*) AS BIGINT) AS n_rows,
  {_fingerprint_sql("'{{" + '"doc_id":' + "' || doc_id || '," + '"n_chars":' + "' || n_chars || '," + '"source":"' + "' || source || '" + '","text":' + "' || to_json(text) || '" + "}}'")} AS fingerprint FROM documents GROUP BY lang""".replace("{{", "{").replace("}}", "}"))
def _(spark, sf):
    return W.table_fingerprint(table(spark, sf, "documents").select("doc_id", "text", "source", "n_chars", "lang"), ["lang"])


@query("k2_compare_fingerprints", "SELECT DISTINCT lang, 'differs' AS status FROM documents WHERE lang = 'fr' UNION ALL SELECT 'it', 'absent_now' UNION ALL SELECT 'de', 'absent_in_record'")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    now = W.table_fingerprint(d, ["lang"])
    # The record was taken before the French texts changed, without German, and with an Italian part.
    changed = d.withColumn("text", F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text")))
    then = W.table_fingerprint(changed, ["lang"]).withColumn("lang", F.when(F.col("lang") == "de", "it").otherwise(F.col("lang")))
    return W.compare_fingerprints(now, then, "lang").select("lang", "status")


@query("k2_tree_fingerprint", f"SELECT CAST(count(*) AS BIGINT) AS n_rows, {_fingerprint_sql("source || '/' || doc_id || '|' || CASE WHEN octet_length(encode(text)) > 5000 THEN 'size:' || octet_length(encode(text)) ELSE sha256(text) END")} AS fingerprint FROM documents")
def _(spark, sf):
    content = F.encode("text", "UTF-8")
    files = table(spark, sf, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").alias("length"), content.alias("content")
    )
    return W.tree_fingerprint(files, large=5000)


@query("k2_differing_files", """
SELECT source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 50 = 3 THEN '.old' ELSE '.txt' END AS path,
  CASE doc_id % 50 WHEN 1 THEN 'differs' ELSE 'absent_now' END AS status FROM documents WHERE doc_id % 50 IN (1, 2, 3)
UNION ALL SELECT source || '/' || lang || '/' || doc_id || '.txt', 'absent_in_record' FROM documents WHERE doc_id % 50 = 3""")
def _(spark, sf):
    """A folder of texts against the record of an earlier state: a changed last byte, files that went, and renamed ones."""
    root, record = scratch_path(spark, "folder"), scratch_path(spark, "record")
    d = table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("name"), (F.col("doc_id") % 50).alias("kind"), F.encode(F.concat("text", F.lit("\n")), "UTF-8").alias("body"))
    W.save_files(d.where("kind <> 2").select(F.concat("name", F.lit(".txt")).alias("path"), F.col("body").alias("content")), root)
    earlier = F.when(F.col("kind") == 1, F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit("\x01").cast("binary"))).otherwise(F.col("body"))
    name = F.concat("name", F.when(F.col("kind") == 3, ".old").otherwise(".txt"))
    M.write_tree(M.content_tree(M.file_hashes(M.in_chunks(d, name, earlier, 4096))), record)
    now = M.content_tree(M.file_hashes(M.read_chunks(spark, root, chunk_bytes=4096)))
    return M.differing_files(cut(now), M.read_tree(spark, record))


@query("k3_write_guarded", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN event_type <> 'error' THEN value END) AS BIGINT) AS n_value,
  'refused' AS second_write, CAST((SELECT count(*) FROM events) AS BIGINT) AS dry_rows FROM events GROUP BY event_type""")
def _(spark, sf):
    path = scratch_path(spark, "guarded")
    e = table(spark, sf, "events").select("event_type", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value")).alias("value"))
    dry = W.write_guarded(e, path, dry_run=True)
    W.write_guarded(e, path)
    try:
        W.write_guarded(e, path)
        second = "accepted"
    except FileExistsError:
        second = "refused"
    back = spark.read.parquet(path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value")).withColumns(
        {"second_write": F.lit(second), "dry_rows": F.lit(dry).cast("bigint")}
    )


@query("k4_write_ragged_csv", """
SELECT CAST(p_partkey AS VARCHAR) AS k, p_name AS name, NULL AS balance FROM part
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, CAST(s_acctbal AS VARCHAR) FROM supplier""")
def _(spark, sf):
    path = scratch_path(spark, "ragged")
    a = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_name").alias("name"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_acctbal").cast("string").alias("balance"))
    W.write_ragged_csv([a, b], path)
    return spark.read.schema("k string, name string, balance string").option("header", True).option("escape", '"').csv(path)


@query("k5_to_flat_rows", f"""
WITH {STUDIES} SELECT id, split, '["' || array_to_string(labels, '","') || '"]' AS labels, '{{"lang":"' || lang || '","source":"' || source || '"}}' AS origin FROM studies""")
def _(spark, sf):
    return W.to_flat_rows(studies(spark, sf).select("id", "split", "labels", F.struct("lang", "source").alias("origin")))


@query("k6_write_id_lists", f"""
WITH {STUDIES} SELECT 'no_impression' AS list, CAST(id AS VARCHAR) AS id FROM studies WHERE impression = ''
UNION ALL SELECT 'unlabeled', CAST(id AS VARCHAR) FROM studies WHERE label_str = 'Unlabeled'
UNION ALL SELECT 'toxic', CAST(id AS VARCHAR) FROM studies WHERE contains(label_str, 'Toxic')""")
def _(spark, sf):
    path = scratch_path(spark, "lists")
    conditions = {
        "no_impression": F.col("impression") == "", "unlabeled": F.col("label_str") == "Unlabeled",
        "toxic": F.array_contains("labels", "Toxic"),
    }
    W.write_id_lists(studies(spark, sf), "id", conditions, path)
    return spark.read.schema("value string, list string").text(path).select("list", F.col("value").alias("id"))
