"""Readers and writers on small files, with broken ones among them."""

import json

import pytest
from pyspark.sql import functions as F

from corpusflow.queries.sources import png
from corpusflow.sources import readers as R
from corpusflow.sources import sinks as W

REPORT = """<eCitation><uId id="{uid}"/><MedlineCitation><Article><Abstract>
<AbstractText Label="FINDINGS">{text}</AbstractText><AbstractText Label="IMPRESSION"/></Abstract></Article></MedlineCitation>
<MeSH><major>Normal</major></MeSH><parentImage id="CXR1_1"><caption>PA  view</caption></parentImage></eCitation>"""


def test_xml_reports(spark, tmp_path):
    (tmp_path / "7.xml").write_text(REPORT.format(uid="CXR7", text="Heart\n is  fine."))
    (tmp_path / "8.xml").write_text(REPORT.replace('<uId id="{uid}"/>', "").format(text="x"))
    (tmp_path / "9.xml").write_text(REPORT.format(uid="CXR9", text="cut")[:150])
    rows = {r.uid: r for r in R.read_reports_xml(spark, str(tmp_path / "*.xml")).collect()}
    assert set(rows) == {"CXR7", "8"}
    r = rows["CXR7"]
    assert (r.report_file, r.findings, r.impression, r.caption, r.parent_images, r.mesh_majors) == ("7.xml", "Heart is fine.", "", "PA view", ["CXR1_1"], ["normal"])
    assert r.sections == {"FINDINGS": "Heart is fine.", "IMPRESSION": ""}
    with pytest.raises(Exception):
        R.read_reports_xml(spark, str(tmp_path / "*.xml"), malformed="raise").collect()


def test_annotation_object(spark, tmp_path):
    doc = {"train": [{"id": "a", "report": "x"}, {"id": "b", "report": "y", "split": "val"}], "test": []}
    (tmp_path / "annotation.json").write_text(json.dumps(doc, indent=1))
    rows = R.read_annotation(spark, str(tmp_path / "annotation.json"), "id string, report string, split string").collect()
    assert sorted((r.id, r.split) for r in rows) == [("a", "train"), ("b", "val")]


def test_annotation_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "train" if i % 2 else "test", f"t{i}") for i in range(30)], "id int, split string, report string")
    path = str(tmp_path / "shards")
    W.write_annotation(df, path, ["id", "report"], F.expr("id div 7"))
    back = R.read_annotation(spark, path, "id int, report string", whole_file=False)
    assert sorted(map(tuple, back.select("id", "split", "report").collect())) == sorted(map(tuple, df.collect()))


def test_images(spark, tmp_path):
    for name, body in (("s1/frontal.png", png([0, 50, 100, 200], 2)), ("s1/lateral.png", png([1, 2, 3, 4], 2)), ("s2/frontal_lateral.png", b"not an image")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "s2" / "notes.txt").write_text("x")
    folders = {r.study: r for r in R.image_folders(R.list_images(spark, str(tmp_path))).collect()}
    assert [tuple(folders[s][f"n_{k}"] for k in ("files", "frontal", "lateral", "other")) for s in ("s1", "s2")] == [(2, 1, 1, 0), (1, 0, 0, 1)]
    rows = {r.file: r for r in R.read_images(spark, str(tmp_path)).collect()}
    assert (rows["frontal.png"].state, rows["frontal.png"].shape, bytes(rows["frontal.png"].data)) == ("OK", "2x2x1", bytes([0, 50, 100, 200]))
    assert (rows["frontal_lateral.png"].state, rows["frontal_lateral.png"].digest) == ("UNREADABLE", None)


def test_a_large_folder_keeps_its_record(spark, tmp_path):
    from corpusflow.operators.joins import reconcile3
    from corpusflow.plans.curation import drop_same_view_pairs, extract_recoverable

    (tmp_path / "s1").mkdir()
    for i in range(70):
        (tmp_path / "s1" / f"lateral_{i}.png").write_bytes(b"x")
    listing = R.list_images(spark, str(tmp_path))
    folders = R.image_folders(listing).withColumnRenamed("study", "id")
    assert folders.first().n_files == 70
    records = spark.createDataFrame([("s1", ["a/lateral_1.png", "a/lateral_2.png"])], "id string, image_path array<string>")
    kept, removed = drop_same_view_pairs(records.select("id"), folders, "id", drop_missing=True)
    assert [r.pair for r in kept.collect()] == ["OTHER"] and removed.isEmpty()
    assert extract_recoverable(records, "image_path", folders, "id")[0].first().n_files == 70
    files = listing.select(F.col("study").alias("id"), "file")
    declared = spark.createDataFrame([("s1", "lateral_1.png"), ("s1", "gone.png"), ("s2", None)], "id string, file string")
    found = {(r.id, r.rule, r.file) for r in reconcile3(declared, files, files).collect()}
    assert found == {("s1", "declared_not_on_disk", "gone.png"), ("s1", "declared_not_in_state", "gone.png"), ("s2", "record_without_folder", "")}


def test_runs_and_steps(spark, tmp_path):
    for name, text in (("a/results.json", '{"experiment": "e1",\n "best": {"value": 0.5}}'), ("b/results.json", '{"experiment": ')):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text)
    good, bad = R.read_runs(spark, str(tmp_path / "*/results.json"), "experiment string, best struct<value:double>")
    assert [r.experiment for r in good.collect()] == ["e1"] and "b/results.json" in bad.first()._path
    steps = tmp_path / "steps"
    steps.mkdir()
    for n in (2, 10):
        (steps / f"step{n:06d}.json").write_text(json.dumps({"experiment": "e", "epoch": 1.0, "samples": [{"id": "x", "reference": "r", "prediction": f"p{n}"}]}, indent=1))
    assert sorted((r.step, r.prediction) for r in R.read_prediction_steps(spark, str(steps)).collect()) == [(2, "p2"), (10, "p10")]


def test_cache_ignores_a_cut_line_and_keeps_the_last(spark, tmp_path):
    lines = [json.dumps({"key": k, "source": "s", "translation": t}) for k, t in (("a", "1"), ("b", "2"), ("a", "3"))]
    (tmp_path / "cache.jsonl").write_text("\n".join(lines) + '\n{"key": "b", "tran')
    assert sorted((r.key, r.translation) for r in R.read_cache(spark, str(tmp_path / "cache.jsonl")).collect()) == [("a", "3"), ("b", "2")]


def test_translation_csv_last_row_wins(spark, tmp_path):
    (tmp_path / "t.csv").write_text('uid,findings,impression,findings_it,impression_it,MeSH\n1,"a ""q"", b\nc",x,ai,,Edema; normal ;Mass\n1,last,,it,,\n')
    r = R.read_translation_csv(spark, str(tmp_path / "t.csv")).collect()
    assert len(r) == 1 and (r[0].findings, r[0].impression, r[0].MeSH) == ("last", "", "")


def test_guarded_write(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "id int, v double")
    assert W.write_guarded(df, path, dry_run=True) == 3 and not (tmp_path / "out").exists()
    W.write_guarded(df, path)
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, None), (2, None), (3, 1.5)]
    with pytest.raises(FileExistsError):
        W.write_guarded(df, path)
    boom = F.udf(lambda v: 1 / 0, "double")
    with pytest.raises(Exception):
        W.write_guarded(df.withColumn("v", boom("v")), path, overwrite=True)
    assert spark.read.parquet(path).count() == 3
    fresh = str(tmp_path / "fresh")
    with pytest.raises(Exception):
        W.write_guarded(df.withColumn("v", boom("v")), fresh)
    W.write_guarded(df, fresh)  # a failed first write does not block the next
    assert spark.read.parquet(fresh).count() == 3 and [p.name for p in tmp_path.iterdir() if "replaced" in p.name] == []
    # A table may replace itself.
    W.write_guarded(spark.read.parquet(path).where("id > 1"), path, overwrite=True)
    assert spark.read.parquet(path).count() == 2


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("t"), "id").alias("t"))
    first = W.table_fingerprint(df).first()
    assert first == W.table_fingerprint(df.orderBy(F.desc("id")).repartition(5)).first()
    changed = df.withColumn("t", F.when(F.col("id") == 500, "x").otherwise(F.col("t")))
    assert W.table_fingerprint(changed).first().fingerprint != first.fingerprint
    assert W.table_fingerprint(df.unionByName(df.limit(1))).first().fingerprint != first.fingerprint


def test_work_dir_prefers_the_named_folder(spark):
    from corpusflow.session import work_dir

    assert work_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
