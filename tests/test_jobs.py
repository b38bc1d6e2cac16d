"""Curation jobs, batches and streams end to end on small inputs."""

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.vocabulary import CLINICAL, CLINICAL_TAGS
from corpusflow.operators import batches as B
from corpusflow.operators import joins as J
from corpusflow.operators import quality as Q
from corpusflow.plans import curation as C
from corpusflow.streaming.early_stop import ROCKSDB, stream_early_stop
from corpusflow.streaming.incremental import read_cache_table, stream_new_texts

ANNOTATION = "id string, split string, report string, image_path array<string>, uid string"
SOURCE = "uid string, findings string, impression string, tags array<string>"


@pytest.fixture(scope="module")
def inputs(spark):
    a = [(f"CXR{i}_1", "train" if i < 3 else "test", "x", [f"d/CXR{i}/frontal.png", f"d/CXR{i}/lateral.png"], str(i)) for i in range(5)]
    s = [(str(i), f"f{i}", f"i{i}", ["cardiomegaly/mild"] if i % 2 else ["normal"]) for i in range(5)]
    return spark.createDataFrame(a, ANNOTATION), spark.createDataFrame(s, SOURCE)


def test_build_writes_records_stats_and_manifest(spark, inputs, tmp_path):
    out = C.build_dataset(*inputs, "uid", Q.Version("frontal", "findings_impression"), CLINICAL_TAGS, "sys", "ask", str(tmp_path / "v"))
    rows = spark.read.json(out["records"])
    assert rows.count() == 5 and {r.images[0] for r in rows.collect()} == {f"images/CXR{i}_1/frontal.png" for i in range(5)}
    stats = {(r.kind, r.split, r.value): r.n for r in spark.read.json(out["stats"]).collect()}
    assert stats[("label", "train", "No Finding")] == 2 and stats[("label", "train", "Cardiomegaly")] == 1
    assert {r.split for r in spark.read.json(out["manifest"]).collect()} == {"train", "test"}


def test_build_stops_before_writing(inputs, tmp_path):
    annotation, source = inputs
    with pytest.raises(ValueError, match="source_missing"):
        C.build_dataset(annotation, source.where("uid <> '3'"), "uid", Q.Version(), CLINICAL_TAGS, "s", "u", str(tmp_path / "v"))
    assert not (tmp_path / "v").exists()


def test_unverifiable_rows_stop_the_job(spark):
    df = spark.createDataFrame([("a", "OK"), ("b", "BAD_ID"), ("c", "PLACEHOLDER"), ("d", "EMPTY")], "id string, s string")
    with pytest.raises(ValueError):
        C.drop_missing_section(df, F.col("s"))
    kept, removed = C.drop_missing_section(df, F.col("s"), strict=True, drop_unverifiable=True)
    assert {r.id for r in kept.collect()} == {"a", "c"} and {r.id for r in removed.collect()} == {"b", "d"}


def test_missing_folder_stops_the_job(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    folders = spark.createDataFrame([("a", 2, 2, 0)], "id string, n_files long, n_frontal long, n_lateral long")
    with pytest.raises(ValueError):
        C.drop_same_view_pairs(df, folders, "id")
    kept, removed = C.drop_same_view_pairs(df, folders, "id", drop_missing=True)
    assert kept.count() == 0 and removed.count() == 2


def test_fallback_records_need_fallback_labels(spark, inputs):
    records = C.build_records(*inputs, "uid", Q.Version("frontal"), CLINICAL_TAGS, "s", "u")
    with pytest.raises(ValueError):
        C.label_records(records, CLINICAL, 1, "positive_only", "s", "u", keep_fallback_records=True)
    out, counts = C.label_records(records, CLINICAL, 1, "positive_only", "s", "u")
    assert counts.first().clinical_records == out.count() == 5
    assert not Q.check_records(out, Q.Version("frontal"), CLINICAL).collect()


def test_verdict_and_exit(spark):
    found = spark.createDataFrame([("r1", "train", str(i), "") for i in range(8)], "rule string, split string, id string, detail string")
    verdict = Q.dq_verdict(found, ["r1", "r2"])
    got = {r.rule: r for r in verdict.collect()}
    assert (got["r1"].n, got["r1"].examples, got["r1"].passed, got["r2"].passed) == (8, "0;1;2;3;4", False, True)
    assert Q.exit_status(verdict) == 1
    with pytest.raises(ValueError):
        Q.raise_if_any(found)


def batch_row(id, text='{"diagnostic_label":["Edema"]}', kind="succeeded", blocks=1):
    return (id, (kind, ([("text", text)] * blocks, (100, 10))))


def test_batch_results_in_any_order(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "custom_id string")
    good = spark.createDataFrame([batch_row("b"), batch_row("a")], B.RESULT)
    parsed, errors, usage = B.reconcile_batch(good, expected, ["diagnostic_label"])
    assert errors.isEmpty() and parsed.count() == 2
    assert (usage.first().input_tokens, usage.first().output_tokens) == (200, 20)
    bad = spark.createDataFrame([batch_row("a"), batch_row("a"), batch_row("z"), batch_row("")], B.RESULT)
    got = sorted((r.custom_id, r.error) for r in B.reconcile_batch(bad, expected, ["diagnostic_label"])[1].collect())
    assert got == [("", "bad_id"), ("a", "duplicate_id"), ("a", "duplicate_id"), ("b", "missing"), ("z", "unknown_id")]


def test_release_refuses_a_changed_input(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, t string")
    state = B.submission_state(df, "id", ["t"])
    none = spark.createDataFrame([], "custom_id string, error string")
    assert B.release_results(df, none, state, B.submission_state(df.orderBy(F.desc("id")), "id", ["t"])).count() == 2
    with pytest.raises(ValueError):
        B.release_results(df, none, state, B.submission_state(df.withColumn("t", F.lit("z")), "id", ["t"]))
    with pytest.raises(ValueError):
        B.release_results(df, spark.createDataFrame([("a", "missing")], "custom_id string, error string"), state, state)


def test_chat_results_take_the_common_shape(spark):
    rows = spark.createDataFrame([("a", None, ['{"k":1}'], (5, 6)), ("b", "boom", None, None)],
                                 "custom_id string, error string, choices array<string>, usage struct<prompt_tokens:int,completion_tokens:int>")
    parsed, errors, usage = B.reconcile_batch(B.normalise_chat_results(rows), rows.select("custom_id"), ["k"])
    assert [r.custom_id for r in parsed.collect()] == ["a"] and errors.first().error == "not_succeeded" and usage.first().output_tokens == 6


def test_merge_validated_refuses(spark):
    left = spark.createDataFrame([(1,), (2,)], "id int")
    right = spark.createDataFrame([(1, "x", "bad")], "id int, p string, h string")
    with pytest.raises(ValueError):
        J.merge_validated(left, right, "id", "p", "h")
    with pytest.raises(ValueError):
        J.merge_validated(left.unionByName(left), right, "id", "p", "h")


def test_update_leaves_other_fields(spark):
    base = spark.createDataFrame([("a", "r", None, 1), ("b", "r", "old", 2)], "id string, report string, it string, keep int")
    out, bad = J.apply_updates(base, spark.createDataFrame([("a", "new")], "id string, it string"), "id", ["it"], sources={"it": "report"})
    assert sorted(map(tuple, out.collect())) == [("a", "r", "new", 1), ("b", "r", "old", 2)] and bad.isEmpty()
    again = J.apply_updates(base, spark.createDataFrame([("b", ""), ("c", "x")], "id string, it string"), "id", ["it"], sources={"it": "report"})[1]
    assert sorted(r.violation for r in again.collect()) == ["already_set:it", "blank_output:it", "unknown_id"]


def test_stream_appends_each_text_once(spark, tmp_path):
    incoming, cache = tmp_path / "in", str(tmp_path / "cache")

    def feed(texts, name):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(str(incoming / name))

    def run(checkpoint):
        calls = []

        def translate(new):
            calls.append(new.count())
            return new.withColumn("translation", F.upper("source"))

        source = spark.readStream.schema("text string").option("recursiveFileLookup", True).parquet(str(incoming))
        stream_new_texts(source, "text", cache, str(tmp_path / checkpoint), translate).awaitTermination()
        return sum(calls)

    feed(["a", "b", " a ", ""], "one")
    assert run("progress") == 2
    feed(["b", "c"], "two")
    assert run("progress") == 1
    # A second job over the same files finds everything cached.
    assert run("other_progress") == 0
    rows = read_cache_table(spark, cache).collect()
    assert sorted(r.translation.strip() for r in rows) == ["A", "B", "C"]


def test_early_stop_state_spans_batches(spark, tmp_path):
    incoming, out = tmp_path / "in", str(tmp_path / "out")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        for name, rows in (("b1", [("r", 2, 0.4), ("r", 1, 0.5), ("q", 1, None)]), ("b2", [("r", 3, 0.6), ("r", 4, 0.6)]), ("b3", [("r", 5, 0.1), ("r", 6, 0.9), ("q", 2, 0.3)])):
            spark.createDataFrame(rows, "run string, step int, value double").coalesce(1).write.parquet(str(incoming / name))
            source = spark.readStream.schema("run string, step int, value double").option("recursiveFileLookup", True).parquet(str(incoming))
            stream_early_stop(source, "max", 0.0, 2).writeStream.format("parquet").option("path", out).option(
                "checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    got = sorted((r.run, r.step, r.best, r.since_improved, r.stop) for r in spark.read.parquet(out).collect())
    assert got == [("q", 1, None, 1, False), ("q", 2, 0.3, 0, False), ("r", 1, 0.5, 0, False), ("r", 2, 0.5, 1, False),
                   ("r", 3, 0.6, 0, False), ("r", 4, 0.6, 1, False), ("r", 5, 0.6, 2, True)]


def test_early_stop_reads_one_run_in_order(spark, tmp_path, monkeypatch):
    """All evaluations of a run in one batch, in any order and many Arrow batches: state by ranges of steps, read in order."""
    import random

    from corpusflow.streaming import early_stop as E

    monkeypatch.setattr(E, "CHUNK", 64)
    rng = random.Random(8)
    values = {"hot": [None if rng.random() < 0.1 else round(i * 0.01 + rng.random(), 2) for i in range(3000)], "q": [0.5, 0.4]}
    rows = [(run, i + 1, v) for run, vs in values.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    incoming, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "run string, step long, value double").coalesce(1).write.parquet(incoming)
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.execution.arrow.maxRecordsPerBatch": "100"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema("run string, step long, value double").parquet(incoming)
        E.stream_early_stop(source, "max", 0.05, 40).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = []
    for run, vs in values.items():
        best, since = None, 0
        for i, v in enumerate(vs):
            better = v is not None and (best is None or v - best > 0.05)
            best, since = (v, 0) if better else (best, since + 1)
            want.append((run, i + 1, best, since, better, since >= 40))
            if since >= 40:
                break
    got = sorted((r.run, r.step, r.best, r.since_improved, r.improved, r.stop) for r in spark.read.parquet(out).collect())
    assert got == sorted(want)


def test_early_stop_state_follows_buckets(spark, tmp_path):
    """Many runs share a key of state; two batches, a null run, and evaluations that wait in state by part and range of steps."""
    import random

    from corpusflow.streaming import early_stop as E

    rng = random.Random(9)
    values = {run: [None if rng.random() < 0.1 else round(i * 0.01 + rng.random(), 2) for i in range(n)] for run, n in [(f"r{k}", 12) for k in range(300)] + [(None, 12), ("hot", 9000)]}
    rows = [(run, i + 1, v) for run, vs in values.items() for i, v in enumerate(vs)]
    setting = "spark.sql.streaming.stateStore.providerClass"
    before, keys = spark.conf.get(setting), []
    spark.conf.set(setting, ROCKSDB)
    try:
        for name, some in (("b1", [r for r in rows if r[1] <= 5]), ("b2", [r for r in rows if r[1] > 5])):
            rng.shuffle(some)
            spark.createDataFrame(some, "run string, step long, value double").coalesce(1).write.parquet(str(tmp_path / "in" / name))
            source = spark.readStream.schema("run string, step long, value double").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
            query = E.stream_early_stop(source, "max", 0.05, 40, buckets=4, held_rows=500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
                "checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
            query.awaitTermination()
            keys += [s["customMetrics"].get("numValueStateVars", 0) for p in query.recentProgress for s in p["stateOperators"]]
            most = max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])
    finally:
        spark.conf.set(setting, before)
    assert not any(keys) and most < 3 * len(values)
    want = []
    for run, vs in values.items():
        best, since = None, 0
        for i, v in enumerate(vs):
            better = v is not None and (best is None or v - best > 0.05)
            best, since = (v, 0) if better else (best, since + 1)
            want.append((run or "", i + 1, best, since, better, since >= 40))
            if since >= 40:
                break
    got = sorted((r.run or "", r.step, r.best, r.since_improved, r.improved, r.stop) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(want)
