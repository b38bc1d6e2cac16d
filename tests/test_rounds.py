"""Cases that once gave quietly wrong answers."""

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.text import glob_match
from corpusflow.functions.vectors import scored_by_key
from corpusflow.functions.vocabulary import CLINICAL
from corpusflow.operators import aggregates as A
from corpusflow.operators import batches as B
from corpusflow.operators import joins as J
from corpusflow.operators import metrics as M
from corpusflow.operators import overlap as O
from corpusflow.operators import quality as Q
from corpusflow.operators import runs as R
from corpusflow.operators import windows as W
from corpusflow.operators.ordinal import exact_percentiles, with_carried
from corpusflow.plans import curation as C


def test_nan_is_no_record(spark):
    df = spark.createDataFrame([("r", 1, 1.0), ("r", 2, float("nan")), ("r", 3, 5.0)], "run string, step int, v double")
    got = W.early_stop_fold(df, "run", "step", "v").first()
    assert (got.best_step, got.best_value, got.n_improved) == (3, 5.0, 2)


def test_duplicate_ids_do_not_multiply(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, n int, prediction string")
    pairs, counts = J.align_predictions(df, df, order=["n"])
    assert sorted((r.id, r.prediction, r.baseline_prediction) for r in pairs.collect()) == [("a", "y", "y"), ("b", "z", "z")]
    assert (counts.first().n_common, counts.first().n_current) == (2, 2)


def test_duplicate_cache_keys_do_not_multiply(spark):
    texts = spark.createDataFrame([("hello",), (" ",), (None,)], "t string")
    key = texts.select(J.text_key(F.col("t")).alias("k")).where("k IS NOT NULL").first().k
    cache = spark.createDataFrame([(key, "ciao"), (key, "ciao"), (None, "x")], "key string, translation string")
    rows, queue, stats = J.lookup_cache(texts, "t", cache)
    assert sorted((r.t or "", r.translation or "") for r in rows.collect()) == [("", ""), (" ", ""), ("hello", "ciao")]
    assert queue.isEmpty() and tuple(stats.first()) == (1, 1, 1, 0)


def test_null_groups_stay(spark):
    df = spark.createDataFrame([("a", 1.0, "one two"), (None, 3.0, "three"), (None, 5.0, "four five")], "g string, v double, t string")
    assert {r.g: r.p50 for r in A.latency_summary(df, ["g"], "v").collect()} == {"a": 1.0, None: 4.0}
    assert {r.g: r["max"] for r in A.length_profile(df, "t", 1, ["g"]).collect()} == {"a": 2, None: 2}
    counts = spark.createDataFrame([("a", "p", 2), (None, "q", 3)], "g string, phrase string, n long")
    assert {r.g: r.occurrences for r in O.phrase_profile(counts, ["g"]).collect()} == {"a": 2, None: 3}
    labelled = spark.createDataFrame([("a", ["A"], ["A"]), (None, ["A"], ["B"])], "g string, p array<string>, r array<string>")
    assert {r.g: r.f1_micro for r in M.multilabel_summary(labelled, "p", "r", ("A", "B"), by=["g"]).collect()} == {"a": 1.0, None: 0.0}


def test_empty_input_and_zero_weights(spark):
    none = spark.createDataFrame([], "v double, w double, g string")
    assert tuple(exact_percentiles(none, [], "v", {"p50": 0.5}).first()) == (0.0,)
    zero = spark.createDataFrame([(1.0, 0.0, "a"), (2.0, 0.0, "a")], "v double, w double, g string")
    with pytest.raises(Exception, match="all zero"):
        A.weighted_mean(zero, "v", "w", ["g"]).collect()


def test_every_leak_is_named(spark):
    df = spark.createDataFrame([("x", "train"), ("x", "val"), ("x", "test"), ("y", "val"), ("y", "val")], "id string, split string")
    found = sorted((r.rule, r.id, r.split, r.detail) for r in Q.id_violations(df).collect())
    assert found == [("duplicate_id", "x", "test", "3"), ("duplicate_id", "y", "val", "2"),
                     ("split_leakage", "x", "test", "test|train"), ("split_leakage", "x", "test", "test|val"), ("split_leakage", "x", "train", "train|val")]


def test_run_summary_keeps_models_and_hours(spark):
    schema = "model string, status string, best_value double, hours double, early_stopped boolean, epochs double, best_epoch double"
    runs = spark.createDataFrame([("a", "completed", 1.0, None, False, 3.0, 1.0), ("b", "failed", None, 2.0, False, 1.0, 0.0), ("b", "completed", 5.0, 4.0, True, 3.0, 2.0),
                                  (None, "failed", None, None, False, 0.0, 0.0)], schema)
    got = {r.model: (r.n, r.hours_total, r.hours_median, r.value_median) for r in R.run_summary(runs).collect()}
    assert got == {"a": (1, None, None, 1.0), "b": (1, 6.0, 3.0, 5.0), None: (0, None, None, None)}


def test_glob_sets(spark):
    names = ["exp1", "exp3", "exp]", "exp-", "other", "exp^", "exp[x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    import fnmatch

    for glob in ("exp[12]", "exp[!12]", "exp[]x]", "e*[1-3]", "exp[^]", "exp?", "exp[x", "[!]]*"):
        assert {r.n for r in df.where(glob_match(F.col("n"), [glob])).collect()} == {n for n in names if fnmatch.fnmatchcase(n, glob)}, glob


def test_references_without_the_separator(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b<SEP>c"), (3, None)], "id int, reference string")
    found = A.reference_violations(df, F.contains("reference", F.lit("<SEP>")), True)
    assert sorted((r.rule, r.id) for r in found.collect()) == [("reference_format", "1"), ("reference_format", "3")]
    assert A.reference_violations(df, F.lit(False), False).isEmpty()


def test_submission_binds_the_order(spark):
    df = spark.createDataFrame([("a", "x", 0), ("b", "y", 1)], "id string, t string, at int")
    swapped = df.withColumn("at", 1 - F.col("at"))
    state = lambda d: B.submission_state(d, "id", ["t"], "at")
    assert B.check_submission(state(df.repartition(2)), state(df)).isEmpty()
    assert [r.part for r in B.check_submission(state(swapped), state(df)).collect()] == ["ids_hash"]


def test_scores_are_kept_by_key(spark):
    images = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 3.0)], "k int, v double")
    kept = spark.createDataFrame([(1, 9.0), (5, 1.0)], "k int, score double")
    assert sorted(map(tuple, scored_by_key(images, "k", F.col("v") * 2, kept).collect())) == [(1, 9.0, False), (2, 6.0, True)]


def test_invalid_records_are_not_labelled(spark):
    schema = "id string, images array<string>, factors struct<task_type:string, diagnostic_category:array<string>>, messages array<struct<role:string, content_text:string, content_parts:array<struct<type:string, image:string, text:string>>>>"
    turns = [(r, "x", None) for r in ("system", "user", "assistant")]
    rows = [("ok", ["i"], ("t", ["Cardiomegaly"]), turns), ("twice", ["i"], ("t", ["Edema", "Edema"]), turns), ("what", ["i"], ("t", ["Strange"]), turns),
            ("images", [], ("t", ["Edema"]), turns), ("short", ["i"], ("t", ["Edema"]), turns[:2]), ("user", ["i"], ("t", ["Edema"]), [*turns[:2], turns[1]])]
    df = spark.createDataFrame(rows, schema)
    found = sorted((r.id, r.rule) for r in C.label_violations(df, CLINICAL, 1).collect())
    assert found == [("images", "image_count"), ("short", "messages_invalid"), ("twice", "labels_duplicate"), ("user", "no_assistant_target"), ("what", "labels_unknown")]
    with pytest.raises(ValueError, match="cannot be labelled"):
        C.label_records(df, CLINICAL, 1, "positive_only", "s", "u")
    assert C.label_records(df.where("id = 'ok'"), CLINICAL, 1, "positive_only", "s", "u")[0].count() == 1


def test_values_are_carried_over_partitions(spark):
    df = spark.range(5000).select(F.col("id").alias("at"), F.when(F.col("id") % 700 == 3, F.col("id")).alias("v"))
    rows = with_carried(df.repartition(7), ["at"], "v", "last").collect()
    assert all(r["last"] == (None if r["at"] < 3 else (r["at"] - 3) // 700 * 700 + 3) for r in rows)
