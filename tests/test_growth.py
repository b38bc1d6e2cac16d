"""What a task holds or reads does not grow with the table."""

import re
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from corpusflow.functions import kernels, table_functions
from corpusflow.functions import text as X
from corpusflow.operators import overlap as O
from corpusflow.queries import streams
from corpusflow.queries.registry import QUERIES


def test_phrases_do_not_meet_by_group(spark):
    train = spark.range(300).select(F.lit("f").alias("section"), F.concat(F.lit("p"), "id").alias("phrase"), (F.col("id") % 3 + 1).alias("n"))
    pred = train.where("n > 1").withColumn("n", F.lit(2).cast("long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = O.phrase_amplification(train, pred, ["section"])
        against = O._overlap_against(train, pred.withColumn("experiment", F.lit("e")), ["experiment", "section"])
        for made in (out, against):
            joins = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin) \[([^\]]*)\]", made._jdf.queryExecution().executedPlan().toString())
            assert joins and all("phrase" in keys for keys in joins), joins
        assert out.count() == 200 and {r.share_pred for r in out.collect()} == {1 / 200}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_batches_follow_bytes_not_files(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i % 40}", "en de fr es".split()[i % 4]) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(24).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(streams, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    out = QUERIES["x1_stream_new_texts"](spark, str(tmp_path))
    assert out.count() == 40
    assert len(list(Path(f"{tmp_path}/incoming").rglob("*.parquet"))) <= 8  # 24 files of four languages would be 96


def test_gram_tables_are_bounded():
    texts = ["a b c", None, "", " ".join("x" for _ in range(50_000)), "z"]
    batch = pa.RecordBatch.from_pydict({"k": pa.array(range(5), pa.int64()), "text": texts})
    tables = list(table_functions.gram_tables(batch, "text", ["k"], str.split, (1, 2), " "))
    assert len(tables) > 2 and max(t.num_rows for t in tables) <= 1 << 15
    got = [tuple(r.values()) for r in pa.concat_tables(tables).to_pylist()]
    assert got == [(k, *g) for k, t in enumerate(texts) if t is not None for g in table_functions.grams_of(t.split(), (1, 2), " ")]


def test_counting_passes_are_bounded():
    texts = pd.Series(["ab cd ef " * 100] * 2000)
    passes = list(kernels._passes(texts, texts))
    assert sum(len(p) for p, _ in passes) == 2000
    assert max(sum(len(t) for side in (p, r) for text in side for t in text) for p, r in passes) < 300_000


def test_section_status_reads_to_the_first_word(spark):
    cases = {None: "EMPTY", "": "EMPTY", "  \n": "EMPTY", "N/A - XXXX": "PLACEHOLDER", "none.": "PLACEHOLDER", "...": "PLACEHOLDER", "nonena xxxxn/a": "PLACEHOLDER",
             "none x": "OK", "nonex": "OK", "n/a/": "OK", "na 1": "OK", "/": "OK", "K": "OK", "é": "PLACEHOLDER", "XXXX éa": "OK"}
    df = spark.createDataFrame([*cases.items()], "x string, want string")
    status = X.section_status(F.create_map(F.lit("I"), F.col("x")), "I")
    assert [(r.x, r.s) for r in df.select("x", status.alias("s")).collect()] == [*cases.items()]
    plan = df.select(status)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_replace" not in plan and "split(" not in plan and "forall" not in plan  # no copy of the text by regex
    assert df.select(X.section_status(F.create_map(F.lit("F"), F.col("x")), "I").alias("s")).distinct().collect() == [("MISSING_TAG",)]


def test_even_text_is_not_rewritten(spark):
    texts = [None, "", " ", "a", "a b", " a  b ", "a\tb", "a b", "a  b", "　a\x1c\x85b\n\n", "a~\x7fb", "a b c " * 50, "​é  x"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [r.s for r in df.select(X.squash_ws(F.col("x")).alias("s")).collect()] == [" ".join((t or "").split()) for t in texts]
    even = spark.createDataFrame([("the heart is normal",)], "x string")
    assert not even.select(F.col("x").rlike(X.UNEVEN_SPACE)).first()[0]  # single blanks are no matches
