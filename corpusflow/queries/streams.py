"""Streaming jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming.early_stop import ROCKSDB, stream_early_stop
from ..streaming.incremental import read_cache_table, stream_new_texts
from . import sqlkit as K
from .fixtures import CURVES, curves, table
from .registry import query


@query("x1_stream_new_texts", f"""
SELECT DISTINCT md5({K.squash('text')}) AS key, 'T' || CAST(length({K.squash('text')}) AS VARCHAR) AS translation FROM documents WHERE {K.filled('text')}""")
def _(spark, sf):
    incoming, cache = scratch_path(spark, "incoming"), scratch_path(spark, "cache")
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    # Files of a size that does not depend on how many files the table has: the number of batches follows from the bytes.
    # Short row groups let all cores read the two files of a batch.
    d.hint("rebalance", "lang").write.option("parquet.block.size", 8 << 20).partitionBy("lang").parquet(incoming)

    def translate(new):
        from ..functions.text import squash_ws

        return new.withColumn("translation", F.concat(F.lit("T"), F.length(squash_ws(F.col("source"))).cast("string")))

    source = spark.readStream.schema("doc_id bigint, text string, lang string").option("maxFilesPerTrigger", 2).parquet(incoming)
    stream_new_texts(source, "text", cache, scratch_path(spark, "progress"), translate).awaitTermination()
    return read_cache_table(spark, cache).select("key", "translation")


@query("x2_stream_early_stop", f"""
WITH RECURSIVE {CURVES}, e AS (SELECT run || ':' || metric AS run, step, CASE WHEN value < 1 THEN NULL ELSE value END AS v FROM curves),
fold AS (
  SELECT run, step, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS since, v AS best, v IS NOT NULL AS improved FROM e WHERE step = 1
  UNION ALL
  SELECT e.run, e.step, CASE WHEN e.v IS NOT NULL AND (f.best IS NULL OR e.v - f.best > 0.5) THEN 0 ELSE f.since + 1 END,
    CASE WHEN e.v IS NOT NULL AND (f.best IS NULL OR e.v - f.best > 0.5) THEN e.v ELSE f.best END, e.v IS NOT NULL AND (f.best IS NULL OR e.v - f.best > 0.5)
  FROM fold f JOIN e ON e.run = f.run AND e.step = f.step + 1 WHERE f.since < 4)
SELECT run, step, best, CAST(since AS BIGINT) AS since_improved, improved, since >= 4 AS stop FROM fold""")
def _(spark, sf):
    incoming, out = scratch_path(spark, "evals"), scratch_path(spark, "decisions")
    c = curves(spark, sf).select(F.concat_ws(":", "run", "metric").alias("run"), "step", F.when(F.col("value") >= 1, F.col("value")).alias("value"))
    c.write.parquet(incoming)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        evals = spark.readStream.schema("run string, step bigint, value double").parquet(incoming)
        decisions = stream_early_stop(evals, "max", 0.5, 4)
        (
            decisions.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "progress"))
            .trigger(availableNow=True).start().awaitTermination()
        )
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(out)
