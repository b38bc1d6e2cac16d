"""New texts as a stream: each distinct text enters the cache once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import is_blank, text_key
from . import cache as C


def read_cache_table(spark: SparkSession, path: str) -> DataFrame:
    """All cached texts, one row per key; an absent cache is empty."""
    return C.read_cache(spark, path)


def stream_new_texts(
    source: DataFrame, text: str, cache_path: str, checkpoint: str, translate: Callable[[DataFrame], DataFrame], compact: bool = True
) -> StreamingQuery:
    """Append the texts a stream brings for the first time, with their result.

    ``translate`` gets the new ``(key, source)`` rows and adds ``translation``.
    The cache itself tells which keys are known, so the stream keeps no state,
    and a batch reads only the buckets whose filters do not rule its keys out.
    A batch counts once its segment is in the manifest, which also holds the
    last batch of each stream: a batch that is run again adds nothing. Streams
    may share a cache; the stream's checkpoint is its name there.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    known = C.Known()
    keyed = source.where(~is_blank(F.col(text))).select(text_key(F.col(text)).alias("key"), F.col(text).alias("source"))

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        manifest = C.read_manifest(spark, cache_path)
        if manifest.done.get(stream, -1) >= number:
            return
        unique = batch.groupBy("key").agg(F.min("source").alias("source")).persist()
        try:
            new = unique
            count, buckets = C.tested(unique, cache_path, manifest.segments, known)
            if buckets:
                cached = C.segment_rows(spark, cache_path, buckets, manifest.segments).select("key")
                new = unique.join(cached, "key", "left_anti")
            C.append(translate(new).select("key", "source", "translation"), cache_path, stream, number, count)
        finally:
            unique.unpersist()
        if compact:
            C.compact(spark, cache_path)

    return (
        keyed.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
