"""A translation cache in segments, of which a lookup opens only the buckets that can hold its keys.

Keys are hexadecimal digests. Every append is a segment: rows in buckets named
by the first ``digits`` characters of the key, as many as its size asks for, and
a Bloom filter per bucket. A manifest lists the live segments; the next manifest
is one small file that comes into being whole or not at all, and is the only
commit. Segments of about one size are compacted into a larger one with longer
bucket names, so there are a few per power of ``FAN_IN`` rows however many
batches came.

A lookup deals its keys by segment and bucket, tests them against the filters in
the tasks, and reads the folders of the buckets that remain.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import _file_system, path_exists

ROWS = "key string, source string, translation string"
FILTERS = "bucket string, n bigint, bits binary"
#: Keys per bucket before names get longer, and segments of one level before they are compacted.
BUCKET_KEYS, FAN_IN = 1 << 16, 8
#: Bits per key and hash functions of a filter: about one false hit in 2,000 lookups.
BITS_PER_KEY, HASHES = 16, 8
#: Filters of live segments that a lookup sends to its tasks; beyond that keys are dealt to the filters instead.
SENT_BYTES = 16 << 20


@dataclass
class Segment:
    name: str
    digits: int
    rows: int

    @property
    def level(self) -> int:
        return int(math.log(max(self.rows, 1), FAN_IN))


@dataclass
class Manifest:
    number: int = 0
    segments: list[Segment] = field(default_factory=list)
    done: dict[str, int] = field(default_factory=dict)  # last committed batch of each stream


class CommitConflict(RuntimeError):
    """Another writer committed first."""


def _manifest_path(path: str, number: int) -> str:
    return f"{path}/manifests/{number:012d}.json"


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """The latest manifest; an absent cache is empty."""
    folder = f"{path}/manifests"
    if not path_exists(spark, folder):
        return Manifest()
    fs, to_path = _file_system(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(to_path(folder))]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
    if not numbers:
        return Manifest()
    stream = fs.open(to_path(_manifest_path(path, max(numbers))))
    try:
        told = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Manifest(max(numbers), [Segment(**s) for s in told["segments"]], told["done"])


def commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Make ``manifest`` the next one, or fail if there is one of that number already.

    The file is written aside and takes its name by a rename that never replaces
    a file: in one step on a distributed file system; on a local one, which only
    one machine's streams share, by a look and a rename.
    """
    sc = spark.sparkContext
    fs, to_path = _file_system(spark, path)
    aside, target = (to_path(p) for p in (f"{path}/manifests/.{uuid.uuid4().hex}", _manifest_path(path, manifest.number + 1)))
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps({"segments": [asdict(s) for s in manifest.segments], "done": manifest.done}).encode()))
    finally:
        out.close()
    files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    no_options = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(aside, target, no_options)
    except Py4JJavaError as failed:
        fs.delete(aside, False)
        if fs.exists(target):
            raise CommitConflict(target.toString()) from failed
        raise


def committed(spark: SparkSession, path: str, change: Callable[[Manifest], Manifest | None], tries: int = 20) -> Manifest | None:
    """Apply ``change`` to the latest manifest and commit it; again on the newer one if another writer was first."""
    for _ in range(tries):
        changed = change(read_manifest(spark, path))
        if changed is None:
            return None
        try:
            commit(spark, path, changed)
        except CommitConflict:
            continue
        return changed
    raise CommitConflict(path)


def _positions(keys: pa.Array, size: int) -> np.ndarray:
    """Bits of every key in a filter of ``size`` bits: a row per key."""
    # The first 16 digits name buckets; the hashes come from the other half of the digest.
    halves = np.array([int(k[-16:], 16) for k in keys.to_pylist()], dtype=np.uint64)
    one, two = halves & np.uint64(0xFFFFFFFF), (halves >> np.uint64(32)) | np.uint64(1)
    return ((one[:, None] + np.arange(HASHES, dtype=np.uint64) * two[:, None]) % np.uint64(size)).astype(np.int64)


def bloom(keys: pa.Array) -> bytes:
    """A filter of the keys."""
    size = max(64, len(keys) * BITS_PER_KEY)
    bits = np.zeros(size, dtype=bool)
    bits[_positions(keys, size).ravel()] = True
    return size.to_bytes(8, "little") + np.packbits(bits).tobytes()


def may_hold(bits: bytes, keys: pa.Array) -> np.ndarray:
    """Which keys the filter does not rule out."""
    size = int.from_bytes(bits[:8], "little")
    known = np.unpackbits(np.frombuffer(bits, dtype=np.uint8, offset=8))[:size].astype(bool)
    return known[_positions(keys, size)].all(axis=1)


def digits_for(rows: int) -> int:
    """Characters of the key that name a bucket in a segment of so many rows."""
    digits = 0
    while rows > BUCKET_KEYS * 16**digits:
        digits += 1
    return digits


def _bucket(digits: int) -> Column:
    return F.concat(F.lit("b"), F.substring("key", 1, digits))


def _parquet(table: pa.Table) -> bytes:
    out = io.BytesIO()
    pq.write_table(table, out)
    return out.getvalue()


def _write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    fs, to_path = _file_system(spark, path)
    out = fs.create(to_path(path), True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def _read(spark: SparkSession, schema: str, folders: list[str]) -> DataFrame:
    """Rows of folders, each read as it is: the folders' names are not columns."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*folders)


def write_segment(rows: DataFrame, path: str, name: str, digits: int) -> Segment:
    """Write rows and filters of a segment; it is live only once a manifest lists it.

    A segment of one bucket is one file, written by one task of rows that all
    cores make; its filter, of at most ``BUCKET_KEYS`` keys, is made here.
    Others make theirs in tasks.
    """
    spark = rows.sparkSession
    folder = f"{path}/segments/{name}"
    placed = rows.select("key", "source", "translation", _bucket(digits).alias("bucket"))
    if not digits:
        placed.repartition(1).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows")
        keys = _read(spark, "key string", [f"{folder}/rows"]).toArrow().column("key").combine_chunks()
        if len(keys):
            _write_bytes(spark, f"{folder}/filters/part-0.parquet", _parquet(pa.table({"bucket": ["b"], "n": [len(keys)], "bits": [bloom(keys)]})))
        return Segment(name, digits, len(keys))
    placed = placed.repartition("bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows")

    def filters(keys: pa.Table) -> pa.Table:
        own = keys.column("key").combine_chunks()
        return pa.table({"bucket": keys.column("bucket").slice(0, 1).cast(pa.string()), "n": [len(own)], "bits": [bloom(own)]})

    written = _read(spark, "key string", [f"{folder}/rows"]).withColumn("bucket", _bucket(digits))
    written.groupBy("bucket").applyInArrow(filters, FILTERS).write.mode("overwrite").parquet(f"{folder}/filters")
    return Segment(name, digits, spark.read.schema(FILTERS).parquet(f"{folder}/filters").agg(F.sum("n")).first()[0] or 0)


def _filters(spark: SparkSession, path: str, segments: list[Segment]) -> DataFrame:
    """(segment, bucket, bits) of segments."""
    folders = [f"{path}/segments/{s.name}/filters" for s in segments]
    name = F.element_at(F.split(F.input_file_name(), "/"), -3)
    return spark.read.schema(FILTERS).parquet(*folders).select(name.alias("segment"), "bucket", "bits")


class Known:
    """Filters of live segments that one stream has at hand; they are read once per segment."""

    def __init__(self) -> None:
        self.bits: dict[str, dict[str, bytes]] = {}

    def of(self, spark: SparkSession, path: str, segments: list[Segment]) -> dict[str, dict[str, bytes]]:
        new = [s for s in segments if s.name not in self.bits]
        self.bits = {s.name: self.bits.get(s.name, {}) for s in segments}
        for r in _filters(spark, path, new).collect() if new else ():
            self.bits[r.segment][r.bucket] = r.bits
        return self.bits


def tested(keys: DataFrame, path: str, segments: list[Segment], known: Known | None = None) -> tuple[int, list[tuple[str, str]]]:
    """How many keys there are, and the (segment, bucket) of every bucket that may hold one of them.

    Filters of a bounded size are sent to the tasks. Beyond ``SENT_BYTES`` keys
    are dealt by segment and bucket, of which each has one filter.
    """
    spark = keys.sparkSession
    if sum(s.rows for s in segments) * BITS_PER_KEY // 8 > SENT_BYTES:
        return keys.count(), _dealt_test(keys, path, segments)
    own = (known or Known()).of(spark, path, segments)
    shared = spark.sparkContext.broadcast(([(s.name, s.digits) for s in segments], own))  # SENT_BYTES at most

    def test(batches):
        segments, own = shared.value
        count, hits = 0, set()
        for batch in batches:
            asked = batch.column(0)
            count += len(asked)
            for name, digits in segments:
                bucket = pc.binary_join_element_wise("b", pc.utf8_slice_codeunits(asked, 0, digits), "") if digits else pa.array(["b"] * len(asked))
                for b in pc.unique(bucket).to_pylist():
                    bits = own[name].get(b)
                    if (name, b) not in hits and bits is not None and may_hold(bits, asked.filter(pc.equal(bucket, b))).any():
                        hits.add((name, b))
        rows = [(None, None, count), *((n, b, 0) for n, b in sorted(hits))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["segment", "bucket", "n"])

    rows = keys.select("key").mapInArrow(test, "segment string, bucket string, n bigint").collect()  # a row per task and bucket
    return sum(r.n for r in rows), sorted({(r.segment, r.bucket) for r in rows if r.segment is not None})


def hit_buckets(keys: DataFrame, path: str, segments: list[Segment]) -> list[tuple[str, str]]:
    """(segment, bucket) of every bucket that may hold one of ``keys``: at most as many as the segments have buckets."""
    return tested(keys, path, segments)[1] if segments else []


def _dealt_test(keys: DataFrame, path: str, segments: list[Segment]) -> list[tuple[str, str]]:
    asked = F.explode(F.array(*[F.struct(F.lit(s.name).alias("segment"), _bucket(s.digits).alias("bucket")) for s in segments]))
    dealt = keys.select("key", asked.alias("at")).select("key", "at.*")

    def test(asked: pa.Table, known: pa.Table) -> pa.Table:
        hit = asked.num_rows > 0 and known.num_rows > 0 and bool(may_hold(known.column("bits")[0].as_py(), asked.column("key").combine_chunks()).any())
        return asked.select(["segment", "bucket"]).slice(0, int(hit))

    by = ["segment", "bucket"]
    hits = dealt.groupBy(*by).cogroup(_filters(keys.sparkSession, path, segments).groupBy(*by)).applyInArrow(test, "segment string, bucket string")
    return sorted((r.segment, r.bucket) for r in hits.collect())


def segment_rows(spark: SparkSession, path: str, buckets: list[tuple[str, str]] | None, segments: list[Segment]) -> DataFrame:
    """Rows of whole segments, or of some of their buckets."""
    if buckets is None:
        folders = [f"{path}/segments/{s.name}/rows" for s in segments]
    else:
        folders = [f"{path}/segments/{segment}/rows/bucket={bucket}" for segment, bucket in buckets]
    return _read(spark, ROWS, folders) if folders else spark.createDataFrame([], ROWS)


def _one_each(rows: DataFrame) -> DataFrame:
    # Streams that share a cache may bring a text at the same time.
    return rows.groupBy("key").agg(F.min("source").alias("source"), F.max("translation").alias("translation"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the cache, one per key."""
    return _one_each(segment_rows(spark, path, None, read_manifest(spark, path).segments))


def lookup(keys: DataFrame, path: str, manifest: Manifest | None = None) -> DataFrame:
    """The cached rows of ``keys`` (a column key), read from the buckets that can hold them."""
    spark = keys.sparkSession
    manifest = manifest or read_manifest(spark, path)
    buckets = hit_buckets(keys, path, manifest.segments)
    return _one_each(segment_rows(spark, path, buckets, manifest.segments).join(keys.select("key"), "key", "left_semi"))


def append(rows: DataFrame, path: str, stream: str, batch: int, most: int) -> None:
    """Commit a batch of new rows, of which there are at most ``most``, as a segment. A batch that was committed before adds nothing."""
    spark = rows.sparkSession
    name = f"{stream}-{batch}-{uuid.uuid4().hex[:8]}"
    segment = write_segment(rows, path, name, digits_for(most))

    def add(now: Manifest) -> Manifest | None:
        if now.done.get(stream, -1) >= batch:
            return None
        live = [*now.segments, segment] if segment.rows else now.segments
        return Manifest(now.number, live, now.done | {stream: batch})

    committed(spark, path, add)


def compact(spark: SparkSession, path: str) -> int:
    """Merge segments of a level that has ``FAN_IN`` of them; gives how many segments went.

    The merged segment is written beside them and replaces them in one commit;
    a reader that holds an older manifest still finds its segments, which
    ``vacuum`` removes.
    """
    now = read_manifest(spark, path)
    levels: dict[int, list[Segment]] = {}
    for s in now.segments:
        levels.setdefault(s.level, []).append(s)
    old = [s for level, own in sorted(levels.items()) if len(own) >= FAN_IN for s in own]
    if not old:
        return 0
    gone = {s.name for s in old}
    name = f"compact-{hashlib.md5(','.join(sorted(gone)).encode()).hexdigest()[:12]}-{uuid.uuid4().hex[:8]}"
    merged = write_segment(_one_each(segment_rows(spark, path, None, old)), path, name, digits_for(sum(s.rows for s in old)))

    def swap(latest: Manifest) -> Manifest | None:
        if not gone <= {s.name for s in latest.segments}:  # another compaction was first
            return None
        return Manifest(latest.number, [*(s for s in latest.segments if s.name not in gone), merged], latest.done)

    return len(gone) if committed(spark, path, swap) else 0


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete segments that the latest manifest does not list. Only while no stream writes and no reader holds an older manifest."""
    live = {s.name for s in read_manifest(spark, path).segments}
    folder = f"{path}/segments"
    fs, to_path = _file_system(spark, folder)
    dead = [s.getPath() for s in fs.listStatus(to_path(folder)) if s.getPath().getName() not in live]
    for gone in dead:
        fs.delete(gone, True)
    return len(dead)
