"""Content trees of folders: files hashed in chunks, hashes combined level by level.

A file is hashed by its chunks, so no row ever holds a file. Chunk hashes of a
file are combined ``FAN_OUT`` at a time until one is left. Files hang below nodes
named by the first digits of their path's hash, in path order within a node; a
node's hash covers its children's, up to the root. Two trees are compared from
the root down, and only below nodes that differ, so a changed byte names its
file after a look at a few nodes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .sinks import open_uri, root_uri

#: Bytes per chunk, hashes combined at once, and digits of a path's hash that name a leaf node.
CHUNK_BYTES, FAN_OUT, DEPTH = 8 << 20, 1024, 3
CHUNKS = "path string, length bigint, chunks bigint, chunk bigint, content binary"
#: Entries of a folder in a batch, folders listed at once by a core, and bytes of files a task reads.
ENTRIES, LISTED, TASK_BYTES = 1 << 14, 4, 32 << 20


def _number_of_chunks(length: Column, chunk_bytes: int) -> Column:
    return F.greatest(F.ceil(length / F.lit(chunk_bytes)).cast("bigint"), F.lit(1).cast("bigint"))


def _entries(source, folder: str) -> Iterator[tuple[str, int | None]]:
    """(name, length) of what lies in a folder, None for a folder; a local folder is never held as a whole."""
    from pyarrow import fs

    if not isinstance(source, fs.LocalFileSystem):
        for x in source.get_file_info(fs.FileSelector(folder)):
            yield x.base_name, None if x.type == fs.FileType.Directory else x.size
        return
    with os.scandir(folder) as found:
        for x in found:
            try:
                yield x.name, None if x.is_dir() else x.stat().st_size
            except FileNotFoundError:  # went meanwhile, or a link to nothing
                continue


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's readers leave out."""
    if folder and name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files below ``root``, paths relative to it; the names go by Spark's rules, empty files are left out.

    Spark's own listing gathers every file in the driver and deals them out by
    there. Here tasks list folders, level by level, and the driver knows only
    whether there is one more level.
    """
    whole = root_uri(spark, root)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = open_uri(whole)
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            paths, lengths = [], []
            for name, length in _entries(source, f"{base}/{folder}".rstrip("/") or "/"):
                if not _hidden(name, length is None):
                    paths.append(f"{folder}/{name}" if folder else name)
                    lengths.append(length)
                if len(paths) == ENTRIES:
                    yield pa.record_batch([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["path", "length"])
                    paths, lengths = [], []
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["path", "length"])

    folders, files = spark.createDataFrame([("",)], "path string"), None
    at_once = LISTED * spark.sparkContext.defaultParallelism
    while files is None or not folders.isEmpty():
        found = cut(folders.repartition(at_once, "path").mapInArrow(entries, "path string, length bigint"))
        files = found.where("length > 0") if files is None else files.unionByName(found.where("length > 0"))
        folders = found.where("length IS NULL").select("path")
    if glob == "*":
        return files
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    return files.where(F.substring_index("path", "/", -1).rlike(rf"(?s)\A(?:{name})\z"))


def read_chunks(spark: SparkSession, root: str, glob: str = "*", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, length, chunks, chunk, content) of the files below ``root``, paths relative to it.

    Empty files are left out, as by Spark's listing; every chunk
    is read as a range by the task that hashes it, so a large file is read by many.
    """
    whole, files = root_uri(spark, root), list_files(spark, root, glob)
    counted = files.withColumn("chunks", _number_of_chunks(F.col("length"), chunk_bytes))
    tasks = max(spark.sparkContext.defaultParallelism, -(-(files.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = open_uri(whole)
        for batch in batches:
            for path, length, chunks, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = chunk * chunk_bytes
                with source.open_input_file(f"{base}/{path}") as f:
                    content = f.read_at(min(chunk_bytes, length - at), at)
                yield pa.RecordBatch.from_pylist([{"path": path, "length": length, "chunks": chunks, "chunk": chunk, "content": content}], kinds)

    kinds = pa.schema([("path", pa.string()), ("length", pa.int64()), ("chunks", pa.int64()), ("chunk", pa.int64()), ("content", pa.binary())])
    rows = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    return rows.repartition(tasks, "path", "chunk").mapInArrow(read, CHUNKS)


def in_chunks(df: DataFrame, path: Column, content: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows as ``read_chunks`` gives them, of contents that are rows already."""
    body = df.select(path.alias("path"), F.coalesce(content, F.lit("").cast("binary")).alias("_body")).withColumn("length", F.length("_body").cast("bigint"))
    rows = body.withColumn("chunks", _number_of_chunks(F.col("length"), chunk_bytes)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    piece = F.substring("_body", (F.col("chunk") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    return rows.select("path", "length", "chunks", "chunk", piece.alias("content"))


def _folded(children: Column) -> Column:
    """Hash of a list of (at, hash) in the order of their places."""
    return F.sha2(F.array_join(F.transform(F.sort_array(children), lambda c: F.concat_ws(" ", c.at.cast("string"), c.hash)), "\n"), 256)


def file_hashes(chunks: DataFrame, large: int | None = None) -> DataFrame:
    """(path, length, hash) from chunk rows; files beyond ``large`` bytes by their size only.

    A file's hash depends on its own bytes and the chunk size alone.
    """
    by_size = F.lit(False) if large is None else F.col("length") > large
    marks = F.when(by_size, F.concat(F.lit("size:"), F.col("length").cast("string"))).otherwise(F.sha2("content", 256))
    nodes = chunks.where(~by_size | (F.col("chunk") == 0)).select(
        "path", "length", F.when(by_size, 1).otherwise(F.col("chunks")).alias("left"), F.col("chunk").alias("at"), marks.alias("hash"))
    most, done = nodes.agg(F.max("left")).first()[0] or 1, nodes.limit(0)
    while True:
        up, fewer = F.expr(f"at div {FAN_OUT}").alias("at"), F.ceil(F.col("left") / F.lit(FAN_OUT)).cast("bigint").alias("left")
        nodes = nodes.groupBy("path", "length", fewer, up).agg(_folded(F.collect_list(F.struct("at", "hash"))).alias("hash"))  # FAN_OUT hashes at most
        most = -(-most // FAN_OUT)
        if most <= 1:
            return nodes.select("path", "length", "hash").unionByName(done.select("path", "length", "hash"))
        done = done.select("path", "length", "hash").unionByName(nodes.where("left = 1").select("path", "length", "hash"))
        nodes = nodes.where("left > 1")


def content_tree(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, node, path, length, hash): the root at level 0, nodes below it, and files at level ``depth`` + 1 under their leaf node."""
    leaf = F.substring(F.md5(F.col("path")), 1, depth)
    rows = files.select(F.lit(depth + 1).alias("level"), leaf.alias("node"), "path", "length", "hash")
    child = files.select(leaf.alias("node"), F.col("path").alias("at"), "length", "hash")
    for level in range(depth, -1, -1):
        folded = child.groupBy("node").agg(F.sum("length").alias("length"), _folded(F.collect_list(F.struct("at", "hash"))).alias("hash"))
        rows = rows.unionByName(folded.select(F.lit(level).alias("level"), "node", F.lit(None).cast("string").alias("path"), "length", "hash"))
        child = folded.select(F.substring("node", 1, level - 1).alias("node"), F.col("node").alias("at"), "length", "hash") if level else folded
    return rows


def write_tree(tree: DataFrame, path: str) -> None:
    """One folder per level, so that a comparison reads the levels it descends."""
    tree.write.partitionBy("level").parquet(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node string, path string, length bigint, hash string, level int").option("basePath", path).parquet(path)


def differing_files(now: DataFrame, then: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(path, status) of files that differ, are ``absent_in_record`` or ``absent_now``, by descending both trees."""

    def sides(level: int, keys: list[str]) -> DataFrame:
        own, other = (t.where(F.col("level") == level).select(*keys, F.col("hash").alias(h)) for t, h in ((now, "_now"), (then, "_then")))
        return own.join(other, keys, "full_outer").where(~F.col("_now").eqNullSafe(F.col("_then")))

    open_nodes = sides(0, ["node"]).select("node")
    for level in range(1, depth + 1):
        parent = F.substring("node", 1, level - 1)
        open_nodes = sides(level, ["node"]).select("node").join(open_nodes.select(F.col("node").alias("_parent")), parent == F.col("_parent"), "left_semi")
    status = F.when(F.col("_then").isNull(), "absent_in_record").when(F.col("_now").isNull(), "absent_now").otherwise("differs")
    return sides(depth + 1, ["node", "path"]).join(open_nodes, "node", "left_semi").select("path", status.alias("status"))
