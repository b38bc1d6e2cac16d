"""Writers: split files, guarded writes, fingerprints and id lists."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite_frame


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, to_path = _file_system(spark, path)
    return fs.exists(to_path(path))


def write_guarded(
    df: DataFrame, path: str, overwrite: bool = False, dry_run: bool = False,
    fmt: str = "parquet", partition_by: tuple[str, ...] = (),
) -> int | None:
    """Write once, all or nothing, with NaN and infinities as null.

    An existing target is refused unless ``overwrite``. A dry run writes
    nothing and gives the row count. Rows are always written beside the target
    first, so a job that fails leaves the target as it was, or absent. A
    replaced table is moved aside before the new one takes its name, and goes
    only after that: at any moment one of the two is whole on disk.
    """
    spark = df.sparkSession
    there = path_exists(spark, path)
    if there and not overwrite:
        raise FileExistsError(f"{path} exists; pass overwrite=True to replace it")
    if dry_run:
        return df.count()
    mark = uuid.uuid4().hex
    staged, aside = (f"{path.rstrip('/')}.{what}-{mark}" for what in ("staging", "replaced"))
    writer = finite_frame(df).write.mode("errorifexists").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(staged)
    if there:
        _move(spark, path, aside)
    elif path_exists(spark, path):
        raise FileExistsError(f"{path} was written by another job; the new rows are in {staged}")
    _move(spark, staged, path)
    if there:
        fs, to_path = _file_system(spark, aside)
        fs.delete(to_path(aside), True)
    return None


def _move(spark: SparkSession, old: str, new: str) -> None:
    fs, to_path = _file_system(spark, old)
    if not fs.rename(to_path(old), to_path(new)):
        raise OSError(f"could not move {old} to {new}")


def write_splits(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines in one folder per split."""
    write_guarded(df, path, overwrite, fmt="json", partition_by=("split",))


def write_annotation(df: DataFrame, path: str, record: list[str], shard: Column) -> None:
    """Annotation objects ``split -> [records]``, one line per shard and split.

    ``shard`` bounds how many records one object holds.
    """
    grouped = df.groupBy(shard.alias("_shard"), "split").agg(
        F.collect_list(F.struct(*record)).alias("_records")  # bounded by the shard
    )
    grouped.select(F.to_json(F.create_map("split", "_records")).alias("value")).write.text(path)


def _limbs(text: Column) -> list[Column]:
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]


def table_fingerprint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Order-free content hash: row count and sums of four parts of each row's sha256.

    Sums merge on the map side, so no task ever holds the rows of a table.
    """
    by = by or []
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(set(df.columns) - set(by))]), {"ignoreNullFields": "false"})
    return fingerprint_of(df.select(*by, row.alias("_row")), "_row", by)


def fingerprint_of(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    sums = [F.sum(limb).alias(f"_s{i}") for i, limb in enumerate(_limbs(F.col(text)))]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    folded = F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(4)])
    return out.select(*by, "n_rows", F.sha2(folded, 256).alias("fingerprint"))


def tree_fingerprint(files: DataFrame, large: int | None = None) -> DataFrame:
    """Fingerprint of a file tree (columns path, length, content); large files count by size only."""
    whole = F.sha2(F.col("content"), 256)
    by_size = F.concat(F.lit("size:"), F.col("length").cast("string"))
    mark = whole if large is None else F.when(F.col("length") > large, by_size).otherwise(whole)
    return fingerprint_of(files.select(F.concat_ws("|", F.col("path"), mark).alias("_row")), "_row", [])


def compare_fingerprints(current: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Differing, unrecorded and vanished keys; nothing for equal ones."""
    c, r = current.select(key, F.col("fingerprint").alias("now")), recorded.select(key, F.col("fingerprint").alias("then"))
    status = (
        F.when(F.col("then").isNull(), "absent_in_record")
        .when(F.col("now").isNull(), "absent_now")
        .when(F.col("now") != F.col("then"), "differs")
    )
    return c.join(r, key, "full_outer").withColumn("status", status).where(F.col("status").isNotNull())


def ragged_union(dfs: list[DataFrame]) -> DataFrame:
    """Rows with differing columns, columns in first-seen order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def write_ragged_csv(dfs: list[DataFrame], path: str, overwrite: bool = False) -> None:
    out = ragged_union(dfs)
    mode = "overwrite" if overwrite else "errorifexists"
    out.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def to_flat_rows(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, the others unchanged."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
          for f in df.schema.fields]
    )


def id_lists(df: DataFrame, id_col: str, conditions: dict[str, Column]) -> DataFrame:
    """``(list, id)`` for every named condition that holds; unknown does not hold."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in conditions.items()]))
    return df.select(F.explode(names).alias("list"), F.col(id_col).alias("id"))


def write_id_lists(df: DataFrame, id_col: str, conditions: dict[str, Column], path: str) -> None:
    id_lists(df, id_col, conditions).select("list", F.col("id").cast("string")).write.partitionBy("list").text(path)


def root_uri(spark: SparkSession, root: str) -> str:
    """A folder with its scheme; without one it lies in the session's default file system, as for Spark's own readers and writers."""
    files, to_path = _file_system(spark, root)
    whole = files.makeQualified(to_path(root)).toString()
    return f"file://{whole.removeprefix('file:')}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def open_uri(uri: str):
    """pyarrow's file system of a folder and the folder's path in it; paths of local files are taken as they are."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith("file://") else fs.FileSystem.from_uri(uri)


def save_files(df: DataFrame, root: str, path: str = "path", content: str = "content") -> None:
    """Write one file per row below ``root`` from the executors.

    Each task makes a folder once and puts a file beside its place before it
    takes its name, so a task that runs again leaves whole files.
    """
    whole = root_uri(df.sparkSession, root)

    def write(rows) -> None:
        target, base = open_uri(whole)
        made: set[str] = set()
        for row in rows:
            full = f"{base}/{row[path]}"
            folder, _, name = full.rpartition("/")
            if folder not in made:
                target.create_dir(folder, recursive=True)
                made.add(folder)
            aside = f"{folder}/.{uuid.uuid4().hex}-{name}"
            with target.open_output_stream(aside) as out:
                out.write(bytes(row[content]))
            target.move(aside, full)

    df.select(path, content).foreachPartition(write)
