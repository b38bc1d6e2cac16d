"""CSV with line breaks inside quotes, read block by block.

A reader that must see a file from its start is one task per file. Here Spark's
text source deals a file's lines out by blocks, and quotes tell where records
begin: a line begins a record if the quotes before it in its file are even. One
pass counts quotes per block; the parities of a file's blocks, added up in
order, say which blocks begin inside quotes. A second pass cuts every block into
records by that. Only the pieces of records that cross blocks are put together
by a shuffle, at most two per block.

Quotes inside quoted fields are doubled, and a field with a quote is quoted, as
in RFC 4180. Records end at a line feed, with or without a carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD, HEAD, TAIL = 0, 1, 2
_PIECES = "file string, block bigint, seq bigint, kind int, value string"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _blocks_inside_quotes(lines: DataFrame) -> set[tuple[str, int]]:
    """Blocks that begin inside a quoted field: a part of the list of file splits that the driver plans a scan with."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = Window.partitionBy("file").orderBy(F.desc("block"))
    summed = odd.select("file", "block", "odd", (F.sum("odd").over(upto) % 2).alias("after"), F.row_number().over(last).alias("from_end"))
    marked = summed.where("after <> odd OR (from_end = 1 AND after = 1)").collect()
    if broken := sorted(r.file for r in marked if r.from_end == 1 and r.after == 1):
        raise ValueError(f"a quote is left open at the end of {broken[0]}")
    return {(r.file, r.block) for r in marked}


def _pieces(lines: DataFrame, inside: set[tuple[str, int]]) -> DataFrame:
    """(file, block, seq, kind, value): whole records, ends of records begun before (``HEAD``), and beginnings of records that go on (``TAIL``)."""
    shared = lines.sparkSession.sparkContext.broadcast(inside)  # of the scan's own list of splits

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = shared.value
        place: tuple[str, int] | None = None
        odd, seq, kind = 0, 0, RECORD
        open_lines: list[str] = []

        def rest() -> list[tuple]:
            """What the block leaves: the end of a record that began earlier still, or a record that goes on."""
            return [(*place, seq if kind == RECORD else -1, TAIL if kind == RECORD else HEAD, "\n".join(open_lines))] if open_lines else []

        for batch in batches:
            values, files = batch.column(0).to_pylist(), batch.column(1)
            blocks = batch.column(2).to_numpy(zero_copy_only=False)
            quotes = np.asarray(pc.count_substring(batch.column(0), '"'), dtype=np.int64)
            n = len(values)
            changed = np.asarray(pc.not_equal(files.slice(1), files.slice(0, n - 1))) if n > 1 else np.zeros(0, bool)
            edges = np.r_[0, np.flatnonzero(changed | (blocks[1:] != blocks[:-1])) + 1, n].tolist() if n else []
            out: list[tuple] = []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                here = (files[i].as_py(), int(blocks[i]))
                if here != place:
                    if place is not None:
                        out += rest()
                    place, odd, seq, open_lines = here, int(here in inside), 0, []
                    kind = HEAD if odd else RECORD
                ends = (odd + np.cumsum(quotes[i:j])) % 2 == 0  # a record ends with this line
                odd = int(not ends[-1])
                at = i
                for stop in (np.flatnonzero(ends) + i + 1).tolist():
                    value = values[at] if stop == at + 1 and not open_lines else "\n".join([*open_lines, *values[at:stop]])
                    out.append((*place, seq if kind == RECORD else -1, kind, value))
                    seq += kind == RECORD
                    open_lines, kind, at = [], RECORD, stop
                open_lines += values[at:j]
            yield _batch(out)
        if place is not None:
            yield _batch(rest())

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _PIECES.split(", ")])

    return lines.mapInArrow(cut, _PIECES)


def read_quoted_csv(spark: SparkSession, path: str | list[str], schema: str, mode: str = "FAILFAST") -> DataFrame:
    """The columns of ``schema`` by position, and ``_at``, a struct that orders records as they stand in the files.

    The first record of every file is its header. A file of many blocks is read
    by many tasks. A file that ends inside quotes fails the read; what
    ``from_csv`` does not take goes by ``mode``. Empty lines are no records.
    """
    lines = _lines(spark, path)
    pieces = _pieces(lines, _blocks_inside_quotes(lines))
    whole = pieces.where(F.col("kind") == RECORD).drop("kind")
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # two rows per block
    crossing = pieces.where(F.col("kind") != RECORD).withColumn("_record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "kind", "value"))), lambda p: p.value), "\n")
    stitched = crossing.groupBy("file", "_record").agg(F.min("block").alias("block"), F.max("seq").alias("seq"), joined.alias("value")).drop("_record")
    header = (F.col("block") == 0) & (F.col("seq") == 0)
    record = F.regexp_replace("value", r"\r\z", "")
    records = whole.unionByName(stitched).where(~header).withColumn("value", record).where("value <> ''")
    parsed = F.from_csv("value", schema, {"escape": '"', "multiLine": "true", "mode": mode})
    return records.select(parsed.alias("_row"), F.struct("file", "block", "seq").alias("_at")).select("_row.*", "_at")
