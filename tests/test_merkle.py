"""Content trees: a changed byte names its file, and only nodes above it are opened."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.sources import merkle as M


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    root = tmp_path / "a b%20c"
    for k in range(60):
        path = root / f"d{k % 4}" / f"e {k}%.bin"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(rng.randbytes(rng.choice([1, 99, 100, 101, 5000])))
    return root


def tree(spark, root, **options):
    return M.content_tree(M.file_hashes(M.read_chunks(spark, str(root), chunk_bytes=100), **options))


def test_read_chunks_covers_files(spark, folder):
    rows = M.read_chunks(spark, str(folder), chunk_bytes=100).collect()
    files = {}
    for r in sorted(rows, key=lambda r: r.chunk):
        files[r.path] = files.get(r.path, b"") + bytes(r.content)
        assert len(r.content) <= 100 and r.chunk < r.chunks
    assert files == {os.path.relpath(p, folder): p.read_bytes() for p in folder.rglob("*.bin")}


def test_changed_byte_names_its_file(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "FAN_OUT", 4)  # files of 50 chunks have three levels
    M.write_tree(tree(spark, folder), str(tmp_path / "record"))
    record = M.read_tree(spark, str(tmp_path / "record"))
    assert M.differing_files(tree(spark, folder), record).isEmpty()
    large = max(folder.rglob("*.bin"), key=lambda p: p.stat().st_size)
    body = bytearray(large.read_bytes())
    body[3333] ^= 1
    large.write_bytes(body)
    gone, new = sorted(folder.rglob("*.bin"))[0], folder / "d9" / "new.bin"
    assert gone != large
    gone.unlink()
    new.parent.mkdir()
    new.write_bytes(b"x")
    got = {r.path: r.status for r in M.differing_files(tree(spark, folder), record).collect()}
    assert got == {os.path.relpath(large, folder): "differs", os.path.relpath(gone, folder): "absent_now", "d9/new.bin": "absent_in_record"}


def test_hash_of_a_file_is_its_own(spark, monkeypatch):
    """Neither other files nor the order of rows nor the number of levels of others matter."""
    monkeypatch.setattr(M, "FAN_OUT", 3)
    rows = [("a", bytes(950)), ("b", b"x" * 100), ("c", None), ("d", b"x" * 100)]
    df = spark.createDataFrame(rows, "p string, body binary")

    def hashes(some):
        chunks = M.in_chunks(some, F.col("p"), F.col("body"), 100)
        return {r.path: (r.length, r.hash) for r in M.file_hashes(chunks.repartition(5)).collect()}

    every = hashes(df)
    assert every["b"] == every["d"] and len({h for _, h in every.values()}) == 3 and every["c"][0] == 0
    for name in "abc":
        assert hashes(df.where(F.col("p") == name)) == {name: every[name]}


def test_large_files_by_size(spark):
    old = spark.createDataFrame([("a", b"x" * 300), ("b", b"y")], "p string, body binary")
    new = spark.createDataFrame([("a", b"z" * 300), ("b", b"y")], "p string, body binary")
    one, two = (M.content_tree(M.file_hashes(M.in_chunks(df, F.col("p"), F.col("body"), 100), large=200)) for df in (old, new))
    assert M.differing_files(one, two).isEmpty()
    assert {r.level for r in one.collect()} == {0, 1, 2, 3, 4}


def listed_by_spark(spark, root, glob):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(str(root)).select("path", "length")
    return {(r.path.split(f"{root}/", 1)[1], r.length) for r in found.collect()}


def test_listing_is_that_of_spark(spark, folder, monkeypatch):
    monkeypatch.setattr(M, "ENTRIES", 7)
    names = [".h", "_h", "_a=1", "x._COPYING_", "_metadata", "_metadata.d/f", "_common_metadata/f", "_hid/f", ".hid/f", "k=1/_t=2/f", "deep/er/st/f", "é ü/%41.bin", "a+b(c){d}.bin", "e 99%.BIN", "z/empty", "z/f\n.bin"]
    for name in names:
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if name.endswith("empty") else b"x" * len(name))
    os.symlink(folder / "d0", folder / "link")
    os.symlink(folder / "nothing", folder / "broken")
    (folder / "bare").mkdir()
    for glob in ("*", "*.bin", "e ?%.{bin,BIN}", "[!e]*", "f"):
        got = [tuple(r) for r in M.list_files(spark, str(folder), glob).collect()]
        assert len(got) == len(set(got)) and set(got) == listed_by_spark(spark, folder, glob), glob


def test_files_are_not_listed_in_the_driver(spark, folder, monkeypatch):
    """Files are rows of tasks: the plan has no scan of files, whose list the driver would hold, and few tasks read many small files."""
    monkeypatch.setattr(M, "TASK_BYTES", 20_000)
    chunks = M.read_chunks(spark, str(folder), chunk_bytes=100)
    assert chunks.inputFiles() == []
    total = sum(p.stat().st_size for p in folder.rglob("*.bin"))
    assert chunks.rdd.getNumPartitions() == max(8, -(-total // 20_000))
    (folder / "empty").mkdir()
    assert M.read_chunks(spark, str(folder / "empty")).isEmpty()
    with pytest.raises(Exception, match="nowhere"):
        M.read_chunks(spark, str(folder / "nowhere"))
