"""The segmented translation cache: what a lookup opens, replays, compaction, rival writers."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.streaming import cache as C


def rows(spark, low, high):
    texts = [f"t{i}" for i in range(low, high)]
    return spark.createDataFrame([(hashlib.md5(t.encode()).hexdigest(), t, t.upper()) for t in texts], C.ROWS)


def test_bloom():
    keys = pa.array([hashlib.md5(str(i).encode()).hexdigest() for i in range(5000)])
    others = pa.array([hashlib.md5(f"x{i}".encode()).hexdigest() for i in range(20000)])
    bits = C.bloom(keys)
    assert C.may_hold(bits, keys).all()
    assert C.may_hold(bits, others).mean() < 0.002
    assert not C.may_hold(C.bloom(keys.slice(0, 0)), others).any()


@pytest.mark.parametrize("sent", [C.SENT_BYTES, 0])
def test_lookup_opens_only_hit_buckets(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(C, "SENT_BYTES", sent)
    monkeypatch.setattr(C, "BUCKET_KEYS", 8)
    path = str(tmp_path / "cache")
    C.append(rows(spark, 0, 400), path, "s", 0, 400)
    C.append(rows(spark, 400, 500), path, "s", 1, 100)
    now = C.read_manifest(spark, path)
    assert [s.digits for s in now.segments] == [2, 1] and [s.rows for s in now.segments] == [400, 100]
    asked = rows(spark, 3, 6).select("key")
    buckets = C.hit_buckets(asked, path, now.segments)
    wanted = {(now.segments[0].name, "b" + r.key[:2]) for r in asked.collect()}
    assert wanted <= set(buckets) and len(buckets) <= len(wanted) + 1
    read = C.segment_rows(spark, path, buckets, now.segments)
    assert len(read.inputFiles()) == len(buckets) and read.count() < 40
    assert {r.translation for r in C.lookup(asked, path).collect()} == {"T3", "T4", "T5"}
    assert C.lookup(rows(spark, 900, 920).select("key"), path).count() == 0
    assert C.lookup(asked, str(tmp_path / "none")).count() == 0


def test_replayed_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    C.append(rows(spark, 0, 5), path, "s", 0, 5)
    before = C.read_manifest(spark, path)
    C.append(rows(spark, 0, 7), path, "s", 0, 7)
    assert C.read_manifest(spark, path) == before and C.read_cache(spark, path).count() == 5
    C.append(rows(spark, 5, 7), path, "other", 0, 2)
    assert C.read_cache(spark, path).count() == 7
    C.append(rows(spark, 0, 0), path, "s", 1, 0)
    assert len(C.read_manifest(spark, path).segments) == 2 and C.read_manifest(spark, path).done == {"s": 1, "other": 0}


def test_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "FAN_IN", 3)
    monkeypatch.setattr(C, "BUCKET_KEYS", 16)
    path = str(tmp_path / "cache")
    for k in range(3):
        C.append(rows(spark, 4 * k, 4 * k + 5), path, "s", k, 5)  # neighbours share a text
    old = C.read_manifest(spark, path)
    assert C.compact(spark, path) == 3
    now = C.read_manifest(spark, path)
    assert [(s.rows, s.digits) for s in now.segments] == [(13, 0)] and now.done == {"s": 2}
    assert C.compact(spark, path) == 0
    assert C.segment_rows(spark, path, None, old.segments).count() == 15  # an older manifest still reads
    assert C.vacuum(spark, path) == 3
    assert sorted(r.source for r in C.read_cache(spark, path).collect()) == sorted(f"t{i}" for i in range(13))


def test_rival_writers(spark, tmp_path):
    path = str(tmp_path / "cache")
    C.append(rows(spark, 0, 3), path, "s", 0, 3)
    mine, theirs = C.read_manifest(spark, path), C.read_manifest(spark, path)
    C.commit(spark, path, C.Manifest(theirs.number, theirs.segments, {"s": 0, "theirs": 4}))
    with pytest.raises(C.CommitConflict):
        C.commit(spark, path, mine)
    seen = []

    def change(now):
        seen.append(now.number)
        if len(seen) == 1:  # another writer commits in between
            C.commit(spark, path, C.Manifest(now.number, now.segments, now.done | {"between": 1}))
        return C.Manifest(now.number, now.segments, now.done | {"mine": 9})

    C.committed(spark, path, change)
    assert C.read_manifest(spark, path).done == {"s": 0, "theirs": 4, "between": 1, "mine": 9} and len(seen) == 2
