"""Quoted CSV read in many small blocks against Spark's reader of whole files."""

import csv
import random

import pytest

from corpusflow.sources.quoted_csv import read_quoted_csv
from corpusflow.sources.readers import read_translation_csv

SCHEMA = "a string, b string, c string"


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "200"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def rows(seed, n):
    rng = random.Random(seed)
    parts = ["x", '"', "\n", ",", "é", " ", "\n\n", '""', "日本", "long " * 40, "\r"]
    return [[str(i), *("".join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(2))] for i in range(n)]


def write(path, body, terminator="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator=terminator)
        out.writerow(["a", "b", "c"])
        out.writerows(body)


def test_blocks_give_the_records_of_whole_files(spark, small_blocks, tmp_path):
    want = []
    for k, terminator in ((1, "\n"), (2, "\r\n"), (3, "\n")):
        write(tmp_path / f"{k}.csv", own := rows(k, 60), terminator)
        want += own
    df = read_quoted_csv(spark, str(tmp_path), SCHEMA)
    got = df.collect()
    assert sorted([r.a, r.b or "", r.c or ""] for r in got) == sorted(want)
    assert len({(r._at.file, r._at.block) for r in got}) > 100  # many tasks read each file
    by_file = sorted(got, key=lambda r: tuple(r._at))
    for f in {r._at.file for r in got}:
        assert [int(r.a) for r in by_file if r._at.file == f] == list(range(60))
    whole = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "1.csv"))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(((r.a, r.b, r.c) for r in got if r._at.file.endswith("1.csv")), key=str)


def test_a_record_over_many_blocks(spark, small_blocks, tmp_path):
    body = [["1", "line\n" * 400, "x"], ["2", "", '"' * 300], ["3", "\n" * 500, ""]]
    write(tmp_path / "one.csv", body)
    got = read_quoted_csv(spark, str(tmp_path / "one.csv"), SCHEMA).collect()
    assert sorted([r.a, r.b or "", r.c or ""] for r in got) == body


def test_open_quote_fails(spark, small_blocks, tmp_path):
    (tmp_path / "bad.csv").write_text('a,b,c\n1,"x,y\n2,z,w\n')
    with pytest.raises(ValueError, match="left open"):
        read_quoted_csv(spark, str(tmp_path / "bad.csv"), SCHEMA)


def test_unquoted_and_empty(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b,c\n1,,x\n\n2,y,\n")
    (tmp_path / "header.csv").write_text("a,b,c\n")
    got = read_quoted_csv(spark, str(tmp_path), SCHEMA).drop("_at").collect()
    assert sorted(map(tuple, got)) == [("1", None, "x"), ("2", "y", None)]


def test_last_row_of_a_uid_wins_across_blocks(spark, small_blocks, tmp_path):
    with open(tmp_path / "t.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["uid", "findings", "impression", "findings_it", "impression_it", "MeSH"])
        out.writerows([str(i % 5), "f" * 30, f"i\n{i}", "", "", "normal"] for i in range(50))
    got = {r.uid: r.impression for r in read_translation_csv(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {str(k): f"i\n{45 + k}" for k in range(5)}
