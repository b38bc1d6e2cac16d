"""Positions, totals and percentiles, also with one group that holds most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import ordinal as O


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 40}", i, float(rng.choice([1, 2, 2, 7.5, i % 50]))) for i in range(6000)]
    rows += [(None, 6000 + i, 3.0) for i in range(5)]
    return rows, spark.createDataFrame(rows, "g string, id bigint, v double").repartition(7)


def test_global_index(skewed):
    rows, df = skewed
    got = O.with_global_index(df, "v", "id").collect()
    want = {r[1]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])))}
    assert {r.id: r.idx for r in got} == want


def test_running_total(skewed):
    rows, df = skewed
    got = {r.id: r.lo for r in O.with_running_total(df, ["id"], "id").collect()}
    total = 0
    for i in sorted(r[1] for r in rows):
        assert got[i] == total
        total += i


def test_number_within(skewed):
    rows, df = skewed
    got = {r.id: r.rn for r in O.number_within(df, ["g"], [F.desc("id")]).collect()}
    for g in {r[0] for r in rows}:
        ids = sorted((r[1] for r in rows if r[0] == g), reverse=True)
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_numbers_by_key(skewed):
    """As the numbering that writes whole rows; equal keys follow each other."""
    rows, df = skewed
    payload = df.withColumn("text", F.repeat(F.lit("x"), 5))
    want = {r.id: r.rn for r in O.number_within(df, ["g"], ["v", "id"]).collect()}
    got = O.number_by_key(payload, ["g"], ["v", "id"])
    assert {r.id: r.rn for r in got.collect()} == want and got.columns == [*payload.columns, "rn"]
    order = {r[1]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])))}
    assert {r.id: r.idx for r in O.index_by_key(payload, ["v", "id"]).collect()} == order
    ties = O.index_by_key(payload.select("v", "text"), ["v"]).collect()
    assert sorted(r.idx for r in ties) == list(range(len(rows)))
    assert [r.v for r in sorted(ties, key=lambda r: r.idx)] == sorted(r[2] for r in rows)


def test_exact_percentiles(skewed):
    rows, df = skewed
    got = {r.g: r for r in O.exact_percentiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, "upper").collect()}
    for g in {r[0] for r in rows}:
        v = sorted(r[2] for r in rows if r[0] == g)
        assert (got[g].p10, got[g].p50, got[g].p99) == pytest.approx(tuple(np.percentile(v, [10, 50, 99])))
        assert got[g].upper == v[len(v) // 2]
    whole = O.exact_percentiles(df, [], "v", {"p50": 0.5}).first()
    assert whole.p50 == pytest.approx(np.percentile([r[2] for r in rows], 50))


def test_percentiles_by_digits(skewed, spark):
    rows, df = skewed
    from corpusflow.operators.radix_select import percentiles_by_digits

    points = {"p10": 0.1, "p50": 0.5, "p99": 0.99, "least": 0.0, "most": 1.0}
    assert sorted(map(str, percentiles_by_digits(df, ["g"], "v", points, "upper").collect())) == sorted(map(str, O.exact_percentiles(df, ["g"], "v", points, "upper").collect()))
    rng = random.Random(6)
    odd = [rng.choice([-1.0, 1.0]) * rng.random() * 10.0 ** rng.randrange(-300, 300) for _ in range(500)] + [0.0, -0.0, 5e-324, -5e-324, float("inf"), None]
    frame = spark.createDataFrame([(v,) for v in odd], "v double").repartition(4)
    got = percentiles_by_digits(frame, [], "v", {"p3": 0.03, "p50": 0.5, "p97": 0.97}).first()
    known = [v for v in odd if v is not None]
    assert (got.p3, got.p50, got.p97) == pytest.approx(tuple(np.percentile(known, [3, 50, 97])), rel=1e-12)
    assert percentiles_by_digits(frame.limit(0), [], "v", {"p50": 0.5}).first().p50 == 0.0


def test_no_rows(spark):
    empty = spark.createDataFrame([], "v double")
    assert O.exact_percentiles(empty, [], "v", {"p50": 0.5}).first().p50 == 0.0
