"""Most frequent values by summaries: exact for every shape of counts."""

import random
from collections import Counter

import pytest

from corpusflow.operators import frequent as Q


@pytest.mark.parametrize("shape", ["skewed", "flat", "ties", "few", "nulls"])
def test_top_values(spark, monkeypatch, shape):
    monkeypatch.setattr(Q, "LEAST_COUNTERS", 40)
    monkeypatch.setattr(Q, "MOST_COUNTERS", 700)
    monkeypatch.setattr(Q, "_HELD", 500)
    rng = random.Random(2)
    values = {
        "skewed": [f"v{int(rng.paretovariate(1.1))}" for _ in range(20_000)],
        "flat": [f"v{i % 4000}" for i in range(20_000)],
        "ties": [f"v{i % 9}" for i in range(9000)] + [f"w{i}" for i in range(3000)],
        "few": ["a", "b", "b"],
        "nulls": [None, "x", None, "y", "y", ""],
    }[shape]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "w string").repartition(5)
    got = [(r.value, r.n) for r in Q.top_values(df, "w", 7).collect()]
    counts = Counter(v for v in values if v is not None)
    assert got == sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:7]


def test_summary_bounds(spark, monkeypatch):
    rng = random.Random(3)
    values = [f"v{int(rng.paretovariate(0.9))}" for _ in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values], "w string").repartition(3)
    monkeypatch.setattr(Q, "_HELD", 700)
    rows = Q.summaries(df, "w", 50).collect()
    off, counts = sum(r.off for r in rows), Counter(values)
    told = Counter()
    for r in rows:
        if r.value is not None:
            told[r.value] += r.n
    assert len(rows) <= 3 * 51 and off > 0
    assert all(told[v] <= n <= told[v] + off for v, n in counts.items())
