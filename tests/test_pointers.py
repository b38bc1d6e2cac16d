"""Pointers of the early-stop fold: exact margins, and a chain that spans many chunks and partitions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.operators import pointers as P
from corpusflow.operators.windows import early_stop_fold


@settings(max_examples=300, deadline=None)
@given(st.floats(-1e6, 1e6), st.sampled_from([0.0, 0.1, 0.5, 1e-9, 3.7]))
def test_least_beyond(value, margin):
    least = P.least_beyond(np.array([value]), margin)[0]
    assert least - value > margin and not np.nextafter(least, -np.inf) - value > margin


def test_least_beyond_extremes():
    least = P.least_beyond(np.array([math.inf, -math.inf, 1e308, -0.0]), 0.0)
    assert np.isnan(least[0]) and least[1] == -np.finfo(float).max or least[1] - -math.inf > 0
    assert least[2] > 1e308 and least[3] > 0


@pytest.mark.parametrize("delta", [0.0, 0.25, 5.0])
def test_rising_curve(spark, monkeypatch, delta):
    """Every evaluation is a record; the chain is one run of 20,000 steps in chunks of 64."""
    monkeypatch.setattr(P, "CHUNK", 64)
    n = 20_000
    df = spark.range(1, n + 1).select(F.lit(None).cast("string").alias("run"), F.col("id").alias("step"), (F.col("id") * 0.1).alias("value"))
    r = early_stop_fold(df.repartition(7), "run", "step", "value", "max", delta, 60).first()
    best, count, at = None, 0, 0
    for k in range(1, n + 1):
        if best is None or k * 0.1 - best > delta:
            best, count, at = k * 0.1, count + 1, k
    assert (r.n_evals, r.best_step, r.n_improved, r.since_improved, r.stopped, r.stop_step) == (n, at, count, n - at, False, None)


def test_margin_beyond_patience(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(1, 50)] + [("b", i, None) for i in range(1, 9)], "run string, step int, value double")
    got = {r.run: r for r in early_stop_fold(df, "run", "step", "value", "max", 10.0, 5).collect()}
    assert (got["a"].best_step, got["a"].stop_step, got["a"].n_improved) == (1, 6, 1)
    assert (got["b"].best_step, got["b"].stop_step, got["b"].n_improved, got["b"].stopped) == (None, 5, 0, True)
