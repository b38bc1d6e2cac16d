"""Draws, quotas, mixes and panels."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.vocabulary import Vocabulary
from corpusflow.operators import sampling as P
from corpusflow.operators import selection as S
from corpusflow.operators.joins import cyclic_pairing
from corpusflow.operators.windows import early_stop_fold, round_robin_panel

VOCAB = Vocabulary(("A", "B", "C"))


def records(spark, rows):
    return spark.createDataFrame(rows, "id string, labels array<string>")


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(f"h{i:02d}", ["No Finding"]) for i in range(10)]
    rows += [(f"s{i}", [["A", "B", "C"][i % 3]]) for i in range(8)]
    rows += [(f"m{i}", ["A", "B"] if i % 2 else ["B", "C"]) for i in range(7)] + [("o1", ["Other"])]
    return records(spark, rows)


def test_weighted_draws_follow_weights(spark):
    df = spark.createDataFrame([(f"r{i:03d}", 300.0 if i == 7 else float(i % 3)) for i in range(200)], "id string, w double")
    drawn = P.sample_weighted(df, "id", F.col("w"), 20_000, 1)
    counts = Counter(r.id for r in drawn.collect())
    total = 300 + sum(i % 3 for i in range(200) if i != 7)
    assert sum(counts.values()) == 20_000 and "r000" not in counts
    assert counts["r007"] / 20_000 == pytest.approx(300 / total, abs=0.015)
    assert counts["r002"] / 20_000 == pytest.approx(2 / total, abs=0.004)


def test_weighted_draws_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"r{i:03d}", float(i % 7) + (500 if i == 50 else 0)) for i in range(300)], "id string, w double")
    one = sorted(map(tuple, P.sample_weighted(df, "id", F.col("w"), 2000, 9).collect()))
    many = sorted(map(tuple, P.sample_weighted(df.repartition(9), "id", F.col("w"), 2000, 9).collect()))
    assert one == many


def test_one_heavy_row_among_light_ones(spark):
    light = spark.range(1_000_000).select((F.col("id") + 1).alias("id"), F.lit(1e-9).alias("w"))
    df = light.unionByName(spark.createDataFrame([(0, 5e-4)], "id long, w double"))
    counts = P.sample_weighted(df, "id", F.col("w"), 4000, 5).groupBy((F.col("id") == 0).alias("heavy")).count().collect()
    assert {r.heavy: r["count"] for r in counts}[True] / 4000 == pytest.approx(1 / 3, abs=0.04)


def test_tiny_and_unusable_weights(spark):
    df = spark.createDataFrame([("a", 4e-7), ("b", 3e-7), ("c", 0.0), ("d", None), ("e", float("nan")), ("f", -1.0), ("g", float("inf"))], "id string, w double")
    counts = Counter(r.id for r in P.sample_weighted(df, "id", F.col("w"), 7000, 3).collect())
    assert set(counts) == {"a", "b"} and counts["a"] / 7000 == pytest.approx(4 / 7, abs=0.03)


def test_empty_pools(pool):
    none = pool.limit(0)
    assert P.sample_uniform(none, "id", 0, 1).count() == 0
    for draw in (lambda: P.sample_uniform(none, "id", 3, 1), lambda: P.sample_weighted(none, "id", F.lit(1.0), 3, 1),
                 lambda: P.sample_label_quota(none, "id", "labels", VOCAB.labels, 3, 1)):
        with pytest.raises(ValueError):
            draw()


def test_label_quota(pool):
    drawn, targets = P.sample_label_quota(pool, "id", "labels", VOCAB.labels, 100, 3)
    assert {r.label: r.n_target for r in targets.collect()} == {"A": 34, "B": 33, "C": 33}
    labels = {r.id: r.labels for r in pool.collect()}
    rows = drawn.collect()
    assert len(rows) == 100 and all(r.label in labels[r.id] for r in rows)


def test_allocate(spark):
    assert P._shares_of(spark.range(1), 10, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}) == {"a": 3, "b": 3, "c": 4}
    assert sum(P._shares_of(spark.range(1), 997, {"x": 0.123, "y": 0.877}).values()) == 997


def test_balanced_mix(pool):
    clean = pool.where(~F.array_contains("labels", "Other"))
    for strategy in ("weighted", "label_quota"):
        mix = P.balanced_mix(clean, VOCAB, 0.5, 7, strategy)
        assert {r.stratum: r["count"] for r in mix.groupBy("stratum").count().collect()} == {"healthy": 12, "pathological": 13}
        assert mix.select("position").distinct().count() == 25
    with pytest.raises(ValueError):
        P.balanced_mix(pool, VOCAB, 0.5, 7)
    with pytest.raises(ValueError):
        P.balanced_mix(clean, VOCAB, 0.5, 7, "other")


def test_stage_mix_keeps_the_size(pool):
    ratios = {"healthy": 0.3, "pathological": 0.6, "other": 0.1}
    mix = P.stage_mix(pool, pool, VOCAB, "clinical", 7, ratios, 0.25)
    n = pool.count()
    assert mix.count() == n
    assert mix.where("task = 'clinical_classification'").count() == round(n * 0.25)
    standard = P.stage_mix(pool, pool, VOCAB, "standard", 7).orderBy("position").collect()
    assert [r.id for r in standard] == sorted(r.id for r in pool.collect())


def test_cyclic_pairing(pool, spark):
    pairs = cyclic_pairing(pool, "id", 11).collect()
    assert len({r.source_id for r in pairs}) == len(pairs) == pool.count() and all(r.id != r.source_id for r in pairs)
    assert sorted(map(tuple, pairs)) == sorted(map(tuple, cyclic_pairing(pool.repartition(6), "id", 11).collect()))
    with pytest.raises(ValueError):
        cyclic_pairing(pool.limit(1), "id", 1)
    with pytest.raises(ValueError):
        cyclic_pairing(pool.unionByName(pool), "id", 1)


def brute_probe(rows, count, tie):
    freq = Counter(l for _, ls in rows for l in ls)
    taken, left, out = Counter(), list(rows), []
    while left and len(out) < count:
        best = max(left, key=lambda r: (sum(1 / ((taken[l] + 1) * math.sqrt(freq[l])) for l in sorted(r[1])), tie[r[0]], r[0]))
        left.remove(best)
        out.append(best[0])
        taken.update(best[1])
    return out


def test_probe(pool, spark):
    from corpusflow.functions.scalars import draw

    got = S.select_probe(pool, "id", "labels", 4, 10, 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.select_probe(pool.repartition(5), "id", "labels", 4, 10, 5).collect()))
    kinds = {k: sorted(r.id for r in got if r.kind == k) for k in ("healthy", "single", "multi")}
    assert {k: len(v) for k, v in kinds.items()} == {"healthy": 4, "single": 6, "multi": 4}
    tie = {r.id: r.t for r in pool.select("id", draw(5, F.col("id")).alias("t")).collect()}
    sick = [(r.id, r.labels) for r in pool.collect() if r.labels[0] in "ABC"]
    assert kinds["single"] == sorted(brute_probe([r for r in sick if len(r[1]) == 1], 6, tie))
    assert kinds["multi"] == sorted(brute_probe([r for r in sick if len(r[1]) > 1], 4, tie))
    # The multi pool is short of nothing, the single pool refills it.
    refill = S.select_probe(pool, "id", "labels", 0, 15, 5).collect()
    assert Counter(r.kind for r in refill) == {"single": 8, "multi": 7}
    for bad in ((-1, 3), (0, 0), (20, 11)):
        with pytest.raises(ValueError):
            S.select_probe(pool, "id", "labels", *bad, 5)


def test_panel_round_without_additions_ends_it(spark):
    df = records(spark, [("1", ["A"]), ("2", ["A"]), ("3", ["No Finding"])]).withColumn("t", F.when(F.col("id") == "1", "massa").otherwise("x"))
    got = round_robin_panel(df, "id", "labels", F.col("t"), "massa", 2, 5).collect()
    assert [(r.kind, r.id) for r in got] == [("healthy", "3"), ("pathological", "1")]


def brute_fold(values, mode, delta, patience):
    best = best_step = None
    since = improved = 0
    for step, v in enumerate(values, 1):
        gain = None if v is None else (math.inf if best is None else (v - best if mode == "max" else best - v))
        if gain is not None and gain > delta:
            best, best_step, since, improved = v, step, 0, improved + 1
        else:
            since += 1
        if since >= patience:
            return best_step, best, improved, since, True, step
    return best_step, best, improved, since, False, None


@pytest.mark.parametrize("mode, delta, patience", [("max", 0.0, 3), ("max", 0.4, 5), ("min", 0.25, 4), ("max", 0.1, 1)])
def test_early_stop_fold(spark, monkeypatch, mode, delta, patience):
    import random

    from corpusflow.operators import pointers

    monkeypatch.setattr(pointers, "CHUNK", 4)
    rng = random.Random(4)
    runs = {r: [None if rng.random() < 0.15 else round(rng.random() * 3 + i * 0.1 * (r % 3), 2) for i in range(rng.randrange(1, 40))] for r in range(30)}
    rows = [(r, i, v) for r, vs in runs.items() for i, v in enumerate(vs, 1)]
    got = early_stop_fold(spark.createDataFrame(rows, "run int, step int, value double"), "run", "step", "value", mode, delta, patience).collect()
    assert {g.run: (g.best_step, g.best_value, g.n_improved, g.since_improved, g.stopped, g.stop_step) for g in got} == {
        r: brute_fold(vs, mode, delta, patience) for r, vs in runs.items()}
