"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import align, archives, coordinates, decontaminate, fmindex, mixing, parity, ppm, quotient, resample, secrets, suffixarray, toxicity
from corpusflow.llm.queries import TOKENIZERS

CLASHING = ["body", "print", "key", "ref", "anchors", "sig", "label_id", "is_toxic", "word", "copies", "rate", "gone", "dropped", "sha", "chunk", "domain", "n_tokens"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n))


LONG = prose(1, 60_000)
PASSAGE = prose(2, 70)
ROWS = [
    (1, prose(3, 50) + " " + PASSAGE), (2, PASSAGE + " " + prose(4, 90)), (3, prose(5, 40)), (3, prose(5, 40)), (4, prose(5, 40)),
    (5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "One  TWO"), (10, LONG), (11, LONG + " end"), (12, "é" * 450), (13, "aaaa " * 300), (14, "ß"), (15, "1 2 3"),
]
NULL_ID = (None, prose(6, 60))


def frame(spark, rows):
    """documents with nulls in other columns, and columns named as the operators name theirs."""
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [*ROWS, NULL_ID]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, ROWS).limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 1), (None, 1, 1), (3, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


def ids(rows):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)


EXPECTED_IDS = sorted((i is not None, i or 0) for i, _ in [*ROWS, NULL_ID])


def test_exact(docs, empty):
    got = quotient.exact_groups(docs).collect()
    assert ids(got) == EXPECTED_IDS
    groups = {}
    for i, t in [*ROWS, NULL_ID]:
        groups.setdefault(t or "", []).append(i)
    for r in got:
        text = next(t or "" for i, t in [*ROWS, NULL_ID] if i == r.doc_id)
        own = groups[text]
        keep = max((i for i in own if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(own), r.doc_id == keep, hashlib.sha256(text.encode()).hexdigest())
    assert quotient.exact_groups(empty).count() == 0
    kept = quotient.keep_one_copy(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, _ in [*ROWS, NULL_ID] if i not in (3, 5))


def test_exact_repeated_rows_tie(spark):
    got = quotient.exact_groups(frame(spark, [(1, "x"), (2, "x"), (2, "x"), (None, "x"), (None, "y"), (None, "y")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 2, True), (0, 0, 2, True), (0, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True)]


def test_similar(docs, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in parity.similar_groups(docs).collect() if r.doc_id is not None}
    assert got == set(brute.similar_groups([r for r in ROWS]))
    assert parity.similar_groups(docs).count() == len(ROWS) + 1
    assert parity.similar_groups(empty).count() == 0
    kept = parity.keep_one_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, _ in [*ROWS, NULL_ID] if i not in (4, 9, 11))


def test_similar_null_ids(spark):
    got = parity.similar_groups(frame(spark, [(None, prose(1, 80)), (None, prose(1, 79)), (7, prose(2, 80)), (None, prose(2, 79))])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 7), (7, 7)]


def test_words(docs, empty):
    got = fmindex.remove_repeated_words(docs).collect()
    want = brute.repeated_words([(10**9 if i is None else i, t) for i, t in [*ROWS, NULL_ID]])
    assert ids(got) == EXPECTED_IDS
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[10**9 if r.doc_id is None else r.doc_id]
    assert fmindex.remove_repeated_words(empty).count() == 0


def test_bytes(docs, empty):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixarray.remove_repeated_bytes(docs).collect())
    assert got == sorted(brute.repeated_bytes([(i or 0, t) for i, t in [*ROWS, NULL_ID]]))
    assert suffixarray.remove_repeated_bytes(empty).count() == 0


def test_secrets(docs, empty):
    got = secrets.find_secrets(docs).collect()
    assert ids(got) == EXPECTED_IDS
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got if r.doc_id in (5, 6, 7))
    assert secrets.find_secrets(empty).count() == 0


def test_toxicity(docs, empty, labels):
    got = toxicity.score_toxicity(docs, labels).collect()
    assert ids(got) == EXPECTED_IDS
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    none = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(got) and all(r.score == 0 for r in none)
    kept = toxicity.drop_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(got)


def test_language(spark, docs, empty):
    got = ppm.identify(docs).collect()
    assert ids(got) == EXPECTED_IDS and all(r.lang_pred == "und" and r.score == 0 for r in got)
    known = docs.withColumn("lang", F.when(F.col("doc_id").isNull() | (F.col("doc_id") % 2 == 0), "aa").otherwise("bb"))
    got = {r.doc_id: r for r in ppm.identify(known).collect()}
    assert {r.lang_pred for i, r in got.items() if i in (5, 6, 7, 15)} == {"und"}
    assert {r.lang_pred for i, r in got.items() if i not in (5, 6, 7, 15)} <= {"aa", "bb"}
    assert ppm.identify(empty).count() == 0


def test_benchmark(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "one two"), (5, prose(77, 30)), (None, prose(5, 40)), (7, PASSAGE.upper())], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0, round(r.similarity, 3)) for r in decontaminate.find_items(docs, items).collect())
    assert got == [(1, 1, 1.0), (1, 7, 1.0), (2, 1, 1.0), (2, 7, 1.0), (3, 0, 1.0), (3, 0, 1.0), (4, 0, 1.0), (8, 4, 1.0), (9, 4, 1.0)]
    assert decontaminate.find_items(empty, items).count() == 0
    assert decontaminate.find_items(docs, items.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, _ in [*ROWS, NULL_ID] if i not in (1, 2, 3, 4, 8, 9))


def test_mixing(docs, empty, labels):
    got = mixing.mix_to_targets(docs, labels).collect()
    assert ids(got) == EXPECTED_IDS
    assert all(r.rate >= 0 and abs(r.share_good + r.share_poor + r.share_toxic - 1) < 1e-9 for r in got)
    assert all(r.rate == 1 and r.n_tokens == 0 for r in got if r.doc_id in (5, 6, 7))
    assert mixing.mix_to_targets(empty, labels).count() == 0
    none = mixing.mix_to_targets(docs, labels.limit(0)).collect()
    assert all(abs(r.share_good - 1 / 3) < 1e-9 for r in none)
    rated = mixing.with_rates(docs, labels)
    assert rated.columns == [*docs.columns, "rate_"] and rated.count() == len(got) and rated.where("rate_ IS NULL").count() == 0


def test_archives(spark):
    rows = [(1, "http://a/\r\nx é", "x" * 1500), (2, None, "x" * 1500), (2, "u", "x" * 1500), (None, "u", "x" * 1500), (3, "u", None), (4, "u", ""), (5, "", "short"), (6, "u", "short"), (7, "u", "é" * 500_000), (8, "u", "é" * 500)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, keep string")
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archives.round_trip(pages).collect())
    keep = {"x" * 1500: 2}
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        other = len(b) >= 1000 and h in keep and i != keep[h]
        want.append((i or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other else "response", keep[h] if other else None))
    assert got == sorted(want)
    assert archives.round_trip(pages.limit(0)).count() == 0


def test_resampled(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string")
    got = resample.resample(docs, items, percent=50).collect()
    assert ids(got) == EXPECTED_IDS
    once = {i: t for i, t in ROWS}  # the repeated row of id 3 ties with itself
    want = brute.resampled([*once.items()], [PASSAGE], percent=50)
    assert {r.doc_id for r in got if r.n_features >= 20} == {d for d, n, *_ in want if n >= 20} | {None}
    drawn = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, sum(r.n_features >= 20 for r in got) // 2 + 1))
    assert [-r.score for r in drawn] == sorted(-r.score for r in got if r.n_features >= 20)[: len(drawn)]
    assert all((r.n_features, r.weight) == (0, 0) for r in got if r.doc_id in (5, 6, 7))
    assert resample.resample(empty, items).count() == 0
    assert all(r.rank is None for r in resample.resample(docs.where("doc_id = 5"), items).collect())
    assert len(resample.resample(docs, items.limit(0)).collect()) == len(got)


@pytest.mark.parametrize("run", [1, 2])
def test_resampled_brute(spark, run):
    low, high = -(2**63), 2**63 - 1  # ids over the whole range of longs
    rows = [(low, prose(1, 30)), (high, prose(1, 30)), *((i, prose(i % 9, 18 + i % 7) + " É日本 x" * (i % 3)) for i in range(-40, 60))]
    target = [prose(2, 40), "x É日本"]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(frame(spark, rows), items, run=run, percent=60).collect()
    assert {tuple(r) for r in got} == brute.resampled(rows, target, run=run, percent=60)


def test_near_duplicates(docs, empty):
    got = [r for r in coordinates.near_duplicates(docs).collect()]
    assert ids(got) == EXPECTED_IDS
    want = set(brute.similar_groups(ROWS, percent=85))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert coordinates.near_duplicates(empty).count() == 0


def test_near_duplicates_patterned_words(spark):
    """Words of the Thue-Morse pattern and its complement differ, whatever their length."""
    for bits in (3, 11, 12):
        signs = [bin(k).count("1") & 1 for k in range(1 << bits)]
        a, b = "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)
        got = coordinates.near_duplicates(frame(spark, [(1, a), (2, b), (3, f"{a} {a} {b}"), (4, f"{a} {a} {a}")])).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_aligned(spark, docs, empty):
    paths = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
    odd = [(20, " leading"), (21, "<|endoftext|> <s> </s> <0x0A>"), (22, "a\u2581b"), (23, "\u0000\t\r\n  x  "), (24, "e\u0301 \U0001f600\ufeff 日本語 ")]
    rows = [r for r in ROWS if r[0] not in (10, 11)] + odd
    got = align.align_tokens(frame(spark, rows), *paths).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.aligned(rows, *paths))
    got = align.align_tokens(docs, *paths).collect()
    assert ids(got) == EXPECTED_IDS
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in got if r.doc_id in (5, 6))
    assert align.align_tokens(empty, *paths).count() == 0
    assert [tuple(r)[1:] for r in align.align_tokens(docs.where("doc_id IN (5, 6)"), *paths).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
