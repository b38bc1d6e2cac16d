"""Parts of resampling, of the coordinate join and of token alignment against plain versions."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm import align, coordinates, radix, resample
from corpusflow.llm.queries import TOKENIZERS


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=20))
def test_crc_of_ranges(pieces):
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    edges = np.r_[0, np.cumsum([len(p) for p in pieces])].astype(np.int64)
    assert resample.crc32_ranges(data, edges[:-1], edges[1:]).tolist() == [zlib.crc32(p) for p in pieces]


@pytest.mark.parametrize("size", [1, 7, 1 << 10])
def test_radix_ranks(spark, monkeypatch, size):
    """One value of a digit holds nearly all rows; keys are wide, negative and repeated; blocks are small."""
    monkeypatch.setattr(radix, "LEAST_BLOCK", size)
    monkeypatch.setattr(radix, "MOST_BLOCK", max(size, 16))
    rng = random.Random(size)
    rows = [(rng.choice([5, 5, 5, 5, 5, 5, 4, 900]), rng.choice([-(2**63), 2**63 - 1, rng.randrange(-(2**62), 2**62)]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(5)
    got = radix.radix_ranks(df, [("a", 4, 900), ("b", -(2**63), 2**63 - 1)]).collect()
    assert sorted((r.a, r.b, r.c) for r in got) == sorted(rows)
    assert sorted(r["rank"] for r in got) == list(range(1, 301))
    keys = [(r.a, r.b) for r in sorted(got, key=lambda r: r["rank"])]
    assert keys == sorted(keys)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 200), min_size=1), st.sets(st.integers(0, 200), min_size=1), st.data())
def test_gallop(values, into, data):
    values, into = np.array(sorted(values)), np.array(sorted(into))
    start = np.array(data.draw(st.lists(st.integers(0, len(into) - 1), min_size=len(values), max_size=len(values))))
    assert align.gallop(values, into, start).tolist() == np.searchsorted(into, values).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=6), st.lists(st.integers(0, 5), min_size=1, max_size=6), st.integers(0, 2)), min_size=1, max_size=12), st.sampled_from([1, 4, 1 << 21]))
def test_linked_pairs(groups, held):
    groups.sort(key=lambda g: g[2])
    before, align.HELD_LINKS = align.HELD_LINKS, held
    try:
        a, b = (np.array(sum((g[k] for g in groups), [])) for k in (0, 1))
        ends = [np.cumsum([len(g[k]) for g in groups]) for k in (0, 1)]
        text = np.repeat([g[2] for g in groups], [len(g[0]) for g in groups])
        key, times = align.linked_pairs(a, b, text, *ends, 10, 100)
    finally:
        align.HELD_LINKS = before
    want = {}
    for x, y, t in groups:
        for i in x:
            for j in y:
                want[t * 100 + i * 10 + j] = want.get(t * 100 + i * 10 + j, 0) + 1
    assert dict(zip(key.tolist(), times.tolist(), strict=True)) == want and key.tolist() == sorted(want)


@given(st.sets(st.integers(0, 10**6)), st.integers(1, 10**9))
def test_packed_places(places, most):
    places = np.array(sorted(places), dtype=np.int64)
    times = np.random.default_rng(1).integers(1, most + 1, len(places))
    back = align.unpacked(align.packed(places, times))
    assert back[0].tolist() == places.tolist() and back[1].tolist() == times.tolist()


def test_byte_level_by_rank_is_the_tokenizer():
    """The fast path gives what the tokenizer of the file gives, for every character in several surroundings."""
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    points = [c for c in [*range(0x3100), *range(0xA000, 0xD800, 16), *range(0xE000, 0x20000, 8)] if not 0xD800 <= c < 0xE000]
    texts = [f" a{chr(c)}b1{chr(c)}2 {chr(c)}{chr(c)}. {chr(c)}'s{chr(c)} " for c in points]
    assert align.byte_level(path).encode(texts) == [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]


def test_least_matches():
    """A pair at the threshold passes but for the stated chance; one match more would miss more."""
    from math import comb

    for count in (16, 64, 128):
        least = coordinates.least_matches(count, 85)
        below = [sum(comb(count, k) * 0.85**k * 0.15 ** (count - k) for k in range(m)) for m in (least, least + 1)]
        assert below[0] <= coordinates.MISSED < below[1]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    pool = coordinates.mix(np.arange(1, 4001, dtype=np.uint64))
    for shared in (200, 600, 900):
        own = rng.permutation(pool)
        a, b = own[:1000], np.concatenate([own[:shared], own[1000 : 2000 - shared]])
        both = coordinates.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 2048)
        assert abs((both[0] == both[1]).mean() - shared / (2000 - shared)) < 0.05


def test_word_names():
    words = ["a", "b", "ab", "ba", "x" * 7, "x" * 8, "x" * 9, "x" * 300, "x" * 301, "é", "日本"]
    part = next(coordinates.text_slices(pa.array([" ".join(words), " ".join(words).upper()])))
    names, first = coordinates.word_names(part)
    assert first.tolist() == [0, len(words), 2 * len(words)]
    assert len(set(names[: len(words)].tolist())) == len(words)
    assert names[: len(words) - 2].tolist() == names[len(words) : -2].tolist()  # only A-Z is folded


def family(rng, base, n, changes):
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("leaders,block", [(32, 512), (1, 8)])
def test_large_lists(spark, monkeypatch, leaders, block):
    """Families that share most of their shingles with each other: what leaders leave open is found in blocks."""
    monkeypatch.setattr(coordinates, "LEADERS", leaders)
    monkeypatch.setattr(coordinates, "BLOCK", block)
    monkeypatch.setattr(coordinates, "TASK_MEMBERS", 40)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(300)]
    texts = []
    for _ in range(6):
        own = list(base)
        for k in rng.sample(range(300), 8):
            own[k] = f"f{rng.randrange(10**6)}"
        texts += family(rng, own, 25, 6)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in coordinates.near_duplicates(df).collect()}
    assert got == set(brute.similar_groups(rows, percent=85))
