"""Registered queries on the smallest tables: against their SQL, or against plain versions."""

from __future__ import annotations

import re
from collections import Counter

import brute
import pytest

import corpus_pipeline
from corpusflow.llm import toxicity
from corpusflow.llm.queries import ORACLES, QUERIES, TOKENIZERS
from corpusflow.llm.tables import table
from corpusflow.queries.compare import canonical, connect, oracle_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = canonical(df.columns, df.collect())
    if name in ORACLES:
        assert got == oracle_rows(con, ORACLES[name])
    elif name.startswith("op7"):
        rows = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
        assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()} == set(brute.repeated_bytes(rows))
    elif name.startswith("op13"):
        want = {r[0]: r for r in brute.aligned([(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()], f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")}
        assert {tuple(r) for r in df.collect()} == set(want.values())
    elif not name.startswith("op9"):
        assert len(got[1]) == table(spark, FOLDER, "documents").count()


def words(text):
    return [w.decode("utf-8", "replace") for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())]


def bag(own):
    return Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))


def holds(text, item):
    target, own = bag(item), words(text)
    if not target.keys() & bag(own).keys():
        return False
    for s in range(max(1, len(own) - len(item) + 1)):
        window = bag(own[s : s + len(item)])
        both = sum((window & target).values())
        if both >= 0.75 * (sum(window.values()) + sum(target.values()) - both):
            return True
    return False


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before kept, against plain versions."""
    docs = table(spark, FOLDER, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    scored = toxicity.score_toxicity(docs, table(spark, FOLDER, "labels")).collect()
    want = {r.doc_id for r in scored if not r.predicted}
    items = [words(r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        if name == "exact_dedup":
            keep = {rows[d]: d for d in sorted(want)}
            want = set(keep.values())
        elif name == "ngram_jaccard":
            groups = brute.similar_groups([(d, rows[d]) for d in sorted(want)])
            want = {d for d, n, root in groups if n == 0 or d == root}
        elif name == "decontamination":
            want = {d for d in want if not any(holds(rows[d], item) for item in items)}
        out = stage(spark, docs, FOLDER)
        assert out.columns[: len(docs.columns)] == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert {r.doc_id for r in docs.collect()} == want and docs.count() == len(want), name
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "rate"]
    assert docs.where("rate IS NULL OR rate < 0").isEmpty()
    again = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in again.collect()} == want
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "mixing"]
