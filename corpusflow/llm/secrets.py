"""Secret scans: fixed patterns, and runs that look random to character Markov models.

Two character models are trained from labelled samples: of random strings (the
values that the fixed patterns find) and of ordinary words and identifiers
(every other run). A run that no pattern covers is a secret when the log
likelihood ratio of the two models is high.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import small_batches

# The patterns and least lengths of the query's contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "markov")

#: Characters the models tell apart; any other run ends at the character.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
LONG_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
EDGE = len(ALPHABET)  # before the first and after the last character
SIZE = EDGE + 1

MIN_LENGTH = 20
MIN_RATIO = 12.0  # nats: a random string must be e**12 times likelier
SMOOTHING = 0.5

_CODES = np.full(256, EDGE, dtype=np.int64)
_CODES[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(EDGE)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns; leftmost, non-overlapping per kind, in code points.

    A hex or access match is a maximal run, so asking for its least length in
    the pattern finds the same as dropping short runs; a short assigned value
    is still consumed.
    """
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def _values(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The random strings of base spans: the assigned value, not its name."""
    return [re.split(r"[:=]", text[i:j], maxsplit=1)[1].strip(" \"'") if k == 0 else text[i:j] for i, j, k in spans]


def pair_counts(words: bytes) -> np.ndarray:
    """Counts of character pairs in runs that any other byte separates, edges included."""
    codes = _CODES[np.frombuffer(b" " + words + b" ", dtype=np.uint8)]
    pairs = codes[:-1] * SIZE + codes[1:]
    counts = np.bincount(pairs, minlength=SIZE * SIZE)
    counts[EDGE * SIZE + EDGE] = 0  # two separators are no run
    return counts


def training_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pair counts over every whole text: random (base values) and ordinary (all that is left).

    Rows (pair, random, ordinary): at most one per pair and task before the sum.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random, ordinary = np.zeros(SIZE * SIZE, np.int64), np.zeros(SIZE * SIZE, np.int64)
        for batch in small_batches(batches):
            for body in batch.column(0).to_pylist():
                if not body:
                    continue
                spans = base_spans(body)
                if spans:
                    random += pair_counts(" ".join(_values(body, spans)).encode("utf-8"))
                    rest, at = [], 0
                    for i, j, _ in spans:
                        rest.append(body[at:max(at, i)])
                        at = max(at, j)
                    body = " ".join([*rest, body[at:]])
                ordinary += pair_counts(body.encode("utf-8", "replace"))
        seen = np.flatnonzero(random + ordinary)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(random[seen]), pa.array(ordinary[seen])], names=["pair", "random", "ordinary"])

    return (docs.select(F.col(text)).mapInArrow(count, "pair long, random long, ordinary long")
            .groupBy("pair").agg(F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary")))


def ratio_table(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """log P(next | previous, random) - log P(next | previous, ordinary), from smoothed counts."""
    both = np.full((2, SIZE * SIZE), SMOOTHING)
    for pair, random, ordinary in counts:
        both[0, pair] += random
        both[1, pair] += ordinary
    both = both.reshape(2, SIZE, SIZE)
    logs = np.log(both) - np.log(both.sum(axis=2, keepdims=True))
    return logs[0] - logs[1]


def run_ratio(run: str, table: np.ndarray) -> float:
    codes = _CODES[np.frombuffer(f" {run} ".encode(), dtype=np.uint8)]
    return float(table[codes[:-1], codes[1:]].sum())


def markov_spans(text: str, base: list[tuple[int, int, int]], table: np.ndarray, min_length: int, min_ratio: float) -> list[tuple[int, int, int]]:
    """Long runs outside the base spans that the random model explains better."""
    out = []
    for m in (LONG_RUN if min_length >= 20 else RUN).finditer(text):
        i, j = m.span()
        if j - i < min_length or any(a < j and i < b for a, b, _ in base):
            continue
        if run_ratio(m.group(), table) >= min_ratio:
            out.append((i, j, 3))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, j, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find_secrets(docs: DataFrame, text: str = "text", id: str = "doc_id", min_length: int = MIN_LENGTH, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    ``spans`` joins kind:start:end (code points, end exclusive) by start, then
    kind; ``base_sha256`` hashes the same string of the fixed patterns alone.
    A null text counts as empty and has no spans; a null id stays null, rows
    that repeat are scanned alike, an empty table gives no rows, and other
    columns are not read. With no base span at all the random model is the
    smoothing alone. The models are two tables of fixed size (68 x 68), summed
    over all texts.
    """
    counts = [tuple(r) for r in training_counts(docs, text).collect()]  # at most 68 * 68 rows
    table = ratio_table(counts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            for body in batch.column(1).to_pylist():
                body = body or ""
                base = base_spans(body)
                model = markov_spans(body, base, table, min_length, min_ratio)
                kinds = [k for _, _, k in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + model), len(model)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")
