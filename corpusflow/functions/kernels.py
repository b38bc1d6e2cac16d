"""Arrow kernels for pair statistics that array expressions cannot give in linear time.

Each kernel looks at one row's two texts and returns counts; everything above
the row (sums, means, groups, resamples) is left to Spark.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import alnum_key, squash_ws

BLEU_ORDERS = (1, 2, 3, 4)
BLEU_COLUMNS = ["pred_len", "ref_len", *(f"{k}_{n}" for n in BLEU_ORDERS for k in ("match", "guess"))]
NGRAM_COLUMNS = ["pred_len", "ref_len", "overlap_1", "overlap_2"]
LCS_COLUMNS = ["pred_len", "ref_len", "lcs"]
# About how many characters of text one counting pass holds as tokens.
PASS_CHARS = 250_000
# Tokens of one block of bits of a common subsequence, and bits that cost about as much as one match.
LCS_BLOCK, MATCH_BITS = 8192, 2048


def _tokens(text: str) -> list[str]:
    """Tokens of a squashed text: white space is single blanks, none at the ends."""
    return text.split(" ") if text else []


def _passes(pred: pd.Series, ref: pd.Series) -> Iterator[tuple[list[list[str]], list[list[str]]]]:
    """Token lists of consecutive pairs, whole pairs each, of bounded size together."""
    ps, rs, size = [], [], 0
    for p, r in zip(pred, ref):
        ps.append(_tokens(p))
        rs.append(_tokens(r))
        size += len(p) + len(r)
        if size >= PASS_CHARS:
            yield ps, rs
            ps, rs, size = [], [], 0
    if ps:
        yield ps, rs


def _sizes(lists: list[list[str]]) -> np.ndarray:
    return np.fromiter(map(len, lists), dtype="int64", count=len(lists))


def shared_grams(preds: list[list[str]], refs: list[list[str]], orders: int) -> list[np.ndarray]:
    """Clipped n-gram matches of every pair, one array per order 1 .. ``orders``.

    All pairs are counted together: a gram is numbered by its pair, its first
    n-1 tokens and its last token, so equal numbers are equal grams of a pair.
    """
    n = len(preds)
    sizes = np.concatenate([_sizes(preds), _sizes(refs)])
    flat = np.fromiter(chain(chain.from_iterable(preds), chain.from_iterable(refs)), dtype=object, count=int(sizes.sum()))
    token = pd.factorize(flat)[0].astype("int64")
    text = np.repeat(np.arange(2 * n), sizes)
    width = int(token.max()) + 1 if len(token) else 1
    gram, out = text % n if n else text, []
    for order in range(orders):
        inside = text[: len(text) - order] == text[order:] if order else np.ones(len(text), dtype=bool)
        keep = np.flatnonzero(inside)
        gram = pd.factorize(gram[keep] * width + token[keep + order])[0].astype("int64")
        pair, is_pred = text[keep] % n if n else text[keep], text[keep] < n
        kinds = int(gram.max()) + 1 if len(gram) else 0
        both = np.minimum(np.bincount(gram[is_pred], minlength=kinds), np.bincount(gram[~is_pred], minlength=kinds))
        owner = np.zeros(kinds, dtype="int64")
        owner[gram] = pair
        out.append(np.bincount(owner, weights=both, minlength=n).astype("int64"))
        # Grams of the next order start where grams of this one do.
        whole = np.full(len(text), -1, dtype="int64")
        whole[keep] = gram
        gram = whole
    return out


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence.

    Common ends belong to one and are cut off. Of the rest, few matches are
    followed one by one, many are taken a block of bits at a time.
    """
    ends = 0
    while ends < min(len(a), len(b)) and a[ends] == b[ends]:
        ends += 1
    a, b, tail = a[ends:], b[ends:], 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    counts = Counter(a)
    matches = sum(counts[t] for t in b)
    # A match costs about as much as a row of this many bits.
    dense = matches * MATCH_BITS > len(a) * len(b)
    return ends + tail + (lcs_by_bits(a, b) if dense else lcs_by_matches(a, b))


def lcs_by_matches(a: list[str], b: list[str]) -> int:
    """The longest rising run through match positions: time by the number of matches, memory by the shorter list."""
    where: dict[str, list[int]] = {}
    for i in range(len(a) - 1, -1, -1):
        where.setdefault(a[i], []).append(i)
    ends: list[int] = []  # the least end of a common run of each length
    for token in b:
        for i in where.get(token, ()):  # from the last on, so a token is used once
            at = bisect_left(ends, i)
            if at == len(ends):
                ends.append(i)
            else:
                ends[at] = i
    return len(ends)


def lcs_by_bits(a: list[str], b: list[str]) -> int:
    """One bit per token of ``a``, a block of them at a time; carries of the rows go from block to block."""
    carries, length = bytearray(len(b)), 0
    for low in range(0, len(a), LCS_BLOCK):
        block = a[low : low + LCS_BLOCK]
        where: dict[str, int] = {}
        for i, token in enumerate(block):
            where[token] = where.get(token, 0) | (1 << i)
        width, full = len(block), (1 << len(block)) - 1
        row = full
        for j, token in enumerate(b):
            hit = row & where.get(token, 0)
            total = row + hit + carries[j]
            carries[j] = total >> width
            row = (total | (row - hit)) & full
        length += width - row.bit_count()
    return length


def _counts(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in columns])


@F.pandas_udf(_counts(BLEU_COLUMNS))
def _bleu_kernel(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    parts = [np.empty((0, len(BLEU_COLUMNS)), dtype="int64")]
    for ps, rs in _passes(pred, ref):
        matches = shared_grams(ps, rs, len(BLEU_ORDERS))
        lengths = _sizes(ps)
        cells = chain.from_iterable((matches[n - 1], np.maximum(lengths - n + 1, 0)) for n in BLEU_ORDERS)
        parts.append(np.column_stack([lengths, _sizes(rs), *cells]))
    return pd.DataFrame(np.concatenate(parts), columns=BLEU_COLUMNS)


@F.pandas_udf(_counts(NGRAM_COLUMNS))
def _ngram_kernel(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    parts = [np.empty((0, len(NGRAM_COLUMNS)), dtype="int64")]
    for ps, rs in _passes(pred, ref):
        parts.append(np.column_stack([_sizes(ps), _sizes(rs), *shared_grams(ps, rs, 2)]))
    return pd.DataFrame(np.concatenate(parts), columns=NGRAM_COLUMNS)


@F.pandas_udf(_counts(LCS_COLUMNS))
def _lcs_kernel(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    parts = [np.empty((0, len(LCS_COLUMNS)), dtype="int64")]
    for ps, rs in _passes(pred, ref):
        common = np.fromiter(map(lcs_length, ps, rs), dtype="int64", count=len(ps))
        parts.append(np.column_stack([_sizes(ps), _sizes(rs), common]))
    return pd.DataFrame(np.concatenate(parts), columns=LCS_COLUMNS)


def bleu_stats(prediction: Column, reference: Column) -> Column:
    """Clipped n-gram matches, guesses and lengths of one pair (white-space tokens)."""
    return _bleu_kernel(squash_ws(prediction), squash_ws(reference))


def ngram_stats(prediction: Column, reference: Column) -> Column:
    """Unigram and bigram overlap and lengths (a-z0-9 tokens)."""
    return _ngram_kernel(alnum_key(prediction), alnum_key(reference))


def lcs_stats(prediction: Column, reference: Column) -> Column:
    """Common subsequence and lengths (a-z0-9 tokens)."""
    return _lcs_kernel(alnum_key(prediction), alnum_key(reference))
