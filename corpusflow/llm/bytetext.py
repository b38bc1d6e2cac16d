"""Arrow text columns as byte arrays: words, word hashes and shingles without per-word Python.

Everything here works on a slice of an Arrow string column (the bytes of many
texts in one array, plus their offsets), so the cost of a call is shared by
the texts of the slice. Slices are cut by bytes; one very long text is a slice
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_POWERS = {}
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(fold_case: bool) -> np.ndarray:
    """One 64-bit value per byte; with ``fold_case`` A-Z share those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    if fold_case:
        values[65:91] = values[97:123]
    return values


def space_bytes() -> np.ndarray:
    """The bytes that end a word: the blank and 0x09 to 0x0D."""
    table = np.zeros(256, dtype=bool)
    table[[0x20, 9, 10, 11, 12, 13]] = True
    return table


def letter_bytes() -> np.ndarray:
    """The bytes between words when only letters and digits make words."""
    table = np.ones(256, dtype=bool)
    table[48:58] = table[65:91] = table[97:123] = False
    table[128:] = False
    return table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if _POWERS.get("n", 0) < n:
        base = 0xD6E8FEB86659FD93
        inverse = pow(base, -1, 1 << 64)
        size = max(n, SLICE_BYTES + 1)
        both = []
        for step in (base, inverse):
            powers = np.full(size, step, dtype=np.uint64)
            powers[0] = 1
            both.append(np.multiply.accumulate(powers))
        _POWERS.update(n=size, both=both)
    return _POWERS["both"]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that copies of their texts stay small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


@dataclass
class Slice:
    """Texts ``first`` to ``first + len(bounds) - 1`` of a batch, as bytes."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def count(self) -> int:
        return len(self.bounds) - 1


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The bytes of a string column, cut between texts; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield Slice(at, raw[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at])
        at = stop


def word_spans(part: Slice, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of a slice, and the first word of each text.

    The last array has one entry more than there are texts; no word crosses texts.
    """
    n = len(part.data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = ~gaps[part.data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1] if n else False
    ends = inside[:n] & ~inside[1:]
    cuts = part.bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, part.bounds)


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running polynomial hash of a byte array, one entry more than it has bytes."""
    powers, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers[: len(data)], out=out[1:])
    return out


def range_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range; equal bytes give equal hashes wherever they stand."""
    _, inverse = _powers(len(running))
    return mix((running[end] - running[start]) * inverse[start])


def word_hashes(part: Slice, gaps: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of a slice, and the first word of each text."""
    start, end, first = word_spans(part, gaps)
    return range_hash(prefix_hash(part.data, values), start, end), first


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; too late positions are left out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * 0xA0761D6478BD642F % (1 << 64)
        out += words[k : k + n] * np.uint64(factor)
    return mix(out)


def per_text_windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``size`` words inside one text: hash, start word, and text of the slice.

    A text with fewer words, but at least one, has one window: all its words.
    """
    lengths = np.diff(first)
    hashes = window_hashes(words, size)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    whole = np.zeros(len(words), dtype=bool)
    whole[: len(hashes)] = owner[: len(hashes)] == owner[size - 1 : size - 1 + len(hashes)] if len(hashes) else False
    start = np.flatnonzero(whole)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if not len(short):
        return hashes[start], start, owner[start]
    extra = np.array([window_hashes(words[first[t] : first[t + 1]], int(lengths[t]))[0] for t in short], dtype=np.uint64)
    starts = np.concatenate([start, first[short]])
    order = np.argsort(starts, kind="stable")
    values = np.concatenate([hashes[start], mix(extra + np.uint64(1))])
    return values[order], starts[order], np.concatenate([owner[start], short])[order]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers as Spark's signed longs."""
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)
