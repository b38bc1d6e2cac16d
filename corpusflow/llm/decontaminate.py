"""Benchmark items found in documents: SimHash of item-sized windows, multi-index search, exact check.

A window has as many words as the item. Its fingerprint is the SimHash of its
word shingles; items within the Hamming radius are found by a multi-index (if
two fingerprints of 8 bytes differ in at most 23 bits, some byte differs in at
most 2), and the weighted Jaccard similarity of the shingles, with their counts
as weights, decides. A window that shares no shingle with any item has
similarity 0 with all, so only windows around shared shingles are fingerprinted;
all of those are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import byte_values, letter_bytes, small_batches, text_slices, window_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.75
#: Similarity 0.75 is a cosine of 0.86, so 11 of 64 bits differ on average, with a deviation of 3.
RADIUS = 23
BLOCKS, BLOCK_RADIUS = 8, 2
#: Items are sent to the tasks in blocks of at most so many.
ITEMS_AT_ONCE = 2048
_GAPS = letter_bytes()
_VALUES = byte_values(fold_case=True)
_CHUNK = 2048
_BITS = np.array([bin(k).count("1") for k in range(256)], dtype=np.uint8)


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Fingerprints, as 8 bytes each, of rows of shingle hashes: the majority of each bit; a tie gives 0."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(*shingles.shape, 8), axis=-1)
    return np.packbits(bits.sum(axis=1, dtype=np.int32) * 2 > shingles.shape[1], axis=-1)


@dataclass
class Items:
    """Items with the same number of words."""

    words: int
    ids: list
    shingles: list[np.ndarray]

    def __post_init__(self):
        self.size = min(SHINGLE, self.words)
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        prints = np.concatenate([simhash(s[None, :]) for s in self.shingles])
        wide = (len(self.ids) + 7) // 8
        near = np.zeros((BLOCKS, 256, wide), dtype=np.uint8)  # block value -> items within the block radius
        values = np.arange(256, dtype=np.uint8)
        for k, p in enumerate(prints):
            for b in range(BLOCKS):
                near[b, _BITS[values ^ p[b]] <= BLOCK_RADIUS, k >> 3] |= 1 << (k & 7)
        self.prints, self.near = prints, near

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs of fingerprints within the radius."""
        found = self.near[0, prints[:, 0]]
        for b in range(1, BLOCKS):
            found = found | self.near[b, prints[:, b]]
        window, item = np.nonzero(np.unpackbits(found, axis=1, bitorder="little")[:, : len(self.ids)])
        distance = _BITS[prints[window] ^ self.prints[item]].sum(axis=1)
        near = distance <= RADIUS
        return window[near], item[near], distance[near]


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def item_groups(items: list[tuple]) -> list[Items]:
    """(id, text) rows grouped by their number of words; items without words match nothing."""
    by: dict[int, Items] = {}
    rows: dict[int, list] = {}
    for item, text in items:
        for part in text_slices(pa.array([text], pa.string())):
            words, _ = word_hashes(part, _GAPS, _VALUES)
            if len(words):
                rows.setdefault(len(words), []).append((item, window_hashes(words, min(SHINGLE, len(words)))))
    for n, own in rows.items():
        by[n] = Items(n, [i for i, _ in own], [s for _, s in own])
    return list(by.values())


class Finder:
    """Searches the windows of texts for the items of one block."""

    def __init__(self, items: list[tuple], similarity: float):
        self.groups = item_groups(items)
        self.similarity = similarity
        self.known = {}
        for size in {g.size for g in self.groups}:
            pairs = sorted({(int(h), k) for k, g in enumerate(self.groups) if g.size == size for s in g.shingles for h in s.tolist()})
            self.known[size] = np.array([h for h, _ in pairs], dtype=np.uint64), np.array([k for _, k in pairs], dtype=np.int64)

    def matches(self, column: pa.Array) -> Iterator[tuple[int, object, float, int, int, int]]:
        """(row, item, similarity, start, end, distance): the best window of each row and item, in words."""
        for part in text_slices(column):
            words, first = word_hashes(part, _GAPS, _VALUES)
            best: dict[tuple[int, object], tuple] = {}
            for size, (known, group) in self.known.items():
                hashes = window_hashes(words, size)
                left = np.searchsorted(known, hashes, side="left")
                hit = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == hashes) if len(known) and len(hashes) else []
                if not len(hit):
                    continue
                left, right = left[hit], np.searchsorted(known, hashes[hit], side="right")
                times = right - left
                at = np.repeat(hit, times)
                of = group[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(left, times)]
                for k in np.unique(of).tolist():
                    self._windows(self.groups[k], at[of == k], hashes, first, part.first, best)
            for (row, item), (value, start, end, distance) in best.items():
                yield row, item, value, start, end, distance

    def _windows(self, group: Items, hit: np.ndarray, hashes: np.ndarray, first: np.ndarray, base: int, best: dict) -> None:
        text = np.searchsorted(first, hit, side="right") - 1
        inside = hit + group.size <= first[text + 1]  # shingles do not cross texts
        hit, text = hit[inside], text[inside]
        if not len(hit):
            return
        # A text shorter than the item is one window.
        width = np.minimum(group.words, first[text + 1] - first[text])
        reach = np.arange(group.words - group.size + 1)
        start = (hit[:, None] - reach[None, :])
        ok = (start >= first[text][:, None]) & (start + width[:, None] <= first[text + 1][:, None])
        starts, index = np.unique(start[ok], return_index=True)
        owner, widths = np.broadcast_to(text[:, None], start.shape)[ok][index], np.broadcast_to(width[:, None], start.shape)[ok][index]
        for n in np.unique(widths).tolist():
            own = np.flatnonzero(widths == n)
            for k in range(0, len(own), _CHUNK):
                chunk = own[k : k + _CHUNK]
                rows = hashes[starts[chunk][:, None] + np.arange(n - group.size + 1)[None, :]]
                for w, i, d in zip(*(x.tolist() for x in group.search(simhash(rows))), strict=True):
                    value = weighted_similarity(Counter(rows[w].tolist()), group.counts[i])
                    if value < self.similarity:
                        continue
                    t, s = int(owner[chunk[w]]), int(starts[chunk[w]])
                    key, found = (base + t, group.ids[i]), (value, s - int(first[t]), s - int(first[t]) + n, d)
                    if key not in best or (found[0], -found[1]) > (best[key][0], -best[key][1]):
                        best[key] = found


def item_blocks(items: DataFrame, text: str, id: str, at_once: int = ITEMS_AT_ONCE) -> Iterator[list[tuple]]:
    """The items as blocks of about ``at_once`` rows; each is small enough to be sent to all tasks."""
    blocks = max(1, math.ceil(items.count() / at_once))
    placed = items.select(F.col(id).alias("item_id"), F.col(text).alias("text")).withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        yield [(r["item_id"], r["text"]) for r in placed.where(F.col("block") == b).collect()]


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs`` and item in it: doc_id, item_id, similarity, start_word, end_word, distance.

    The best window of each item is reported (ties: the first); start and end
    count words. Words are runs of letters and digits, A-Z folded. Items or
    texts that are null or without words match nothing; an item of fewer than
    five words is one shingle; a text shorter than the item is one window. Rows
    that repeat are reported each, items that repeat too; null ids stay null;
    empty tables give no rows; other columns are not read.
    """
    kind, item_kind = dict(docs.dtypes)[id], dict(items.dtypes)[item_id]
    own = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in item_blocks(items, item_text, item_id):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(list(enumerate(t for _, t in shared.value)), similarity)
            item_ids = pa.array([i for i, _ in shared.value])
            for batch in small_batches(batches):
                found = list(zip(*finder.matches(batch.column(1)), strict=True)) or [()] * 6
                row, item = pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), item_ids.take(item), pa.array(found[2], pa.float64()), *(pa.array(found[k], pa.int64()) for k in (3, 4, 5))],
                    names=["doc_id", "item_id", "similarity", "start_word", "end_word", "distance"])

        if not block:
            continue
        found = own.mapInArrow(search, f"doc_id {kind}, item_id {item_kind}, similarity double, start_word long, end_word long, distance long")
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, similarity double, start_word long, end_word long, distance long")
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns as they were, and no shuffle."""
    at = docs.columns.index(text)
    for block in item_blocks(items, item_text, item_id):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value, similarity)
            for batch in small_batches(batches):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[row for row, *_ in finder.matches(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        if block:
            docs = docs.mapInArrow(keep, docs.schema)
    return docs
