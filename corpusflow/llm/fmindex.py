"""Substring deduplication by words: an FM-index per shard, searched backwards over a wavelet matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .bytetext import Slice, byte_values, prefix_hash, range_hash, space_bytes, word_spans
from .repeats import Segments, Units, ranges, remove_repeats

WINDOW = 13
ANCHOR, ROUTE = 7, 3
SHARD_BYTES = 3 << 20
_ONE, _LOW = np.uint64(1), np.int64(63)


class WaveletMatrix:
    """A sequence of numbers as one packed bit vector per binary digit, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, size: int):
        """``symbols`` are below ``size``."""
        self.levels = []
        n = len(symbols)
        for digit in reversed(range(max(1, int(size - 1).bit_length()))):
            bit = (symbols >> digit) & 1
            packed = np.zeros((n // 64 + 1) * 8, dtype=np.uint8)
            bits = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(bits)] = bits
            words = packed.view(np.uint64)
            counts = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.levels.append((digit, words, counts, n - int(bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def follow(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where ``place`` lies after all levels, going the way of ``symbol``."""
        for digit, words, counts, zeros in self.levels:
            word = place >> 6
            ones = counts[word] + np.bitwise_count(words[word] & ((_ONE << (place & _LOW).astype(np.uint64)) - _ONE))
            place = np.where((symbol >> digit) & 1, zeros + ones, place - ones)
        return place


class FMIndex:
    """Backward search over a text of word numbers; 0 ends a segment."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        self.text, self.suffixes = text, sorted_suffixes(text, depth)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        before = text[self.suffixes - 1]  # of the first suffix: the last end mark
        self.matrix = WaveletMatrix(before, size)
        symbols = np.arange(size)
        self.base = self.starts[:-1] - self.matrix.follow(symbols, np.zeros(size, dtype=np.int64))

    def matching(self, end: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the text's own words that end at ``end``, up to ``limit``.

        Returns the interval of suffixes that begin with the ``limit`` words
        up to ``end``. An interval of one is the place itself: the search stops
        there, and the interval is given as it is then.
        """
        symbol = self.text[end]
        low, high = self.starts[symbol], self.starts[symbol + 1]
        active = np.flatnonzero(high - low > 1)
        for k in range(1, limit):
            symbol = self.text[end[active] - k]
            both = self.matrix.follow(np.concatenate([symbol, symbol]), np.concatenate([low[active], high[active]]))
            low[active] = self.base[symbol] + both[: len(active)]
            high[active] = self.base[symbol] + both[len(active) :]
            active = active[high[active] - low[active] > 1]
        return low, high


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` words at least, by doubling.

    Backward search for at most ``depth`` words needs no more.
    """
    rank, have = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while have < depth:
        following = np.zeros(len(rank), dtype=np.int64)
        following[:-have] = rank[have:] + 1
        key = rank * (int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        change = np.r_[0, np.diff(key[order]) != 0]
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.cumsum(change)
        have *= 2
        if change.sum() == len(key) - 1:
            break
    return order


def word_text(segments: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The words of all segments as numbers from 1, an end mark 0 after each; segment of each word; first place of each segment."""
    part = Slice(0, segments.data, segments.bounds)
    start, end, first = word_spans(part, space_bytes())
    hashes = range_hash(prefix_hash(segments.data, byte_values(fold_case=False)), start, end)
    _, numbers = np.unique(hashes, return_inverse=True)
    lengths = np.diff(first)
    place = np.arange(len(numbers)) + np.repeat(np.arange(len(lengths)), lengths)
    text = np.zeros(len(numbers) + len(lengths), dtype=np.int64)
    text[place] = numbers + 1
    return text, np.repeat(np.arange(len(lengths)), lengths + 1), first[:-1] + np.arange(len(lengths)), int(numbers.max()) + 2


def least_keys(window: int):
    """For the segments of a shard: the least key of any place of each window, where that is less than a key that has it."""

    def index(segments: Segments) -> list[tuple[int, bytes]]:
        text, owner, first, size = word_text(segments)
        fm = FMIndex(text, size, window)
        offset = np.r_[0, np.cumsum(segments.windows)]
        begin = np.repeat(first - offset[:-1], segments.windows) + np.arange(offset[-1])
        low, high = fm.matching(begin + window - 1, window)
        least = segments.least[owner[begin]]
        shared = np.flatnonzero(high - low > 1)
        opens, which = np.unique(low[shared], return_inverse=True)
        ends = np.empty(len(opens), dtype=np.int64)
        ends[which] = high[shared]
        keys = np.append(segments.least[owner[fm.suffixes]], np.int64(2**63 - 1))
        if len(opens):
            least[shared] = np.minimum.reduceat(keys, np.stack([opens, ends], axis=1).ravel())[::2][which]
        useful = np.maximum.reduceat((least < np.repeat(segments.most, segments.windows)).astype(np.int8), offset[:-1]) > 0
        alike = np.maximum.reduceat(least, offset[:-1]) == np.minimum.reduceat(least, offset[:-1])
        # One key for all windows of a segment is written once.
        return [(int(segments.names[k]), np.array([least[offset[k]], segments.windows[k]]).tobytes() + b"=" if alike[k] else least[offset[k] : offset[k + 1]].tobytes())
                for k in np.flatnonzero(useful).tolist()]

    return index


def removed_words(window: int):
    def covered(starts: np.ndarray, marks: list[bytes], key: int) -> np.ndarray:
        sizes = np.array([len(m) for m in marks])
        alike = sizes % 8 == 1  # one key for all windows
        one = np.frombuffer(b"".join(m[:16] for m, a in zip(marks, alike.tolist(), strict=True) if a), dtype=np.int64).reshape(-1, 2)
        less = one[:, 0] < key
        first, windows = starts[alike][less], one[less, 1]
        spans = [np.stack([first, first + windows - 1 + window], axis=1)]
        if not alike.all():
            each = np.frombuffer(b"".join(m for m, a in zip(marks, alike.tolist(), strict=True) if not a), dtype=np.int64)
            at = ranges(starts[~alike], sizes[~alike] // 8)[each < key]
            spans.append(np.stack([at, at + window], axis=1))
        return np.concatenate(spans)

    return covered


def remove_repeated_words(docs: DataFrame, text: str = "text", id: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, n_spans, kept_sha256.

    Words are what blanks (0x20, 0x09 to 0x0D) separate, unchanged. A word goes
    if a window of ``window`` words covers it whose words also start in a
    document with a smaller id; windows are judged on the input. Rows with the
    same id are one document in this, so they do not remove each other's words;
    a null id counts as greater than all. Null and empty texts have no words;
    texts shorter than a window lose none. An empty table gives no rows; other
    columns are not read.
    """
    units = Units(window, min(anchor, window), min(ROUTE, window), True)
    return remove_repeats(docs, units, least_keys(window), removed_words(window), text, id, SHARD_BYTES).withColumnRenamed("n_units", "n_words")
