"""Suffix-array deduplication by bytes: suffixes sorted by linear grouping.

Suffixes are first grouped by their first byte. Groups are taken in descending
order; each suffix of a group finds the nearest earlier suffix of a lower group
(its previous smaller one), and those are split off into a group right above
their old one: their known prefix, a Lyndon word, has grown by that of the group
at hand. In the end suffixes share a group if they share their longest Lyndon
prefix, and one ascending pass puts each group in order: suffix after suffix
places the suffixes whose Lyndon prefix ends where it starts.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame

from .bytetext import byte_values, mix, prefix_hash, range_hash
from .repeats import Segments, Units, ranges, remove_repeats

WINDOW = 200
ANCHOR, ROUTE = 96, 64
SHARD_BYTES = 3 << 20
SHORT_TEXT = 1 << 15


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of a text in ascending order; its last symbol must be smaller than all others.

    Takes some 40 bytes per symbol of a long text.
    """
    n = len(symbols)
    first = np.argsort(symbols, kind="stable").astype(np.int32)
    opens = np.flatnonzero(np.r_[True, np.diff(symbols[first]) != 0]).astype(np.int32)
    sizes = np.diff(np.r_[opens, n]).astype(np.int32)
    inverse, groups, counts = (np.zeros(n, dtype=np.int32) for _ in range(3))
    inverse[first], groups[first], counts[opens] = np.arange(n, dtype=np.int32), np.repeat(opens, sizes), sizes
    # Lists are faster, arrays smaller.
    hold = (lambda x: x.tolist()) if n <= SHORT_TEXT else (lambda x: array("i", x.tobytes()))
    order, place, group, size, before = (hold(x) for x in (first, inverse, groups, counts, np.zeros(n, dtype=np.int32)))
    end = n - 1
    # Place -1 stands for none and reads as the last symbol's, whose group is the lowest: walks end there.
    while end > 0:
        last = order[end]
        low = group[last]
        if low == end:  # one suffix: at most one previous smaller suffix, which goes above its group
            j = last - 1
            while group[j] >= low:
                j = before[j]
            before[last] = j
            if j >= 0:
                h = group[j]
                m = size[h]
                if m > 1:
                    m -= 1
                    size[h] = m
                    m += h
                    i, k = order[m], place[j]
                    order[k], order[m] = i, j
                    place[i], place[j] = k, m
                    group[j], size[m] = m, 1
            end -= 1
            continue
        times: dict[int, int] = {}
        for i in sorted(order[low : end + 1]):
            j = i - 1
            while group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by: dict[int, list[int]] = {}
        for j, k in times.items():
            by.setdefault(k, []).append(j)
        for k in sorted(by, reverse=True):  # more repetitions of the group's word are greater: placed first, so highest
            moved = by[k]
            for j in moved:
                h = group[j]
                size[h] -= 1
                m = h + size[h]
                i, p = order[m], place[j]
                order[p], order[m] = i, j
                place[i], place[j] = p, m
            old = [group[j] for j in moved]
            tops = {h: h + size[h] for h in old}
            for h in tops.values():
                size[h] = 0
            for j, h in zip(moved, old, strict=True):
                group[j] = tops[h]
                size[tops[h]] += 1
        end = low - 1
    # Every suffix, in ascending order, places those whose Lyndon prefix ends where it starts.
    out, free, placed = hold(np.zeros(n, dtype=np.int32)), hold(np.arange(n, dtype=np.int32)), bytearray(n)
    out[0] = n - 1
    free[group[n - 1]] += 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return np.array(out, dtype=np.int32)


def compared_parts(segments: Segments, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments that can share a window with another one, and which of their bytes (first, end).

    Equal windows have their anchor at the same place, so two windows of one
    segment are never equal, and equal windows of two segments agree in half of
    the other bytes at least, left or right of the anchor. A segment whose left
    and right halves are its own is compared with none; one that shares only
    the right half needs its windows that reach so far right, and the other way
    round.
    """
    start, end = segments.bounds[:-1], segments.bounds[1:]
    at, half = start + segments.places, (window - anchor + 1) // 2
    rest = window - anchor - half
    running = prefix_hash(segments.data, byte_values(fold_case=False))
    shared = []
    for first, stop, there in ((at - half, at, segments.places >= half), (at + anchor, at + anchor + half, at + anchor + half <= end)):
        own = np.flatnonzero(there)
        keys = mix(range_hash(running, first[own], stop[own]) ^ segments.anchors[own])
        _, which, sharing = np.unique(keys, return_inverse=True, return_counts=True)
        both = np.zeros(len(at), dtype=bool)
        both[own] = sharing[which] > 1
        shared.append(both)
    left, right = shared
    some = np.flatnonzero(left | right)
    first = np.where(left, start, np.maximum(start, at - rest))
    stop = np.where(right, end, np.minimum(end, at + anchor + rest))
    return some, first[some], stop[some]


def grouped_order(segments: Segments, some: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The suffixes of the given parts of segments, sorted within the segments of each anchor.

    Only segments with the same anchor can share a window, so each anchor's
    parts are a text of their own. Byte values are raised by 2; 1 ends a part
    and 0 the text, so suffixes have one order.
    """
    if not len(some):
        return np.zeros(0, dtype=np.int32)
    by = np.argsort(segments.anchors[some], kind="stable")
    anchors, starts, lengths = segments.anchors[some][by], first[by], (stop - first)[by]
    opens = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    data = np.append(segments.data, np.uint8(0))  # a place for the end mark of the last part
    out = []
    for i, j in zip(opens.tolist(), np.r_[opens[1:], len(by)].tolist(), strict=True):
        take = ranges(starts[i:j], lengths[i:j] + 1)
        ends = np.cumsum(lengths[i:j] + 1) - 1
        text = data[take].astype(np.int16) + 2
        text[ends], take[ends] = 1, -1
        text[-1] = 0
        order = take[suffix_array(text)]
        out.append(order[order >= 0].astype(np.int32))
    return np.concatenate(out)


def equal_neighbours(data: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """Whether each suffix of the order begins with the same ``window`` bytes as the one before it."""
    running = prefix_hash(data, byte_values(fold_case=False))
    prints = range_hash(running, order, order + window)
    same = np.zeros(len(order), dtype=bool)
    same[1:] = prints[1:] == prints[:-1]
    at = np.flatnonzero(same)
    for k in range(0, len(at), 1 << 14):  # the bytes themselves decide
        chunk = at[k : k + (1 << 14)]
        width = np.arange(window)
        same[chunk] = (data[order[chunk][:, None] + width] == data[order[chunk - 1][:, None] + width]).all(axis=1)
    return same


def repeated_windows(window: int, anchor: int):
    """For the segments of a shard: the runs of windows that stand in another place too."""

    def index(segments: Segments) -> list[tuple[int, bytes]]:
        some, first, stop = compared_parts(segments, window, anchor)
        order = grouped_order(segments, some, first, stop)
        end = np.zeros(len(segments.names), dtype=np.int64)
        end[some] = stop
        owner = np.searchsorted(segments.bounds, order, side="right") - 1
        whole = order + window <= end[owner]  # a window starts here
        order, owner = order[whole], owner[whole]
        same = equal_neighbours(segments.data, order, window)
        opens = np.flatnonzero(~same)
        places = np.add.reduceat(segments.times[owner], opens) if len(opens) else np.zeros(0, np.int64)
        many = np.repeat(places, np.diff(np.r_[opens, len(order)])) > 1
        flags = np.zeros(len(segments.data) + 1, dtype=bool)
        flags[order[many]] = True
        # A segment that stands in several places repeats as a whole.
        out = [(int(segments.names[k]), np.array([0, segments.windows[k]], dtype=np.int32).tobytes()) for k in np.flatnonzero(segments.times > 1).tolist()]
        for k in np.unique(owner[many]).tolist():
            if segments.times[k] > 1:
                continue
            a = int(segments.bounds[k])
            own = np.r_[False, flags[a : a + int(segments.windows[k])], False].astype(np.int8)
            edges = np.flatnonzero(np.diff(own)).astype(np.int32)
            out.append((int(segments.names[k]), edges.tobytes()))
        return out

    return index


def removed_bytes(window: int):
    def covered(starts: np.ndarray, marks: list[bytes], key: int) -> np.ndarray:
        edges = np.frombuffer(b"".join(marks), dtype=np.int32).reshape(-1, 2)
        return edges + np.repeat(starts, [len(m) // 8 for m in marks])[:, None] + np.array([0, window - 1])

    return covered


def remove_repeated_bytes(docs: DataFrame, text: str = "text", id: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte of the UTF-8 text goes if ``window`` bytes that cover it also start
    anywhere else, in another row or the same one, overlaps included; this is
    judged on the input. Rows that repeat lose every byte of texts of
    ``window`` bytes or more. Null counts as the empty text; shorter texts lose
    nothing; null ids are kept as they are. An empty table gives no rows; other
    columns are not read.
    """
    units = Units(window, anchor, ROUTE, False)
    return remove_repeats(docs, units, repeated_windows(window, ROUTE), removed_bytes(window), text, id, SHARD_BYTES).withColumnRenamed("n_units", "n_bytes")
