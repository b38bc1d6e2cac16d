"""Finding passages that stand in more than one place, as Spark jobs around a per-shard index.

Used by two operators, over words and over bytes, that differ in their index. A
window is ``length`` consecutive units of one text. Equal windows choose the
same anchor (the smallest hash of a few consecutive units inside them), so:

1. every text's anchors are counted over the corpus; a window whose anchor stands
   in one place only cannot repeat;
2. neighbouring windows with the same repeated anchor form a segment; distinct
   segments meet, by anchor, in shards, and the shard's index decides which of
   their windows repeat;
3. marks go back to all texts that hold the segment.

Texts, anchors and segments move in packed rows (one per task and shard). A task
settles what repeats within itself and sends each anchor and each distinct
segment once, so a passage that most texts share is a few rows per task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Slice, byte_values, mix, prefix_hash, range_hash, small_batches, space_bytes, text_slices, window_hashes, word_spans
from .tables import cut, partitions

#: Anchors or segments that a task holds before it sends them on.
HELD_ANCHORS, HELD_BYTES = 1 << 20, 8 << 20
#: Bytes looked at together: the arrays about them take some hundred times as much.
SLICE = 1 << 18
#: Units of one text that are looked at together; longer texts overlap by a window.
PIECE_UNITS = 1 << 22
_PLACE = np.uint64((1 << 23) - 1)
_VALUES = byte_values(fold_case=False)


@dataclass(frozen=True)
class Units:
    """What windows are counted in: ``length`` units, words or bytes, make a window.

    A window is known by two anchors: one of ``anchor`` units, long enough to be
    rare by chance, tells whether it can repeat; one of ``route`` units, short
    so that it holds for many windows on end, tells the shard they meet in.
    """

    length: int
    anchor: int
    route: int
    words: bool

    def canonical(self, column: pa.Array) -> pa.Array:
        """Texts as bytes with single blanks between words; as they are if units are bytes."""
        if not self.words:
            return column.fill_null("").cast(pa.large_binary())
        return pa.array([b" ".join((t or "").encode().split()) for t in column.to_pylist()], pa.large_binary())

    def windows(self, part: Slice) -> Windows:
        """All windows of a slice, none across texts."""
        running = prefix_hash(part.data, _VALUES)
        if self.words:
            start, end, first = word_spans(part, space_bytes())
            units = range_hash(running, start, end)
            of = lambda k: window_hashes(units, k)
        else:
            start, first = np.arange(len(part.data)), part.bounds
            end = start + 1
            of = lambda k: range_hash(running, start[: max(0, len(start) - k + 1)], start[: max(0, len(start) - k + 1)] + k)
        n = max(0, len(start) - self.length + 1)
        owner = np.repeat(np.arange(part.count), np.diff(first))
        at = np.flatnonzero(owner[:n] == owner[self.length - 1 : self.length - 1 + n])
        return Windows(self, start, end, first, owner, at, of)


@dataclass
class Windows:
    """Windows of a slice: the first unit of each, in order, and how to find their anchors."""

    units: Units
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    hashes_of: Callable

    def runs(self, size: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring windows with the same anchor of ``size`` units: the first window, their number, anchor hash, anchor unit.

        With ``some`` (flags) only of these windows.
        """
        at = self.at if some is None else self.at[some]
        if not len(at):
            nothing = np.zeros(0, dtype=np.int64)
            return nothing, nothing, nothing.view(np.uint64), nothing
        hashes = self.hashes_of(size)
        width = self.units.length - size + 1
        n = len(hashes) - width + 1
        chosen = np.concatenate([k + sliding_argmin(hashes[k : k + PIECE_UNITS + width - 1], width) for k in range(0, n, PIECE_UNITS)])
        pick = chosen[at]
        opens = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1) | (self.owner[at[1:]] != self.owner[at[:-1]])])
        # Chosen hashes are small ones; mixed anew, they spread evenly over shards.
        return at[opens], np.diff(np.r_[opens, len(at)]), mix(hashes[pick[opens]]), pick[opens]


def sliding_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash (by its upper 41 bits; the first of equals) among ``width`` from each place on."""
    n = len(hashes) - width + 1
    best = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    return (best[:n] & _PLACE).astype(np.int64)


def content_hashes(part: Slice, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of segments by their bytes."""
    return mix(range_hash(prefix_hash(part.data, _VALUES), begin, end) + (end - begin).astype(np.uint64))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def prepared(docs: DataFrame, units: Units, text: str, id: str) -> DataFrame:
    """(doc_id, ref, key, text): ``ref`` names a row's id and text; windows repeat if their keys differ (words) or places do (bytes)."""
    body = F.coalesce(F.col(text), F.lit(""))
    ref = F.xxhash64(F.col(id), body)
    key = F.coalesce(F.col(id).cast("long"), F.lit(2**63 - 1)) if units.words else ref
    return docs.select(F.col(id).alias("doc_id"), ref.alias("ref"), key.alias("key"), body.alias("text"))


def packed_rows(rows: DataFrame, units: Units) -> DataFrame:
    """``prepared`` rows with their canonical text packed, as it is shuffled and stored."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed_texts(units.canonical(batch.column(3)).to_pylist()), pa.binary())], names=["doc_id", "ref", "key", "text"])

    return rows.mapInArrow(pack, f"doc_id {dict(rows.dtypes)['doc_id']}, ref long, key long, text binary")


# --- 1. anchors

NOTES = "shard int, told boolean, keys binary, lengths binary, anchors binary"


def _notes(shard: int, told: bool, key: np.ndarray, anchors: bytes) -> tuple:
    """One packed row: anchors in the order of their keys, which are sorted."""
    keys, lengths = np.unique(key, return_counts=True)
    return shard, told, keys.tobytes(), lengths.astype(np.int32).tobytes(), anchors


def _unpacked(rows: pd.DataFrame, kind) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.repeat(np.frombuffer(r.keys, dtype=np.int64), np.frombuffer(r.lengths, dtype=np.int32)) for r in rows.itertuples()]
    anchors = [np.frombuffer(r.anchors, dtype=kind) for r in rows.itertuples()]
    return (np.concatenate(keys), np.concatenate(anchors)) if keys else (np.zeros(0, np.int64), np.zeros(0, kind))


def _repeated(key: np.ndarray, anchor: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by anchor, then key; the first entry of each anchor; whether the anchor repeats.

    Among words an anchor repeats if it has different keys, among bytes if it has several places.
    """
    order = np.lexsort((key, anchor))
    anchor = anchor[order]
    opens = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    if words:
        many = key[order][opens] != key[order][np.r_[opens[1:], len(anchor)] - 1]
    else:
        many = np.diff(np.r_[opens, len(anchor)]) > 1
    return order, opens, many


def anchor_notes(rows: DataFrame, units: Units, shards: int) -> DataFrame:
    """Which anchors of which key repeat: (key, anchors), one row per key.

    A task tells the keys of anchors that repeat within it, and sends one entry
    of every anchor to the anchor's shard. There, anchors are known by the shard
    and 32 more bits: anchors that meet by chance only cost work later.
    """

    def told_or_sent(key: np.ndarray, anchor: np.ndarray) -> pa.RecordBatch:
        order, opens, many = _repeated(key, anchor, units.words)
        times = np.diff(np.r_[opens, len(anchor)])
        out = []
        # Told: all keys of anchors that repeat here, dealt out by key.
        own = order[np.repeat(many, times)]
        short = _short(anchor, shards)
        by = np.lexsort((short[own], key[own]))
        who, what = key[own][by], short[own][by]
        new = np.r_[True, (who[1:] != who[:-1]) | (what[1:] != what[:-1])] if len(by) else np.zeros(0, dtype=bool)
        who, what = who[new], what[new]
        place = _key_shard(who, shards)
        for s in np.unique(place).tolist():
            out.append(_notes(s, True, who[place == s], what[place == s].tobytes()))
        # Sent: the first key of every anchor (the least), with a mark if its keys are told already.
        own = order[opens]
        place = shard_of(anchor[own], shards)
        by = np.lexsort((key[own], place))
        own, place, flag = own[by], place[by], many[by]
        edges = np.searchsorted(place, np.arange(shards + 1))
        low = anchor.astype(np.uint32)  # the lower half; the upper half gives the shard
        for s in range(shards):
            i, j = edges[s], edges[s + 1]
            if j > i:
                out.append(_notes(s, False, key[own[i:j]], low[own[i:j]].tobytes() + flag[i:j].astype(np.uint8).tobytes()))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=[f.split()[0] for f in NOTES.split(", ")])

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, anchors, held = [], [], 0
        for batch in small_batches(batches):
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for part in binary_slices(units.canonical(batch.column(1))):
                windows = units.windows(part)
                begin, _, anchor, _ = windows.runs(units.anchor)
                if len(begin):
                    keys.append(own[part.first + windows.owner[begin]])
                    anchors.append(anchor)
                    held += len(anchor)
                if held >= HELD_ANCHORS:
                    yield told_or_sent(np.concatenate(keys), np.concatenate(anchors))
                    keys, anchors, held = [], [], 0
        if held:
            yield told_or_sent(np.concatenate(keys), np.concatenate(anchors))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        shard = np.uint64(rows["shard"].iloc[0])
        key, short = _unpacked(rows[rows["told"]], np.uint64)
        sent = rows[~rows["told"]]
        if len(sent):
            keys, low, told = [], [], []
            for r in sent.itertuples():
                lengths = np.frombuffer(r.lengths, dtype=np.int32)
                n = int(lengths.sum())
                keys.append(np.repeat(np.frombuffer(r.keys, dtype=np.int64), lengths))
                low.append(np.frombuffer(r.anchors, dtype=np.uint32, count=n))
                told.append(np.frombuffer(r.anchors, dtype=np.uint8, offset=4 * n).astype(bool))
            k, a, t = np.concatenate(keys), np.concatenate(low), np.concatenate(told)
            order, opens, many = _repeated(k, a, units.words)
            times = np.diff(np.r_[opens, len(a)])
            new = order[np.repeat(many, times) & ~t[order]]
            key, short = np.r_[key, k[new]], np.r_[short, (shard << np.uint64(32)) | a[new].astype(np.uint64)]
        place = _key_shard(key, shards)
        order = np.lexsort((key, place))
        key, short, place = key[order], short[order], place[order]
        edges = np.searchsorted(place, np.arange(shards + 1))
        out = [_notes(s, True, key[i:j], short[i:j].tobytes()) for s, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if j > i]
        return pd.DataFrame(out, columns=[f.split()[0] for f in NOTES.split(", ")])

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        """One row per key."""
        key, short = _unpacked(rows, np.uint64)
        order = np.argsort(key, kind="stable")
        key, short = key[order], short[order]
        opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[opens[1:], len(key)]
        return pd.DataFrame({"key": key[opens], "anchors": [np.unique(short[i:j]).tobytes() for i, j in zip(opens.tolist(), ends.tolist(), strict=True)]})

    settled = rows.select("key", "text").mapInArrow(survey, NOTES).groupBy("shard").applyInPandas(settle, NOTES)
    return settled.groupBy("shard").applyInPandas(gather, "key long, anchors binary")


def _key_shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (mix(key.view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _short(anchor: np.ndarray, shards: int) -> np.ndarray:
    """An anchor's name in notes: its shard and its lower half."""
    return (shard_of(anchor, shards).astype(np.uint64) << np.uint64(32)) | (anchor & np.uint64(0xFFFFFFFF))


def binary_slices(column: pa.Array) -> Iterator[Slice]:
    """Slices of a column of bytes (see ``text_slices``)."""
    column = column.cast(pa.large_binary())
    yield from text_slices(pa.Array.from_buffers(pa.large_string(), len(column), column.buffers(), offset=column.offset), SLICE)


def packed_texts(texts: list[bytes | None]) -> list[bytes | None]:
    """Texts that are shuffled and stored, each compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    return [None if t is None else pack(t) for t in texts]


def unpacked_texts(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(t) for t in column.to_pylist()], pa.large_binary())


# --- 2. segments

SEGMENTS = "shard int, numbers binary, lengths binary, bytes binary"
_FIELDS = ("least", "most", "times", "windows", "places", "anchors")


@dataclass
class Segments:
    """The distinct segments of a shard: their bytes joined, with offsets, and what is known of their places."""

    names: np.ndarray
    least: np.ndarray  # the least and greatest key that has it
    most: np.ndarray
    times: np.ndarray  # places that have it
    windows: np.ndarray
    places: np.ndarray  # where in the segment the anchor starts
    anchors: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Segments:
        """The rows of all tasks in one, equal segments merged."""
        unpack = zstandard.ZstdDecompressor().decompress
        lengths = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in rows["lengths"]])
        numbers = np.concatenate([np.frombuffer(unpack(b), dtype=np.int64).reshape(len(_FIELDS), -1) for b in rows["numbers"]], axis=1)
        least, most, times, windows, places, anchors = numbers
        data, ends = np.concatenate([np.frombuffer(unpack(b), dtype=np.uint8) for b in rows["bytes"]]), np.cumsum(lengths)
        names = content_hashes(Slice(0, data, ends), ends - lengths, ends)
        order = np.argsort(names, kind="stable")
        opens = np.flatnonzero(np.r_[True, names[order][1:] != names[order][:-1]])
        one = order[opens]
        take = ranges(ends[one] - lengths[one], lengths[one])
        return cls(
            names[one], np.minimum.reduceat(least[order], opens), np.maximum.reduceat(most[order], opens),
            np.add.reduceat(times[order], opens), windows[one], places[one], anchors[one].view(np.uint64), data[take], np.r_[0, np.cumsum(lengths[one])])


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., start + length - 1 for every pair, joined."""
    return np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum())) if len(start) else np.zeros(0, np.int64)


def noted_runs(column: pa.Array, notes: list, units: Units, shards: int) -> list[bytes | None]:
    """Per text the runs, in order, whose anchor is noted for it, as packed bits; null where there are none."""
    out: list[bytes | None] = [None] * len(column)
    for part in binary_slices(column):
        windows = units.windows(part)
        begin, _, anchor, _ = windows.runs(units.anchor)
        short, text = _short(anchor, shards), windows.owner[begin]
        edges = np.searchsorted(text, np.arange(part.count + 1))
        for t in range(part.count):
            own = notes[part.first + t]
            if own is not None:
                bits = np.isin(short[edges[t] : edges[t + 1]], np.frombuffer(own, dtype=np.uint64))
                if bits.any():
                    out[part.first + t] = np.packbits(bits).tobytes()
    return out


def segments_of(batch: pa.RecordBatch, units: Units) -> Iterator[tuple]:
    """Of a batch (packed text, bits of noted runs, ...): slices with their segments of noted windows.

    Text, first unit in the text, windows, routing hash, first and end byte in
    the slice, and where in the segment its anchor starts (in units).
    """
    noted = batch.column(1).to_pylist()
    for part in binary_slices(unpacked_texts(batch.column(0))):
        windows = units.windows(part)
        begin, lengths, _, _ = windows.runs(units.anchor)
        edges = np.searchsorted(windows.owner[begin], np.arange(part.count + 1))
        bits = [np.unpackbits(np.frombuffer(noted[part.first + t], dtype=np.uint8), count=int(edges[t + 1] - edges[t])) for t in range(part.count)]
        some = np.repeat(np.concatenate(bits).astype(bool), lengths)
        begin, lengths, anchor, pick = windows.runs(units.route, some)
        if len(begin):
            text = windows.owner[begin]
            last = begin + lengths - 1 + units.length - 1
            yield part, (text, begin - windows.first[text], lengths, anchor, windows.start[begin], windows.end[last], pick - begin)


def segment_packs(texts: DataFrame, units: Units, shards: int) -> DataFrame:
    """The distinct segments of each task, packed by the shard of their anchor."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        names, key, windows, places, anchors, lengths, data = (np.concatenate([h[k] for h in held]) for k in range(7))
        bounds = np.r_[0, np.cumsum(lengths)]
        order = np.lexsort((names, shard_of(anchors, shards)))
        opens = np.flatnonzero(np.r_[True, names[order][1:] != names[order][:-1]])
        one = order[opens]
        least, most, times = np.minimum.reduceat(key[order], opens), np.maximum.reduceat(key[order], opens), np.diff(np.r_[opens, len(order)])
        place, rows, pack = shard_of(anchors[one], shards), [], zstandard.ZstdCompressor(level=1).compress
        edges = np.searchsorted(place, np.arange(shards + 1))
        for s in range(shards):
            i, j = edges[s], edges[s + 1]
            if j > i:
                own = one[i:j]
                # Words are compared with all of their shard, so their anchors are not needed there.
                routes = anchors[own].view(np.int64) if not units.words else np.zeros(len(own), dtype=np.int64)
                numbers = np.stack([least[i:j], most[i:j], times[i:j], windows[own], places[own], routes])
                rows.append((s, pack(numbers.tobytes()), lengths[own].tobytes(), pack(data[ranges(bounds[own], lengths[own])].tobytes())))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=[f.split()[0] for f in SEGMENTS.split(", ")])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in small_batches(batches):
            key = batch.column(2).to_numpy(zero_copy_only=False)
            for part, (text, _, windows, anchor, begin, end, place) in segments_of(batch, units):
                lengths = (end - begin).astype(np.int64)
                held.append((content_hashes(part, begin, end), key[part.first + text], windows, place, anchor, lengths, part.data[ranges(begin, lengths)]))
                size += int(lengths.sum())
                if size >= HELD_BYTES:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return texts.select("text", "noted", "key").mapInArrow(collect, SEGMENTS)


def places(texts: DataFrame, units: Units) -> DataFrame:
    """(ref, name, start): where the segments stand, the start in units."""

    def list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ref = batch.column(2).to_numpy(zero_copy_only=False)
            for part, (text, start, _, _, begin, end, _) in segments_of(batch, units):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ref[part.first + text]), pa.array(content_hashes(part, begin, end).view(np.int64)), pa.array(start.astype(np.int64))], names=["ref", "name", "start"])

    return texts.select("text", "noted", "ref").mapInArrow(list_all, "ref long, name long, start long")


# --- 3. marks and results

def remove_repeats(docs: DataFrame, units: Units, index: Callable[[Segments], list[tuple[int, bytes]]], covered: Callable, text: str, id: str,
                   shard_bytes: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_units, n_removed, n_spans, kept_sha256.

    ``index`` gives (name, marks) for segments with windows to remove;
    ``covered`` the ranges (rows of first and end unit) that marked segments
    remove from a row, by their starts, their marks and the row's key.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id]
    rows = prepared(docs, units, text, id)
    shards = max(partitions(spark), 16)
    noted = packed_rows(rows, units).join(anchor_notes(rows, units, shards), "key", "left").select("text", "anchors", "key", "ref", "doc_id")

    def finished(body: bytes, spans: list[np.ndarray]) -> tuple[int, int, int, str]:
        """Counts and digest of a text without the units that spans (rows of first and end) cover."""
        parts = body.split() if units.words else np.frombuffer(body, dtype=np.uint8)
        if not spans:
            return len(parts), 0, 0, hashlib.sha256(body).hexdigest()
        gone = covered_units(np.concatenate(spans), len(parts))
        if not gone.any():
            return len(parts), 0, 0, hashlib.sha256(body).hexdigest()
        kept = b" ".join(compress(parts, (~gone).tolist())) if units.words else parts[~gone].tobytes()
        return len(parts), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1)), hashlib.sha256(kept).hexdigest()

    result = [("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without noted runs are finished; the others keep their text."""
        for batch in small_batches(batches):
            body = unpacked_texts(batch.column(0))
            bits = noted_runs(body, batch.column(1).to_pylist(), units, shards)
            done = [finished(b, []) if own is None else (None,) * 4 for b, own in zip(body.to_pylist(), bits, strict=True)]
            kept = [None if own is None else t for t, own in zip(batch.column(0).to_pylist(), bits, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.binary()), pa.array(bits, pa.binary()), batch.column(2), batch.column(3), batch.column(4),
                 *(pa.array([d[k] for d in done], t) for k, (_, t) in enumerate(result))],
                names=["text", "noted", "key", "ref", "doc_id"] + [n for n, _ in result])

    sorted_out = cut(noted.mapInArrow(sort_out, f"text binary, noted binary, key long, ref long, doc_id {kind}, n_units long, n_removed long, n_spans long, kept_sha256 string"))
    texts = sorted_out.where("text IS NOT NULL").select("text", "noted", "key", "ref", "doc_id")
    # Segments overlap by a window; a noted run has about as many windows as lie between two anchors.
    runs = texts.agg(F.sum(F.octet_length("noted"))).first()[0] or 0
    parts = max(partitions(spark), math.ceil(runs * 8 * units.length * (6 if units.words else 1) / shard_bytes))

    def settle(packs: pd.DataFrame) -> pd.DataFrame:
        found = index(Segments.of(packs))
        return pd.DataFrame({"name": np.array([n for n, _ in found], dtype=np.uint64).view(np.int64), "marks": [m for _, m in found]})

    marks = cut(segment_packs(texts, units, parts).groupBy("shard").applyInPandas(settle, "name long, marks binary"))
    per_row = places(texts, units).join(marks, "name").groupBy("ref").agg(F.collect_list(F.struct("start", "marks")).alias("found"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out, found = [], batch.column(2)
            inside = found.flatten()  # null lists, of rows without marks, give nothing
            starts, marks = inside.field("start").to_numpy(zero_copy_only=False), inside.field("marks").to_pylist()
            edges = np.r_[0, np.cumsum(np.nan_to_num(pc.list_value_length(found).to_numpy(zero_copy_only=False)).astype(np.int64))]
            for k, (body, key) in enumerate(zip(unpacked_texts(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                i, j = edges[k], edges[k + 1]
                out.append(finished(body, [covered(starts[i:j], marks[i:j], key)] if j > i else []))
            yield pa.RecordBatch.from_arrays([batch.column(3), *(pa.array([o[k] for o in out], t) for k, (_, t) in enumerate(result))], names=["doc_id"] + [n for n, _ in result])

    marked = texts.select("text", "key", "ref", "doc_id").join(per_row, "ref", "left").select("text", "key", "found", "doc_id")
    removed = marked.mapInArrow(remove, f"doc_id {kind}, n_units long, n_removed long, n_spans long, kept_sha256 string")
    return sorted_out.where("text IS NULL").select(removed.columns).unionAll(removed)


def covered_units(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n units the spans cover."""
    depth = np.bincount(spans[:, 0], minlength=n + 1) - np.bincount(spans[:, 1], minlength=n + 1)
    return np.cumsum(depth[:n]) > 0
