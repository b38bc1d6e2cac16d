"""Alignment of two tokenizers' tokens, and how well their token pairs agree across a corpus.

Both tokenizers cut the same bytes, so every token has an end offset and the
ends of a text are two rising lists. The shorter list is searched for in the
longer one by galloping: from where an even spread would put an end, steps
double until they pass it, and a binary search settles the bracket. Ends that
both lists have slice the text into groups; the differences of their ranks are
the numbers of tokens of either side in a group, and every token of a group is
linked with every token of its other side.

A task turns texts into chunks of a bounded number of bytes. A chunk gives a
row per text, with its pairs as places in the chunk's own list of distinct
pairs, and that list once. Lists are summed over the corpus, graded, and go
back to the chunks they came from: no row is made per link or per token, and a
pair that every text has is one row per chunk.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

#: Bytes of text per chunk (a longer text is a chunk of its own), and texts that are encoded at once.
CHUNK_BYTES, ENCODE_BYTES = 4 << 20, 1 << 18
#: Links that are held at once while pairs are counted.
HELD_LINKS = 1 << 21
#: How a byte-level tokenizer of this kind cuts text into words before it merges (fixed value).
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ROWS = "chunk long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, pairs binary, holders binary"
OUT = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass
class Vocabulary:
    """A tokenizer: ids of many texts, and the bytes of every id."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: list[bytes]

    def __post_init__(self):
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.names = [str(k) for k in range(len(self.pieces))]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def byte_level(path: str) -> Vocabulary:
    """The byte-level tokenizer of a JSON file; special tokens in a text are plain text.

    Where the file's merges are in the order of their ids and nothing but the
    usual word pattern comes before them, the ids equal ranks, and the same
    merges run about three times faster by rank.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model = told["model"]
    size = max([*model["vocab"].values(), *(t["id"] for t in told.get("added_tokens", []))]) + 1
    alphabet = byte_alphabet()
    pieces = [b""] * size
    for piece, k in model["vocab"].items():
        pieces[k] = bytes(alphabet[c] for c in piece)
    before = told.get("pre_tokenizer") or {}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ranked = (
        before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told.get("normalizer")
        and not model.get("ignore_merges") and not model.get("dropout") and sorted(model["vocab"].values()) == list(range(len(model["vocab"])))
        and all(model["vocab"].get(m) == 256 + k for k, m in enumerate(merges)) and len(merges) + 256 == len(model["vocab"])
    )
    if ranked:
        import tiktoken

        encoding = tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks={pieces[k]: k for k in model["vocab"].values()}, special_tokens={})
        return Vocabulary(lambda texts: [encoding.encode_ordinary(t) for t in texts], pieces)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return Vocabulary(lambda texts: [tokenizer.encode(t, add_special_tokens=False).ids for t in texts], pieces)


@lru_cache(maxsize=4)
def sentence_pieces(path: str) -> Vocabulary:
    """The piece tokenizer of a model file, which puts a space before every text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode()
              for k, p in ((k, model.id_to_piece(k)) for k in range(model.get_piece_size()))]
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), pieces)


def gallop(values: np.ndarray, into: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For every value the first place of the rising list ``into`` that is not below it, searched outwards from ``start``."""
    n = len(into)
    low, high = start - 1, start.copy()  # at the end into[low] < value <= into[high]
    behind = into[start] < values
    live, step = np.flatnonzero(behind), 1
    while len(live):  # doubling steps to the right
        low[live] = high[live]
        high[live] = np.minimum(high[live] + step, n)
        live = live[high[live] < n]
        live = live[into[high[live]] < values[live]]
        step *= 2
    live, step = np.flatnonzero(~behind), 1
    low[live] = high[live]
    while len(live):  # and to the left
        high[live] = low[live]
        low[live] = np.maximum(low[live] - step, -1)
        live = live[low[live] >= 0]
        live = live[into[low[live]] >= values[live]]
        step *= 2
    live = np.flatnonzero(high - low > 1)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        below = into[middle] < values[live]
        low[live] = np.where(below, middle, low[live])
        high[live] = np.where(below, high[live], middle)
        live = live[high[live] - low[live] > 1]
    return high


def common_ends(a: np.ndarray, first_a: np.ndarray, b: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both rising lists of the ends that both have; text ``t`` owns ``first[t]`` to ``first[t + 1]`` of each."""
    n_a, n_b = np.diff(first_a), np.diff(first_b)

    def side(short, first, n, long, first_long, n_long, driven):
        own = np.repeat(driven, n)
        at = np.flatnonzero(own)
        text = np.repeat(np.arange(len(n)), n)[at]
        guess = first_long[text] + (at - first[text]) * n_long[text] // np.maximum(n[text], 1)
        place = gallop(short[at], long, guess)
        hit = long[np.minimum(place, len(long) - 1)] == short[at]
        return at[hit], place[hit]

    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_at, b_in = side(a, first_a, n_a, b, first_b, n_b, n_a <= n_b)
    b_at, a_in = side(b, first_b, n_b, a, first_a, n_a, n_a > n_b)
    both = np.concatenate([a_at, a_in]), np.concatenate([b_in, b_at])
    order = np.argsort(both[0])
    return both[0][order], both[1][order]


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, weight = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(every, kind="stable")
    every, weight = every[order], weight[order]
    opens = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    return every[opens], np.add.reduceat(weight, opens) if len(opens) else weight


def linked_pairs(a: np.ndarray, b: np.ndarray, text: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, size_b: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``text * width + id_a * size_b + id_b`` of all links, rising, and how many links each has.

    ``ends_a`` and ``ends_b`` are one past the last token of each group. Groups
    are opened in spans of a bounded number of links; a group beyond the bound
    is counted by its distinct ids, a few of them at a time.
    """
    start_a, start_b = np.r_[0, ends_a[:-1]], np.r_[0, ends_b[:-1]]
    n_a, n_b = ends_a - start_a, ends_b - start_b
    links = n_a * n_b
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(key: np.ndarray, weight: np.ndarray) -> None:
        keys.append(key)
        times.append(weight)

    large = np.flatnonzero(links > HELD_LINKS)
    edges = np.r_[large, len(links)]
    at = 0
    for stop in edges.tolist():
        total = np.r_[0, np.cumsum(links[at:stop])]
        low = 0
        while low < stop - at:
            high = max(low + 1, int(np.searchsorted(total, total[low] + HELD_LINKS, side="right")) - 1)
            g0, g1 = at + low, at + high
            per_token = np.repeat(n_b[g0:g1], n_a[g0:g1])
            left = slice(start_a[g0], ends_a[g1 - 1])
            opened = np.repeat(np.repeat(start_b[g0:g1], n_a[g0:g1]), per_token)
            inside = np.arange(total[high] - total[low]) - np.repeat(np.cumsum(per_token) - per_token, per_token)
            key = np.repeat(text[left] * width + a[left] * size_b, per_token) + b[opened + inside]
            add(*np.unique(key, return_counts=True))
            low = high
        if stop < len(links):
            ids_a, times_a = np.unique(a[start_a[stop] : ends_a[stop]], return_counts=True)
            ids_b, times_b = np.unique(b[start_b[stop] : ends_b[stop]], return_counts=True)
            step = max(1, HELD_LINKS // len(ids_b))
            for k in range(0, len(ids_a), step):
                key = text[start_a[stop]] * width + ids_a[k : k + step, None] * size_b + ids_b[None, :]
                add(key.ravel(), (times_a[k : k + step, None] * times_b[None, :]).ravel())
        at = stop + 1
    return _summed(keys, times)


def packed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Rising places and their times, by differences and byte planes."""
    both = np.stack([np.diff(places, prepend=0), times]).astype("<u8")
    return zlib.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1)
    both = np.ascontiguousarray(planes.T).view("<u8").reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


class Chunk:
    """Texts of one chunk: encoded as they come, aligned together at the end."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b = a, b
        self.ids: list = []
        self.tokens: tuple[list, list] = ([], [])
        self.bytes = 0

    def add(self, ids: list, texts: list[str | None]) -> None:
        spaced = [" " + t if t else "" for t in texts]
        mine, others = self.a.encode(spaced), self.b.encode([t or "" for t in texts])
        for t, x, y in zip(spaced, mine, others, strict=True):
            body = t.encode()
            self.bytes += len(body)
            same = bool(t) and b"".join(map(self.a.pieces.__getitem__, x)) == body and b"".join(map(self.b.pieces.__getitem__, y)) == body
            self.tokens[0].append(np.array(x if same else [], dtype=np.int32))
            self.tokens[1].append(np.array(y if same else [], dtype=np.int32))
        self.ids += ids

    def rows(self) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray]]:
        """A tuple per text, and the chunk's distinct pairs with the number of texts that have them."""
        texts = len(self.ids)
        first_a = np.r_[0, np.cumsum([len(t) for t in self.tokens[0]])].astype(np.int64)
        first_b = np.r_[0, np.cumsum([len(t) for t in self.tokens[1]])].astype(np.int64)
        a, b = (np.concatenate([np.zeros(0, np.int32), *t]).astype(np.int64) for t in self.tokens)
        at_a, at_b = common_ends(np.cumsum(self.a.lengths[a]), first_a, np.cumsum(self.b.lengths[b]), first_b)
        text = np.repeat(np.arange(texts), np.diff(first_a))
        group = text[at_a]
        n_a, n_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        size_b, width = len(self.b.pieces), len(self.a.pieces) * len(self.b.pieces)
        key, times = linked_pairs(a, b, text, at_a + 1, at_b + 1, size_b, width)
        owner = key // width
        distinct, place, holders = np.unique(key % width, return_inverse=True, return_counts=True)
        edges = np.searchsorted(owner, np.arange(texts + 1))
        groups = np.bincount(group, minlength=texts)
        links = np.bincount(owner, weights=times, minlength=texts).astype(np.int64) if len(owner) else np.zeros(texts, np.int64)
        out = []
        for t, digest in enumerate(self.digests(a, b, first_a, first_b, at_a, at_b, n_a, n_b)):
            i, j = edges[t], edges[t + 1]
            out.append((self.ids[t], int(first_a[t + 1] - first_a[t]), int(first_b[t + 1] - first_b[t]), int(groups[t]), int(links[t]), digest, packed(place[i:j], times[i:j])))
        return out, (distinct, holders)

    def digests(self, a, b, first_a, first_b, at_a, at_b, n_a, n_b) -> Iterator[str]:
        """sha256 of the groups of every text as written; without tokens the empty text."""
        # Tokens of both sides in the order they are written, each with the mark that follows it.
        order = np.empty(len(a) + len(b), dtype=np.int64)
        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        kinds = len(self.a.pieces)
        order[np.arange(len(a)) + (at_b - n_b + 1)[group_a]] = a + last_a * kinds
        order[np.arange(len(b)) + (at_a + 1)[group_b]] = 2 * kinds + b + last_b * len(self.b.pieces)
        table = self.table()
        first = first_a + first_b
        for t in range(len(self.ids)):
            written = "".join(map(table.__getitem__, order[first[t] : first[t + 1]].tolist()))
            yield hashlib.sha256(written[:-1].encode()).hexdigest() if written else ""

    def table(self) -> list[str]:
        known = getattr(self.a, "written", None)
        if known is None or known[0] is not self.b:
            known = self.b, [n + mark for names, marks in ((self.a.names, ",|"), (self.b.names, ",;")) for mark in marks for n in names]
            self.a.written = known
        return known[1]


def tokenised(docs: DataFrame, a_path: str, b_path: str, text: str, id: str) -> DataFrame:
    """Rows of two kinds: a text with its places, and a chunk's pairs (``doc_id`` and counts null)."""
    kind = dict(docs.dtypes)[id]
    schema = ROWS.format(kind=kind)
    names = [f.split()[0] for f in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), sentence_pieces(b_path)
        number = (TaskContext.get().partitionId() << 32) - 1
        chunk, id_type = Chunk(a, b), None

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, number
            number += 1
            rows, (pairs, holders) = chunk.rows()
            columns = list(zip(*rows, strict=True))
            n = len(rows)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([
                pa.array([number] * n, long), pa.array(columns[0], id_type), *(pa.array(columns[k], long) for k in (1, 2, 3, 4)),
                pa.array(columns[5], pa.string()), pa.array(columns[6], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], long), pa.nulls(1, id_type), *[pa.nulls(1, long)] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()),
                    pa.array([pairs.astype(np.int64).tobytes()], pa.binary()), pa.array([holders.astype(np.int64).tobytes()], pa.binary())], names=names)
            chunk = Chunk(a, b)

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.cumsum(np.asarray(pc.binary_length(texts.cast(pa.large_string())).fill_null(0)))
            at = 0
            while at < len(ids):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + ENCODE_BYTES, side="right")))
                chunk.add(ids[at:stop], texts.slice(at, stop - at).to_pylist())
                if chunk.bytes >= CHUNK_BYTES:
                    yield from closed()
                at = stop
        if chunk.ids:
            yield from closed()

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, schema)


def chunk_pairs(rows: DataFrame) -> DataFrame:
    """(chunk, pair, holders) from the chunks' lists."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, holders in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair = np.frombuffer(pairs, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), number)), pa.array(pair), pa.array(np.frombuffer(holders, dtype=np.int64))], names=["chunk", "pair", "holders"])

    return rows.where("pairs IS NOT NULL").select("chunk", "pairs", "holders").mapInArrow(opened, "chunk long, pair long, holders long")


def pair_counts(pairs: DataFrame, size_b: int) -> DataFrame:
    """(pair, holders, best): texts that hold a pair linked, and whether no pair of its A id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("holders").alias("holders"))
    own = F.expr(f"pair div {size_b}")
    most = counts.groupBy(own.alias("a")).agg(F.max("holders").alias("most"))
    return counts.join(F.broadcast(most), own == F.col("a")).select("pair", "holders", (F.col("holders") == F.col("most")).cast("long").alias("best"))  # a row per id of A's vocabulary


def align_tokens(docs: DataFrame, a_path: str, b_path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path`` names a byte-level BPE file, ``b_path`` a piece model; both must
    lie where every executor can read them. A encodes a space and the text, B
    adds that space itself. ``n_best`` counts links whose pair no other pair of
    the same A id beats in the number of texts that hold it, ties included;
    ``count_sum`` adds those numbers over all links. Texts that are null or
    empty, or that a tokenizer does not give back byte by byte, have no tokens:
    zeros and an empty ``groups_sha256``. Rows that repeat count as texts of
    their own and get a row each, null ids too; an empty table gives none;
    other columns are not read.
    """
    kind = dict(docs.dtypes)[id]
    schema = OUT.format(kind=kind)
    names = [f.split()[0] for f in schema.split(", ")]
    rows = cut(tokenised(docs, a_path, b_path, text, id))
    pairs = chunk_pairs(rows)
    graded = pairs.select("chunk", "pair").join(pair_counts(pairs, len(sentence_pieces(b_path).pieces)), "pair")
    texts = rows.where("pairs IS NULL").drop("pairs", "holders")

    def graded_rows(own: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("pair").to_numpy())
        holders, best = (known.column(c).to_numpy()[order] for c in ("holders", "best"))
        n_best, total = np.zeros(own.num_rows, np.int64), np.zeros(own.num_rows, np.int64)
        for k, data in enumerate(own.column("places").to_pylist()):
            place, times = unpacked(data)
            n_best[k], total[k] = (times * best[place]).sum(), (times * holders[place]).sum()
        fields = {c: own.column(c) for c in names if c in own.column_names} | {"n_best": pa.array(n_best), "count_sum": pa.array(total)}
        return pa.table({c: fields[c] for c in names})

    return texts.groupBy("chunk").cogroup(graded.groupBy("chunk")).applyInArrow(graded_rows, schema)
