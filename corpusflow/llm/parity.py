"""Jaccard join of word-shingle sets by parity sketches.

A bit sketch has a bit per hash value of a shingle, and every shingle flips its
bit. A shingle that only one of two sets has flips one bit of the difference, so
the Hamming distance of two sketches is at most the symmetric difference, and
sets of similarity 0.75 differ in at most a seventh of their joint size.

Candidates come from sketches too wide to be stored, cut into cells by size
band: about as many cells as a set has shingles, each known by the XOR of its
shingles' hashes; small sets have a cell for every hash. Unequal cells are again
at most the symmetric difference. By the pigeonhole principle, linked sets share
one of their ``d + 1`` first nonzero cells in any common order, where ``d``
bounds the unequal cells; cells that are rare in the corpus come first. Sets
that share such a cell, and whose stored sketches are near enough, are compared
exactly.

Equal sets are one class from the start. Sets are known by 64-bit signatures and
shingles by 64-bit hashes. Stored sketches have a bit per shingle or more.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import byte_values, mix, per_text_windows, signed, small_batches, space_bytes, text_slices, word_hashes
from .components import components
from .coordinates import WANTED_BITS, wanted_bits
from .tables import cut, fresh, partitions

SHINGLE = 5
PERCENT = 75
#: Sets of fewer shingles have a cell for every hash; larger ones as many as the power of two above their size.
GRID_FROM = 256
#: Counters that say which cells are rare; a fixed number, whatever the corpus.
COUNTERS, COUNTER_CHUNK = 1 << 20, 1 << 14
#: Cells per reduce bucket, and cells that a task holds before it sends them on.
BUCKET_CELLS, HELD_CELLS = 1 << 21, 1 << 20
#: Up to so many sets that share a cell are paired at once; more go by stars first.
SMALL_RUN = 24
#: Sets of a large run that one task compares with as many others.
RUN_BLOCK = 1024
#: Members of large runs per task, and of one component's runs that stay together in a task.
TASK_MEMBERS, KEPT_MEMBERS = 20_000, 2_000
_GAPS = space_bytes()
_VALUES = byte_values(fold_case=True)
_LANE = mix(np.arange(1, 65, dtype=np.uint64))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text; the set may be empty."""
    for part in text_slices(column):
        words, first = word_hashes(part, _GAPS, _VALUES)
        hashes, _, owner = per_text_windows(words, first, size)
        edges = np.searchsorted(owner, np.arange(part.count + 1))
        for t in range(part.count):
            yield part.first + t, np.unique(hashes[edges[t] : edges[t + 1]])


def signature(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set: its size, sum and exclusive-or, mixed."""
    total = np.array([np.add.reduce(shingles), np.bitwise_xor.reduce(shingles), len(shingles)], dtype=np.uint64)
    one = mix(total[2:] + _LANE[0])
    one = mix(one ^ total[:1])
    return int(signed(mix(one + total[1:2]))[0])


def bit_sketch(shingles: np.ndarray) -> bytes:
    """The parity of the shingles per bit; at least two bits per shingle, a power of two."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    parity = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer one folded to the length of the other."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    n = min(len(x), len(y))
    both = np.bitwise_xor.reduce(np.concatenate([x.reshape(-1, n), y.reshape(-1, n)]), axis=0)
    return int(np.bitwise_count(both).sum())


def halved(sketch: bytes) -> bytes:
    """A sketch of half the bits, each the parity of two; its distances bound the difference too."""
    bits = np.frombuffer(sketch, dtype=np.uint8)
    return np.bitwise_xor(*bits.reshape(2, -1)).tobytes() if len(bits) > 8 else sketch


#: Least shingles of a set whose pairs tell sets that have near copies from most others.
HINTED = 4
_PAIRED = np.triu_indices(HINTED, 1)


def hints(shingles: np.ndarray) -> np.ndarray:
    """Names of the pairs of a set's least shingles; near copies have one in common, chance hits are rare."""
    least = np.pad(shingles[:HINTED], (0, max(0, HINTED - len(shingles))))
    return mix(mix(least[_PAIRED[0]] + _LANE[1]) ^ least[_PAIRED[1]])


def band(n: int) -> int:
    """Sizes from 2**b are band b; all small sizes are band 0."""
    return n.bit_length() - 1 if n >= GRID_FROM else 0


def bands(n: int, percent: int = PERCENT) -> list[int]:
    """The bands in which a set is compared: its own, and the next if a linked set can be there."""
    largest = n * 100 // percent
    return [band(n)] if band(largest) == band(n) else [band(n), band(largest)]


def cells(shingles: np.ndarray, b: int) -> np.ndarray:
    """The nonzero cells of the sketch in a band, each named by its place and parity."""
    if b == 0:
        return mix(shingles ^ _LANE[0])
    place = shingles & np.uint64((1 << (b + 1)) - 1)
    order = np.argsort(place, kind="stable")
    place, values = place[order], shingles[order]
    opens = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    parity = np.bitwise_xor.reduceat(mix(values), opens)
    full = parity != 0
    return mix(parity[full] ^ mix(place[opens][full] ^ _LANE[b]))


def first_cells(n: int, b: int, percent: int = PERCENT) -> int:
    """How many first cells two linked sets cannot all differ in."""
    if b == 0:  # a cell is a shingle, and a linked set lacks at most this many
        return n - math.ceil(n * percent / 100) + 1
    # |A xor B| <= (100 - percent) / (100 + percent) * (|A| + |B|)
    return (100 - percent) * (n + n * 100 // percent) // (100 + percent) + 1


def surveyed(docs: DataFrame, text: str, id: str, size: int, percent: int) -> DataFrame:
    """Two kinds of rows: (doc_id, print, n, sig, sketch, hints) per document, and (chunk, counts): how often cells occur, per task."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        ids = None
        for batch in small_batches(batches):
            ids = batch.column(0)
            sizes, names = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            held: list[np.ndarray] = []
            sketches: list[bytes | None] = [None] * batch.num_rows
            near: list[np.ndarray | None] = [None] * batch.num_rows
            for row, own in shingle_sets(batch.column(1), size):
                sizes[row] = len(own)
                if len(own):
                    names[row] = signature(own)
                    sketches[row] = halved(bit_sketch(own))
                    near[row] = signed(hints(own))
                    held += [cells(own, b) for b in bands(len(own), percent)]
            if held:
                total += np.bincount((np.concatenate(held) >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
            nothing = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(sizes), pa.array(names), pa.array(sketches, pa.binary()), pa.array(near, pa.list_(pa.int64())), nothing.cast(pa.int32()), nothing.cast(pa.binary())], names=columns)
        chunks = [(k, zlib.compress(total[k * COUNTER_CHUNK : (k + 1) * COUNTER_CHUNK].astype(np.uint32).tobytes(), 1)) for k in range(COUNTERS // COUNTER_CHUNK)] if total.any() else []
        if chunks:
            nothing = pa.nulls(len(chunks))
            yield pa.RecordBatch.from_arrays(
                [nothing.cast(ids.type), *[nothing.cast(pa.int64())] * 3, nothing.cast(pa.binary()), nothing.cast(pa.list_(pa.int64())), pa.array([k for k, _ in chunks], pa.int32()), pa.array([c for _, c in chunks], pa.binary())],
                names=columns)

    columns = ["doc_id", "print", "n", "sig", "sketch", "hints", "chunk", "counts"]
    kind = dict(docs.dtypes)[id]
    own = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print"))
    return own.mapInArrow(survey, f"doc_id {kind}, print long, n long, sig long, sketch binary, hints array<long>, chunk int, counts binary")


def cell_counts(rows: DataFrame) -> np.ndarray:
    """The summed counters of all tasks."""

    def add(chunk: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTER_CHUNK, dtype=np.uint64)
        for counts in chunk["counts"]:
            total += np.frombuffer(zlib.decompress(counts), dtype=np.uint32)
        return pd.DataFrame({"chunk": [int(chunk["chunk"].iloc[0])], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    out = np.zeros(COUNTERS, dtype=np.uint32)
    for k, counts in rows.where("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect():
        out[k * COUNTER_CHUNK : (k + 1) * COUNTER_CHUNK] = np.frombuffer(counts, dtype=np.uint32)
    return out


def bit_place(column: str) -> Column:
    """The bit of a filter that stands for a value, as ``at``."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(WANTED_BITS)).alias("at")


def hinted(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places are set in a filter of ``wanted_bits``."""
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def repeated_hints(survey: DataFrame) -> np.ndarray:
    """A filter of a fixed size of the hints that different sets have in common."""
    every = survey.where("n > 0").select("sig", F.explode("hints").alias("hint"))
    shared = every.groupBy("hint").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high")
    return wanted_bits(shared.select(F.pmod("hint", F.lit(WANTED_BITS)).alias("at")))


PACK = "bucket int, sigs binary, sizes binary, lengths binary, least binary, cells binary"
#: Names of cells that come with a set into every bucket, and bytes of each.
LEAST, NAME_BYTES = 3, 5


def cell_names(place: np.ndarray | int, cells: np.ndarray) -> np.ndarray:
    """Names of cells by bucket and short cell; never zero."""
    return (mix(np.asarray(place, dtype=np.uint64) << np.uint64(32) | cells.astype(np.uint64)) & np.uint64((1 << 8 * NAME_BYTES) - 1)) | np.uint64(1)


def least_names(names: np.ndarray) -> np.ndarray:
    """The ``LEAST`` least names, zeros where there are fewer."""
    least = np.unique(names)[:LEAST]
    return np.pad(least, (0, LEAST - len(least)))


def packed_names(names: np.ndarray) -> bytes:
    return np.ascontiguousarray(names, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES].tobytes()


def unpacked_names(data: bytes) -> np.ndarray:
    short = np.frombuffer(data, dtype=np.uint8).reshape(-1, NAME_BYTES)
    return np.pad(short, ((0, 0), (0, 8 - NAME_BYTES))).view("<u8").reshape(-1, LEAST)


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers by bytes of one rank, packed, so that the high ones, mostly zero, take little room."""
    return zlib.compress(np.ascontiguousarray(numbers, dtype="<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def rare_cells(docs: DataFrame, text: str, size: int, percent: int, counts: np.ndarray, buckets: int, repeated: np.ndarray | None = None) -> DataFrame:
    """The first cells of every document, packed by range of cells: a row per task and bucket, not per cell.

    Inside a bucket 32 bits stand for a cell; two that fall together only make
    more candidates. With a set go the least names of its first cells, see
    ``met_elsewhere``: with every set, or with those that have a hint of a filter
    ``repeated``. Others have zeros, and their pairs are made wherever they meet.
    """
    shared = docs.sparkSession.sparkContext.broadcast((counts, repeated))  # COUNTERS numbers and WANTED_BITS bits

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, bits = shared.value
        names, sizes, found, likely, held, seen = [], [], [], [], 0, set()

        def packed() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(f) for f in found])
            every, owner = np.concatenate(found), np.repeat(np.arange(len(found)), lengths)
            place = ((every >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            every = every.astype(np.uint32)
            least = np.zeros((len(found), LEAST), dtype=np.uint64)
            ends = np.cumsum(lengths)
            for k in np.flatnonzero(likely).tolist():
                part = slice(ends[k] - lengths[k], ends[k])
                least[k] = least_names(cell_names(place[part], every[part]))
            order = np.argsort(place, kind="stable")  # owners stay in order inside a bucket
            every, owner, place = every[order], owner[order], place[order]
            edges = np.searchsorted(place, np.arange(buckets + 1))
            sig, n, rows = np.array(names, dtype=np.int64), np.array(sizes, dtype=np.int32), []
            for b in range(buckets):
                i, j = edges[b], edges[b + 1]
                if j > i:
                    who, times = np.unique(owner[i:j], return_counts=True)
                    rows.append((b, sig[who].tobytes(), planes(n[who]), planes(times), packed_names(least[who]), every[i:j].tobytes()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=[f.split()[0] for f in PACK.split(", ")])

        for batch in small_batches(batches):
            for _, own in shingle_sets(batch.column(0), size):
                if not len(own):
                    continue
                name = signature(own)
                if name in seen:  # copies in this task add nothing
                    continue
                seen.add(name)
                near = bits is None or bool(hinted(bits, signed(hints(own)) % WANTED_BITS).any())
                for b in bands(len(own), percent):
                    all_cells = cells(own, b)
                    order = np.lexsort((all_cells, common[(all_cells >> np.uint64(44)).astype(np.int64)]))
                    first = all_cells[order[: first_cells(len(own), b, percent)]]
                    names.append(name)
                    sizes.append(len(own))
                    found.append(first)
                    likely.append(near)
                    held += len(first)
                if held >= HELD_CELLS:
                    yield from packed()
                    names, sizes, found, likely, held = [], [], [], [], 0
        if held:
            yield from packed()

    return docs.select(F.col(text).alias("text")).mapInArrow(pick, PACK)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def met_elsewhere(a: np.ndarray, b: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Which pairs of sets need not be made at the cells named ``here``.

    ``a`` and ``b`` hold the least names of either side's first cells. A name in
    both is a cell that the two share, so they meet there as well; of those
    cells the one of the least name makes the pair.
    """
    shared = ((a[:, :, None] == b[:, None, :]).any(axis=2)) & (a != 0)
    chosen = np.where(shared, a, np.uint64(2**64 - 1)).min(axis=1)
    return shared.any(axis=1) & (chosen != here)


def bucket_pairs(cell: np.ndarray, sig: np.ndarray, n: np.ndarray, owner: np.ndarray, least: np.ndarray, bucket: int, percent: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """From the cells of one bucket: candidate pairs, ordered by their first set, and the (cell, sig) rows of large runs.

    ``least[owner]`` are the least names of the set that a cell is of. Runs of
    sets that share a cell are paired at once if they are small; the lesser
    signature comes first, and pairs that surely meet elsewhere are left out. In a large run sets are ordered by size and
    tied to the least one within reach of their size, which comes second: so no
    set comes first in more pairs than its cells times ``SMALL_RUN``.
    """
    order = np.lexsort((sig, n, cell))
    cell, sig, n, owner = cell[order], sig[order], n[order], owner[order]
    new = np.r_[True, (cell[1:] != cell[:-1]) | (sig[1:] != sig[:-1])] if len(cell) else np.zeros(0, bool)
    cell, sig, n, owner = cell[new], sig[new], n[new], owner[new]
    opens = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
    length = np.repeat(np.diff(np.r_[opens, len(cell)]), np.diff(np.r_[opens, len(cell)]))
    left, right, tied, centre = ([np.zeros(0, np.int64)] for _ in range(4))
    some = np.flatnonzero((length > 1) & (length <= SMALL_RUN))
    c, s, m, own, names = cell[some], sig[some], n[some], owner[some], cell_names(bucket, cell[some])
    for lag in range(1, SMALL_RUN):
        ok = (c[lag:] == c[:-lag]) & (m[:-lag] * 100 >= m[lag:] * percent)
        if not ok.any():
            if not (c[lag:] == c[:-lag]).any():
                break
            continue
        at = np.flatnonzero(ok)
        at = at[~met_elsewhere(least[own[at]], least[own[at + lag]], names[at])]
        left.append(s[at])
        right.append(s[at + lag])
    large = length > SMALL_RUN
    for i in opens[large[opens]].tolist() if len(opens) else []:
        j = i + int(length[i])
        while i < j:
            stop = i + int(np.searchsorted(n[i:j], n[i] * 100 // percent, side="right"))
            tied.append(sig[i + 1 : stop])
            centre.append(np.full(stop - i - 1, sig[i]))
            i = max(stop, i + 1)
    left, right = np.concatenate(left), np.concatenate(right)
    return _distinct_pairs(np.concatenate([np.minimum(left, right), *tied]), np.concatenate([np.maximum(left, right), *centre])), (cell[large], sig[large])


def candidates(packs: DataFrame, percent: int) -> DataFrame:
    """Rows (cell, u, others): the partners of a set in a bucket, with a null cell, and members of large runs, with null others.

    Both are at most as many as the cells that came in: pairs stay packed by their first set.
    """

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        read = lambda name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in rows[name]])
        number = lambda name: np.concatenate([from_planes(x) for x in rows[name]]).astype(np.int64)
        owner = np.repeat(np.arange(len(lengths := number("lengths"))), lengths)
        least, bucket = np.concatenate([unpacked_names(x) for x in rows["least"]]), int(rows["bucket"].iloc[0])
        (u, v), (at, member) = bucket_pairs(
            read("cells", np.uint32), read("sigs", np.int64)[owner], number("sizes")[owner], owner, least, bucket, percent)
        at = bucket << 32 | at.astype(np.int64)
        first, opens = np.unique(u, return_index=True)  # u is in order
        return pd.DataFrame({
            "cell": pd.arrays.IntegerArray(np.r_[np.zeros(len(first), np.int64), at], np.r_[np.ones(len(first), bool), np.zeros(len(at), bool)]),
            "u": np.r_[first, member],
            "others": pd.Series([*(np.split(v, opens[1:]) if len(first) else []), *[None] * len(member)], dtype=object),
        })

    return packs.groupBy("bucket").applyInPandas(pair, "cell long, u long, others array<long>")


def distinct_pairs(found: DataFrame) -> DataFrame:
    """The pairs (u, v) that buckets have found, each once, u < v; partners of a set are merged before a row is made for each."""
    merged = found.where("others IS NOT NULL").groupBy("u").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    met = merged.select("u", F.explode("others").alias("v"))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sketches do not rule a link out."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            u, v, n, m, a, b = batch.columns
            joint = n.to_numpy(zero_copy_only=False) + m.to_numpy(zero_copy_only=False)
            distance = np.array([sketch_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(distance * (100 + percent) <= joint * (100 - percent)))

    side = lambda name, n, sketch: classes.select(F.col("sig").alias(name), F.col("n").alias(n), F.col("sketch").alias(sketch))
    return pairs.join(side("u", "n", "a"), "u").join(side("v", "m", "b"), "v").select("u", "v", "n", "m", "a", "b").mapInArrow(compare, "u long, v long")


def shingle_table(wanted: DataFrame, docs: DataFrame, classes: DataFrame, text: str, id: str, size: int) -> DataFrame:
    """(sig, shingles) of the wanted sets, each from one document that has it.

    Texts are not shuffled to find those documents: a filter of a fixed size
    tells most of the others, and what it lets through by chance goes by name.
    """
    some = classes.join(wanted, "sig", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(wanted_bits(some.select(bit_place("least_id"))))  # WANTED_BITS bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in small_batches(batches):
            batch = batch.filter(pa.array(hinted(bits, batch.column(0).to_numpy(zero_copy_only=False))))
            rows = [(signature(own), own.tobytes()) for _, own in shingle_sets(batch.column(1), size) if len(own)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["sig", "shingles"])

    sets = docs.select(bit_place(id), F.col(text).alias("text")).mapInArrow(build, "sig long, shingles binary")
    return cut(sets.groupBy("sig").agg(F.first("shingles").alias("shingles")).join(wanted, "sig", "left_semi"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets reach the similarity, by their shingles."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                keep[k] = linked(np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64), percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return (pairs.join(sets.select(F.col("sig").alias("u"), F.col("shingles").alias("a")), "u")
            .join(sets.select(F.col("sig").alias("v"), F.col("shingles").alias("b")), "v")
            .select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"))


def dealt_blocks(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(cell, a, b, own, sig, root, task): members of large runs of several components, dealt so that every two blocks of a run meet in a task.

    Runs with the same members count once. Runs of one family have most members
    in common; they are kept together by their least root, up to
    ``KEPT_MEMBERS``, so that a set goes to few tasks.
    """
    placed = members.join(roots, members["sig"] == roots["vertex"], "left").select("cell", "sig", F.coalesce("root", "sig").alias("root"))
    runs = placed.groupBy("cell").agg(
        F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("print"), F.bit_xor("sig").alias("parity"))
    mixed = runs.where("low <> high").groupBy("size", "print", "parity").agg(F.min(F.struct("cell", "low")).alias("one"))
    mixed = mixed.select("one.cell", "one.low", F.ceil(F.col("size") / F.lit(RUN_BLOCK)).cast("int").alias("blocks"), "size")
    # a member of a run stands in as many rows as the run has blocks; every two blocks are a place of their own
    parts = mixed.groupBy("low").agg(F.ceil(F.sum(F.col("size") / F.col("blocks")) / F.lit(KEPT_MEMBERS)).alias("parts"))
    runs = mixed.join(parts, "low").select("cell", "blocks", F.xxhash64("low", F.pmod(F.xxhash64("cell"), F.col("parts"))).alias("family"))
    dealt = placed.join(runs, "cell").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    met = cut(dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cell", "family", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "sig", "root"))
    tasks = max(1, math.ceil(met.count() / TASK_MEMBERS))
    return met.withColumn("task", F.pmod(F.xxhash64("family", "a", "b"), F.lit(tasks))).drop("family")


def open_members(met: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(task, sig): the sets of a task with a set of another component near them, by sketches alone."""
    needed = met.groupBy(F.col("task").alias("to"), F.col("sig").alias("of")).agg(F.lit(1).alias("_"))
    known = classes.select(F.col("sig").alias("of"), "n", "sketch")
    needed = needed.join(known, "of").select("to", F.col("of").alias("sig"), "n", "sketch")

    def compare(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values(["n", "sig"]).reset_index(drop=True)
        at = pd.Series(known.index, index=known["sig"])
        n, sketches, sigs = known["n"].to_numpy(), list(known["sketch"]), known["sig"].to_numpy()
        seen = np.zeros(len(known), dtype=bool)
        for (_, a, b), run in rows.groupby(["cell", "a", "b"], sort=False):
            own = at[run["sig"]].to_numpy()
            order = np.argsort(own)
            own, root, block = own[order], run["root"].to_numpy()[order], run["own"].to_numpy()[order]
            for side in open_pairs(root, n[own], block, [sketches[k] for k in own.tolist()], a == b, percent):
                seen[own[side]] = True
        return pd.DataFrame({"task": np.full(int(seen.sum()), rows["task"].iloc[0] if len(rows) else 0), "sig": sigs[seen]}).astype("int64")

    return met.groupBy("task").cogroup(needed.groupBy("to")).applyInPandas(compare, "task long, sig long")


def crossing_links(met: DataFrame, near: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that stars left open in large runs: enough of them to connect all that are linked.

    ``met`` are the members of blocks by task, ``near`` those that have a near
    one of another component; the others can have no link. A task checks near pairs of
    different components by their shingles, and gives only links that join what
    its earlier links have not joined; each set is sent to a task once.
    """
    met = met.join(near, ["task", "sig"], "left_semi")
    known = classes.select("sig", "n", "sketch").join(sets, "sig")
    needed = near.withColumnRenamed("task", "to").join(known, "sig").select("to", "sig", "n", "sketch", "shingles")

    def compare(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values(["n", "sig"]).reset_index(drop=True)
        at = pd.Series(known.index, index=known["sig"])
        n, sketches = known["n"].to_numpy(), list(known["sketch"])
        shingles = [np.frombuffer(x, dtype=np.uint64) for x in known["shingles"]]
        joined: dict[int, int] = {}
        failed: set[tuple[int, int]] = set()
        links = []

        def find(root: int) -> int:
            while (up := joined.get(root, root)) != root:
                joined[root] = root = joined.get(up, up)
            return root

        for (_, a, b), run in rows.groupby(["cell", "a", "b"], sort=False):
            own = np.sort(at[run["sig"]].to_numpy())
            by_sig = dict(zip(run["sig"], zip(run["root"], run["own"], strict=True), strict=True))
            first = [by_sig[s][0] for s in known["sig"].to_numpy()[own].tolist()]
            root = np.array([find(r) for r in first], dtype=np.int64)
            if (root == root[0]).all():
                continue
            block = np.array([by_sig[s][1] for s in known["sig"].to_numpy()[own].tolist()])
            for i, j in zip(*(x.tolist() for x in open_pairs(root, n[own], block, [sketches[k] for k in own], a == b, percent)), strict=True):
                u, v = find(first[i]), find(first[j])
                pair = (int(own[i]), int(own[j]))
                if u == v or pair in failed:
                    continue
                if linked(shingles[pair[0]], shingles[pair[1]], percent):
                    joined[u] = v
                    links.append((known["sig"].iloc[pair[0]], known["sig"].iloc[pair[1]]))
                else:
                    failed.add(pair)
        return pd.DataFrame(links, columns=["u", "v"]).astype("int64")

    return met.groupBy("task").cogroup(needed.groupBy("to")).applyInPandas(compare, "u long, v long")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of shingles reach the similarity."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def open_pairs(root: np.ndarray, n: np.ndarray, block: np.ndarray, sketches: list[bytes], within: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sets in the order of size, the places of pairs of different roots (and blocks, unless ``within``) whose sketches are near enough."""
    lengths = np.array([len(s) for s in sketches])
    own = {k: np.frombuffer(b"".join(s for s in sketches if len(s) == k), dtype=np.uint8).reshape(-1, k) for k in np.unique(lengths).tolist()}
    first = {k: int(np.argmax(lengths == k)) for k in own}  # lengths grow with the size
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    folded: dict[tuple[int, int], np.ndarray] = {}
    for i in range(len(n)):
        stop = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
        k = int(lengths[i])
        mine = own[k][i - first[k]]
        for length in np.unique(lengths[i + 1 : stop]).tolist():
            if (length, k) not in folded:
                folded[length, k] = np.bitwise_xor.reduce(own[length].reshape(len(own[length]), -1, k), axis=1)
            low, high = max(i + 1, first[length]), min(stop, first[length] + len(own[length]))
            at = np.arange(low, high)
            at = at[(root[at] != root[i]) & (within | (block[at] != block[i]))]
            if len(at):
                distance = np.bitwise_count(folded[length, k][at - first[length]] ^ mine).sum(axis=1, dtype=np.int64)
                at = at[distance * (100 + percent) <= (n[at] + n[i]) * (100 - percent)]
                left.append(np.full(len(at), i))
                right.append(at)
    return np.concatenate(left), np.concatenate(right)


def similar_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, print (a 64-bit hash of the text).

    Words are what blanks (0x20, 0x09 to 0x0D) separate, A-Z folded; a set holds
    the distinct shingles of ``size`` words, or all words as one where there are
    fewer. Two texts link when 100 x shared shingles >= ``percent`` x all
    shingles; ``component_id`` is the least id reachable. Null texts and texts
    without words have no shingles and link with nothing: their component is
    their own id. A null id is never the least, unless there is no other. Rows
    that repeat get a row each, an empty table gives none, other columns are
    not read. Every linked pair of different sets is either compared or already
    connected by links that were.
    """
    spark = docs.sparkSession
    survey = cut(surveyed(docs, text, id, size, percent))
    rows = survey.where("chunk IS NULL").select("doc_id", "print", "n", "sig")
    classes = cut(survey.where("chunk IS NULL AND n > 0").groupBy("sig").agg(F.min("doc_id").alias("least_id"), F.max("n").alias("n"), F.first("sketch").alias("sketch")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions(spark), math.ceil(total / BUCKET_CELLS))
    found = cut(candidates(rare_cells(docs, text, size, percent, cell_counts(survey), buckets, repeated_hints(survey)), percent))
    pairs = cut(near_enough(distinct_pairs(found), classes, percent))
    members = found.where("others IS NULL").select("cell", F.col("u").alias("sig"))
    ends = pairs.select(F.col("u").alias("sig")).unionAll(pairs.select(F.col("v").alias("sig"))).distinct()
    links = cut(verified(pairs, shingle_table(ends, docs, classes, text, id, size), percent))
    roots = cut(components(links, "u", "v"))
    met = dealt_blocks(members, roots)
    near = cut(open_members(met, classes, percent))
    if near.isEmpty():
        more = near.select(F.col("task").alias("u"), F.col("sig").alias("v"))
    else:
        more = cut(crossing_links(met, near, classes, shingle_table(near.select("sig").distinct(), docs, classes, text, id, size), percent))
    if not more.isEmpty():
        roots = cut(components(links.unionAll(more), "u", "v"))
    least = (roots.join(classes.select("sig", "least_id"), F.col("vertex") == F.col("sig")).groupBy("root").agg(F.min("least_id").alias("component_id")))
    placed = classes.select("sig", "least_id").join(roots, F.col("sig") == F.col("vertex"), "left").join(least, "root", "left").select(
        "sig", F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"))
    return _placed(rows, placed)


def _placed(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Component of every row; rows without shingles do not enter the join."""
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "print")
    full = rows.where("n > 0").join(placed, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "print")
    return full.unionAll(empty)


def keep_one_similar(docs: DataFrame, text: str = "text", id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of linked texts: that with the least id; all columns as they were.

    Rows without words are kept; rows that tie in the least id all stay.
    """
    gone, gone_print = fresh(docs, "gone", "gone_print")
    groups = similar_groups(docs, text, id, size, percent)
    dropped = groups.where("n_shingles > 0 AND NOT (doc_id <=> component_id)").select(F.col("doc_id").alias(gone), F.col("print").alias(gone_print)).distinct()
    same = F.col(id).eqNullSafe(F.col(gone)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(gone_print))
    return docs.join(dropped, same, "left_anti")
