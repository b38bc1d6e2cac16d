"""Near-duplicates by an inverted join over the coordinates of MinHash signatures.

A signature has one minimum of hashed shingles per coordinate; two sets agree in
a coordinate with the probability of their Jaccard similarity. Every distinct
set is posted under its coordinate-value pairs, and sets that agree in at least
``matches`` coordinates are candidates.

Postings are merged with prefix and skip: pairs of a set are put in one order
for all, those that few sets have first. Two signatures with ``matches`` equal
coordinates out of ``K`` must share one of their first ``K - matches + 1`` pairs,
so only those are posted; the remaining lists, the long ones, are skipped, and
the agreements of candidates are counted from their signatures directly.

Only components are wanted, so a list does not give all its pairs. Each set of a
list is tied to the first earlier *leader* it agrees with, which is at most one
pair per posting; of its ties the one with most agreements is checked on the
full sets of shingles. Those that hold make components. Lists whose members still lie in several components are then
searched in blocks inside tasks, where only pairs across components count and
a task gives a link only if it joins what its own links have not joined.

Equal sets are one class from the start, named by 128-bit digests. Shingles are
known by 64-bit hashes of word hashes that are not linear in the bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Slice, mix, per_text_windows, signed, small_batches, space_bytes, text_slices, word_spans
from .components import components
from .tables import cut, partitions

SHINGLE, PERCENT = 5, 85
COORDINATES = 64
#: The chance that a linked pair agrees in fewer coordinates than are asked for.
MISSED = 1e-10
#: Counters that say which coordinate-value pairs are rare; a fixed number, whatever the corpus.
COUNTERS, COUNTER_CHUNK = 1 << 18, 1 << 14
#: Postings per reduce bucket, and postings a task holds before it sends them on.
BUCKET_POSTS, HELD_POSTS = 1 << 19, 1 << 18
#: Leaders tried per list before its open rest is left to the block search.
LEADERS = 32
#: Lists up to this length keep only members that agree with another one.
SHORT_LIST = 128
#: Members of a list that are compared with as many others at once, and members per task.
BLOCK, TASK_MEMBERS = 512, 8_000
#: Bits of the filter of documents whose sets are wanted; a fixed number. A false hit costs a row, not a result.
WANTED_BITS, WANTED_CHUNK = 1 << 25, 1 << 19
_GAPS = space_bytes()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Words beyond this are hashed one by one.
SHORT_WORD = 256


def word_names(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of a slice, A-Z folded, and the first word of each text.

    Eight bytes at a time go through a mixing step, so equal hashes of different
    words are left to chance, whatever patterns the words have.
    """
    start, end, first = word_spans(part, _GAPS)
    data = np.concatenate([_FOLD[part.data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    length = end - start
    out = mix((length.astype(np.uint64) + np.uint64(1)) * _ODD)
    live, step = np.flatnonzero(length <= SHORT_WORD), 0
    while len(live := live[length[live] > step]):
        block = eight[start[live] + step] & _KEEP[np.minimum(length[live] - step, 8)]
        out[live] = mix((out[live] ^ mix(block + _ODD)) + _ODD)
        step += 8
    for k in np.flatnonzero(length > SHORT_WORD).tolist():
        out[k] = int.from_bytes(blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out, first


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every text; the set may be empty."""
    for part in text_slices(column):
        words, first = word_names(part)
        hashes, _, owner = per_text_windows(words, first, size)
        edges = np.searchsorted(owner, np.arange(part.count + 1))
        for t in range(part.count):
            yield part.first + t, np.unique(hashes[edges[t] : edges[t + 1]])


def lanes(count: int) -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and an addend per coordinate."""
    numbers = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * _ODD)
    return numbers[:count] | np.uint64(1), numbers[count:]


def signatures(shingles: np.ndarray, edges: np.ndarray, count: int) -> np.ndarray:
    """The minimum per coordinate (32 bits) of each of several sets, which are not empty and stand one after another."""
    factors, addends = lanes(count)
    out = np.empty((len(edges) - 1, count), dtype=np.uint32)
    for k in range(count):
        value = shingles * factors[k] + addends[k]
        value ^= value >> np.uint64(29)
        value *= _ODD
        out[:, k] = np.minimum.reduceat(value >> np.uint64(32), edges[:-1])
    return out


def least_matches(count: int, percent: int, missed: float = MISSED) -> int:
    """The most coordinates that a pair at the threshold agrees in but for a chance of ``missed``."""
    p, below = percent / 100, 0.0
    for k in range(count + 1):
        below += math.comb(count, k) * p**k * (1 - p) ** (count - k)
        if below > missed:
            return max(k, 1)
    return count


def pairs_of(values: np.ndarray) -> np.ndarray:
    """64-bit names of the coordinate-value pairs of signatures."""
    lane = mix(np.arange(1, values.shape[-1] + 1, dtype=np.uint64))
    return mix(values.astype(np.uint64) * _ODD ^ lane)


def surveyed(docs: DataFrame, text: str, id: str, size: int, count: int) -> DataFrame:
    """(doc_id, n, sig, values, short) per document: size of its set, its 128-bit name and its signature, whole and short."""
    kind = dict(docs.dtypes)[id]

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            names: list[bytes | None] = [None] * batch.num_rows
            values: list[bytes | None] = [None] * batch.num_rows
            short: list[bytes | None] = [None] * batch.num_rows
            rows, held, total = [], [], 0

            def close() -> None:
                nonlocal total
                if rows:
                    edges = np.r_[0, np.cumsum([len(h) for h in held])]
                    found = signatures(np.concatenate(held), edges, count)
                    for row, own, small in zip(rows, found, short_values(found), strict=True):
                        values[row], short[row] = own.tobytes(), small.tobytes()
                rows.clear()
                held.clear()
                total = 0

            for row, own in shingle_sets(batch.column(1), size):
                sizes[row] = len(own)
                if len(own):
                    names[row] = blake2b(own.tobytes(), digest_size=16).digest()
                    rows.append(row)
                    held.append(own)
                    total += len(own)
                    if total > 1 << 16:
                        close()
            close()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(names, pa.binary()), pa.array(values, pa.binary()), pa.array(short, pa.binary())], names=["doc_id", "n", "sig", "values", "short"])

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(survey, f"doc_id {kind}, n long, sig binary, values binary, short binary")


def pair_counters(classes: DataFrame, count: int) -> np.ndarray:
    """How many sets have the coordinate-value pairs of each counter."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in small_batches(batches):
            values = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint32).reshape(-1, count)
            total += np.bincount((pairs_of(values).ravel() >> np.uint64(46)).astype(np.int64), minlength=COUNTERS)
        if total.any():
            chunks = total.reshape(-1, COUNTER_CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())], names=["chunk", "counts"])

    def add(chunk: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.int64) for c in chunk["counts"])
        return pd.DataFrame({"chunk": chunk["chunk"].iloc[:1], "counts": [total.tobytes()]})

    out = np.zeros(COUNTERS, dtype=np.int64)
    tallies = classes.select("values").mapInArrow(tally, "chunk int, counts binary").groupBy("chunk").applyInPandas(add, "chunk int, counts binary")
    for k, counts in tallies.collect():  # COUNTERS numbers
        out[k * COUNTER_CHUNK : (k + 1) * COUNTER_CHUNK] = np.frombuffer(counts, dtype=np.int64)
    return out


def first_pairs(values: np.ndarray, counts: np.ndarray, keep: int) -> np.ndarray:
    """The first ``keep`` pairs of each signature in the order for all: rare ones first."""
    pairs = pairs_of(values)
    order = np.lexsort((pairs, counts[(pairs >> np.uint64(46)).astype(np.int64)]), axis=1)[:, :keep]
    return np.take_along_axis(pairs, order, axis=1)


def short_values(values: np.ndarray) -> np.ndarray:
    """One byte per coordinate: equal values stay equal, so agreements are never missed, only made up now and then."""
    return (mix(values.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)


POSTS = "bucket int, classes binary, sizes binary, posts binary, pairs binary, shorts binary"


def postings(classes: DataFrame, counts: np.ndarray, count: int, keep: int, buckets: int) -> DataFrame:
    """First pairs of every set, packed by range of pairs: a row per task and bucket."""
    shared = classes.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers
    names = [f.split()[0] for f in POSTS.split(", ")]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def packed() -> pa.RecordBatch:
            own, sizes, values, short = (np.concatenate(x) for x in zip(*held, strict=True))
            pairs = first_pairs(values, shared.value, keep)
            place = ((pairs >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64).ravel()
            order = np.argsort(place, kind="stable")
            owner, flat = order // keep, pairs.ravel()
            edges = np.searchsorted(place[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                at = order[edges[b] : edges[b + 1]]
                who, times = np.unique(owner[edges[b] : edges[b + 1]], return_counts=True)
                rows.append((b, own[who].tobytes(), sizes[who].tobytes(), times.astype(np.int32).tobytes(), flat[at].tobytes(), short[who].tobytes()))
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)

        for batch in small_batches(batches, 4000):
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32).reshape(-1, count)
            short = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, count)
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), values, short))
            total += len(values) * keep
            if total >= HELD_POSTS:
                yield packed()
                held.clear()
                total = 0
        if total:
            yield packed()

    return classes.select("class", "n", "values", "short").mapInArrow(post, POSTS)


def led(own: np.ndarray, n: np.ndarray, short: np.ndarray, matches: int, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leader, followers, agreements) of one list: each set goes to the first leader that it agrees with and can reach in size."""
    left = np.lexsort((own, n))
    for _ in range(LEADERS):
        if len(left) < 2:
            return
        leader, rest = left[0], left[1:]
        agreed = (short[rest] == short[leader]).sum(axis=1)
        agrees = (agreed >= matches) & (n[rest] * percent <= n[leader] * 100)
        if agrees.any():
            yield int(leader), rest[agrees], agreed[agrees]
        left = rest[~agrees]


def partnered(n: np.ndarray, short: np.ndarray, matches: int, percent: int) -> np.ndarray:
    """Which members of a list agree often enough with another one; of a list too long to tell, all."""
    if len(n) > SHORT_LIST:
        return np.ones(len(n), dtype=bool)
    agrees = (short[:, None, :] == short[None, :, :]).sum(axis=2) >= matches
    agrees &= np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * percent
    np.fill_diagonal(agrees, False)
    return agrees.any(axis=1)


def merged_lists(posts: DataFrame, count: int, matches: int, percent: int) -> DataFrame:
    """Rows (list, members, u, v, agreed): ties to leaders with a null list, and packed members of lists with null ends."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        own, n, pair, short, base = [], [], [], [], 0
        at = []
        for r in rows.itertuples():
            times = np.frombuffer(r.posts, dtype=np.int32)
            own.append(np.frombuffer(r.classes, dtype=np.int64))
            n.append(np.frombuffer(r.sizes, dtype=np.int64))
            short.append(np.frombuffer(r.shorts, dtype=np.uint8).reshape(-1, count))
            pair.append(np.frombuffer(r.pairs, dtype=np.uint64))
            at.append(np.repeat(np.arange(base, base + len(times)), times))
            base += len(times)
        own, n, pair, short, at = (np.concatenate(x) for x in (own, n, pair, short, at))
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], at[order]
        edges = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1], True])
        ties = [np.zeros((0, 3), np.int64)]
        lists: dict[bytes, bytes] = {}
        for i in np.flatnonzero(np.diff(edges) > 1).tolist():
            members = at[edges[i] : edges[i + 1]]
            for leader, followers, agreed in led(own[members], n[members], short[members], matches, percent):
                followers = own[members[followers]]
                ties.append(np.stack([np.full(len(followers), own[members[leader]]), followers, agreed], axis=1))
            members = members[partnered(n[members], short[members], matches, percent)]
            if len(members):
                body = np.sort(own[members]).tobytes()
                lists[blake2b(body, digest_size=16).digest()] = body
        pairs = np.unique(np.concatenate(ties), axis=0)
        nothing, blank = [None] * len(lists), [None] * len(pairs)
        return pd.DataFrame({
            "list": [*blank, *lists], "members": [*blank, *lists.values()],
            "u": pd.array([*pairs[:, 0].tolist(), *nothing], "Int64"), "v": pd.array([*pairs[:, 1].tolist(), *nothing], "Int64"), "agreed": pd.array([*pairs[:, 2].tolist(), *nothing], "Int64")})

    return posts.groupBy("bucket").applyInPandas(merge, "list binary, members binary, u long, v long, agreed long")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of shingles reach the similarity."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def wanted_bits(ids: DataFrame) -> np.ndarray:
    """A filter with a bit per hash of the ids (a long column ``at`` below ``WANTED_BITS``), put together in the tasks."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.unique(np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy(zero_copy_only=False) for b in batches)]))
        chunk = places // WANTED_CHUNK
        own = np.unique(chunk)
        bits = np.zeros((len(own), WANTED_CHUNK), dtype=bool)
        bits[np.searchsorted(own, chunk), places % WANTED_CHUNK] = True
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())], names=["chunk", "bits"])

    def either(chunk: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in chunk["bits"]])
        return pd.DataFrame({"chunk": chunk["chunk"].iloc[:1], "bits": [bits.tobytes()]})

    out = np.zeros(WANTED_BITS // 8, dtype=np.uint8)
    for k, bits in ids.mapInArrow(mark, "chunk long, bits binary").groupBy("chunk").applyInPandas(either, "chunk long, bits binary").collect():
        out[k * WANTED_CHUNK // 8 : (k + 1) * WANTED_CHUNK // 8] = np.frombuffer(bits, dtype=np.uint8)
    return out


def full_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, text: str, id: str, size: int) -> DataFrame:
    """(class, shingles) of the wanted classes, each from one document that has it.

    Texts are not shuffled to find those documents: a filter of a fixed size
    tells most of the others, and what it lets through by chance goes by name.
    """
    some = classes.join(wanted, "class", "left_semi")
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(WANTED_BITS)).alias("at")
    shared = docs.sparkSession.sparkContext.broadcast(wanted_bits(some.select(place("least_id"))))  # WANTED_BITS bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in small_batches(batches):
            at = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            rows = [(blake2b(own.tobytes(), digest_size=16).digest(), own.tobytes()) for _, own in shingle_sets(batch.column(1), size) if len(own)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.binary())], names=["sig", "shingles"])

    sets = docs.select(place(id), F.col(text).alias("text")).mapInArrow(build, "sig binary, shingles binary")
    return sets.dropDuplicates(["sig"]).join(some.select("sig", "class"), "sig").select("class", "shingles")


def verified(ties: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ties (u, v) whose full sets reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keep = [linked(np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("class").alias(c), F.col("shingles").alias(s)) for c, s in (("u", "a"), ("v", "b")))
    return ties.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


def open_blocks(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(list, head, a, b, own, class, root): members of lists with several components, dealt so that every two blocks meet once.

    ``head`` is the list's least member, which lists of one family have in common.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(members, dtype=np.int64)
                n, blocks = len(own), -(-len(own) // BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.binary()), pa.array(np.full(n, own[0])), pa.array(np.full(n, blocks, np.int32)), pa.array((np.arange(n) % blocks).astype(np.int32)), pa.array(own)],
                    names=["list", "head", "blocks", "own", "class"])

    one_each = lists.groupBy("list").agg(F.first("members").alias("members"))  # lists with the same members count once
    members = one_each.mapInArrow(opened, "list binary, head long, blocks int, own int, class long")
    placed = cut(members.join(roots, F.col("class") == F.col("vertex"), "left").select("list", "head", "blocks", "own", "class", F.coalesce("root", "class").alias("root")))
    mixed = placed.groupBy("list").agg(F.max("blocks").alias("parts"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_parts = mixed.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"))  # so that no task has to read a whole list
    return placed.join(open_parts, ["list", "own"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "list", "head", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "class", "root")


def _open_pairs(own: pd.DataFrame, short: np.ndarray, n: np.ndarray, matches: int, percent: int, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different components, and of different blocks unless ``within``, that agree often enough."""
    root, block = own["root"].to_numpy(), own["own"].to_numpy()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(root) - 1):
        at = np.arange(i + 1, len(root))
        at = at[(root[at] != root[i]) & (within | (block[at] != block[i])) & (np.minimum(n[at], n[i]) * 100 >= np.maximum(n[at], n[i]) * percent)]
        if len(at):
            at = at[(short[at] == short[i]).sum(axis=1) >= matches]
            left.append(np.full(len(at), i))
            right.append(at)
    return np.concatenate(left), np.concatenate(right)


def crossing_links(met: DataFrame, classes: DataFrame, sets_of, count: int, matches: int, percent: int) -> DataFrame | None:
    """Links between components that ties left apart: enough of them to connect all that are linked.

    First members are found that agree often enough with one of another
    component; only their full sets are then sent to the tasks that need them.
    """

    def split(rows: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
        yield from rows.groupby(["list", "a", "b"], sort=False)

    def shorts(rows: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(rows["short"]), dtype=np.uint8).reshape(-1, count)

    def promising(rows: pd.DataFrame) -> pd.DataFrame:
        keep = []
        for (_, a, b), own in split(rows):
            i, j = _open_pairs(own, shorts(own), own["n"].to_numpy(), matches, percent, a == b)
            keep.append(own.iloc[np.union1d(i, j)])
        return pd.concat(keep)[[f.split()[0] for f in schema.split(", ")]] if keep else rows.iloc[:0]

    tasks = max(1, math.ceil(met.count() / TASK_MEMBERS))
    schema = "task long, list binary, a int, b int, own int, class long, root long, n long, short binary"
    # Lists of a family meet in one task, which so needs each set once.
    dealt = met.withColumn("task", F.pmod(F.xxhash64("head", "a", "b"), F.lit(tasks))).drop("head").join(classes.select("class", "n", "short"), "class")
    left = cut(dealt.groupBy("task").applyInPandas(promising, schema))
    if left.isEmpty():
        return None
    sets = sets_of(left.select("class").distinct())
    needed = left.select(F.col("task").alias("to"), F.col("class").alias("of")).distinct().join(sets.withColumnRenamed("class", "of"), "of").select("to", "of", "shingles")

    def settle(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        shingles = {c: np.frombuffer(s, dtype=np.uint64) for c, s in zip(known["of"], known["shingles"], strict=True)}
        joined: dict[int, int] = {}
        failed: set[tuple[int, int]] = set()
        links = []

        def find(root: int) -> int:
            while (up := joined.get(root, root)) != root:
                joined[root] = root = joined.get(up, up)
            return root

        for (_, a, b), own in split(rows):
            i, j = _open_pairs(own, shorts(own), own["n"].to_numpy(), matches, percent, a == b)
            names, roots = own["class"].tolist(), own["root"].tolist()
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                u, v = sorted((names[p], names[q]))
                x, y = find(roots[p]), find(roots[q])
                if x == y or (u, v) in failed:
                    continue
                if linked(shingles[u], shingles[v], percent):
                    joined[x] = y
                    links.append((u, v))
                else:
                    failed.add((u, v))
        return pd.DataFrame(links, columns=["u", "v"]).astype("int64")

    return left.groupBy("task").cogroup(needed.groupBy("to")).applyInPandas(settle, "u long, v long")


def near_duplicates(
    docs: DataFrame, text: str = "text", id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT, count: int = COORDINATES, missed: float = MISSED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are what blanks (0x20, 0x09 to 0x0D) separate, A-Z folded; a set holds
    the distinct shingles of ``size`` words, or all words as one where there are
    fewer. Two texts link when 100 x shared shingles >= ``percent`` x all
    shingles; ``component_id`` is the least id reachable, and ``kept`` tells
    that it is the row's own. A pair that just reaches ``percent`` is missed
    with a chance of ``missed`` or less, a nearer one far more rarely; no pair
    below ``percent`` is ever linked. Null texts and texts without words link
    with nothing. A null id is never the least, unless there is no other, and
    is kept then. Rows that repeat get a row each, an empty table gives none,
    other columns are not read.
    """
    matches = least_matches(count, percent, missed)
    keep = count - matches + 1
    rows = cut(surveyed(docs, text, id, size, count))
    named = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least_id"), F.max("n").alias("n"), F.first("values").alias("values"), F.first("short").alias("short"))
    classes = cut(named).withColumn("class", F.monotonically_increasing_id())  # fixed: the classes are written
    buckets = max(partitions(docs.sparkSession), math.ceil(classes.count() * keep / BUCKET_POSTS))
    found = cut(merged_lists(postings(classes, pair_counters(classes, count), count, keep, buckets), count, matches, percent))
    # One tie per set is checked here, that with most agreements; the search below meets the rest.
    ties = cut(found.where("u IS NOT NULL").groupBy("v").agg(F.max_by("u", F.struct("agreed", "u")).alias("u")).select("u", "v"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        return cut(full_sets(wanted, docs, classes, text, id, size))

    links = cut(verified(ties, sets_of(ties.select(F.col("u").alias("class")).unionAll(ties.select("v")).distinct()), percent))
    roots = cut(components(links, "u", "v"))
    met = cut(open_blocks(found.where("list IS NOT NULL").select("list", "members"), roots))
    more = crossing_links(met, classes, sets_of, count, matches, percent)
    if more is not None:
        roots = cut(components(links.unionAll(cut(more)), "u", "v"))
    least = roots.join(classes.select("class", "least_id"), F.col("vertex") == F.col("class")).groupBy("root").agg(F.min("least_id").alias("component_id"))
    placed = classes.select("sig", "class", "least_id").join(roots, F.col("class") == F.col("vertex"), "left").join(least, "root", "left").select(
        "sig", F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"))
    own = rows.where("n > 0").join(placed, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.unionAll(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
