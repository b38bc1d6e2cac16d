"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``order`` symbols. A symbol
seen in the longest context is coded there; otherwise an escape is paid and the
next shorter context is asked, down to equal shares. Statistics are frozen after
training, so the code length of a symbol depends only on its ``order``
predecessors and is looked up in a table; a text's code length is an exact sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Slice, small_batches, text_slices
from .tables import id_remainder

ORDER = 3
#: Bytes are folded to this many symbols: the most frequent ones of the sample and one for the rest.
SYMBOLS = 40
#: About so many labelled rows of each language, taken by hash of their id, teach its tree.
TRAIN_ROWS = 4_000
UNKNOWN = "und"


def folded_bytes() -> np.ndarray:
    """Byte to byte: A-Z to a-z, the second bytes of Latin-1 capitals to small ones, all blanks to one, digits to one."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[[9, 10, 11, 12, 13]] = 32
    fold[48:58] = 48
    fold[0x80:0xA0] += 0x20
    return fold


_FOLD = folded_bytes()
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


def training_rows(docs: DataFrame, modulus: int, held: int, rows: int) -> DataFrame:
    """(text, lang) of labelled rows outside the held-out fold, about ``rows`` of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(F.col("doc_id"), modulus) != held))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    place = F.pmod(F.xxhash64("doc_id", F.lit("ppm")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    wanted = F.lit(False)
    for lang, n in sorted(counts.items()):
        wanted = wanted | ((F.col("lang") == lang) & (place < F.lit(rows / n)))
    return known.where(wanted).select("text", "lang")


def byte_counts(sample: DataFrame) -> np.ndarray:
    """How often each folded byte occurs in the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in small_batches(batches):
            for part in text_slices(batch.column(0)):
                total += np.bincount(_FOLD[part.data], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    out = np.zeros(256, dtype=np.int64)
    for byte, n in sample.select("text").mapInArrow(count, "byte long, n long").groupBy("byte").agg(F.sum("n")).collect():
        out[byte] = n
    return out


def symbol_table(counts: np.ndarray, symbols: int) -> np.ndarray:
    """Byte to symbol; the blank is symbol 0, the last symbol stands for all other bytes."""
    order = [32, *(b for b in np.lexsort((np.arange(256), -counts)).tolist() if b != 32)][: symbols - 1]
    table = np.full(256, symbols - 1, dtype=np.int32)
    table[order] = np.arange(len(order))
    return table[_FOLD]


def context_codes(part: Slice, table: np.ndarray, order: int, symbols: int) -> np.ndarray:
    """For every byte the number of (its ``order`` predecessors, itself); blanks stand before a text."""
    now = table[part.data]
    codes = now.astype(np.int32)
    starts = part.bounds[:-1][np.diff(part.bounds) > 0]
    ends = part.bounds[1:][np.diff(part.bounds) > 0]
    weight = 1
    for k in range(1, order + 1):
        weight *= symbols
        before = np.zeros(len(now), dtype=np.int32)
        before[k:] = now[:-k] if k < len(now) else []
        for j in range(k):  # the first k bytes of a text see blanks
            at = starts + j
            before[at[at < ends]] = 0
        codes += before * np.int32(weight)
    return codes


def context_counts(sample: DataFrame, langs: list[str], table: np.ndarray, order: int, symbols: int) -> np.ndarray:
    """Counts of contexts with their symbol, one row per language."""
    place = {lang: k for k, lang in enumerate(langs)}
    size = symbols ** (order + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), size), dtype=np.int32)
        for batch in small_batches(batches):
            own = np.array([place[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for part in text_slices(batch.column(0)):
                codes = context_codes(part, table, order, symbols)
                lang = np.repeat(own[part.first : part.first + part.count], np.diff(part.bounds))
                for k in np.unique(lang):
                    total[k] += np.bincount(codes[lang == k], minlength=size).astype(np.int32)
        for k in range(len(langs)):
            seen = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(seen + k * size), pa.array(total[k, seen].astype(np.int64))], names=["code", "n"])

    summed = sample.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(langs) * size, dtype=np.int64)
    out[summed.code.to_numpy(dtype=np.int64)] = summed.n.to_numpy(dtype=np.int64)
    return out.reshape(len(langs), size)


def code_lengths(counts: np.ndarray, order: int, symbols: int) -> np.ndarray:
    """Bits of every (context, symbol): escapes down to the longest context that knows the symbol.

    A context with n symbols of d kinds codes a known symbol with count c by
    c / (n + d) and the escape by d / (n + d); an unseen context costs nothing.
    """
    bits = np.full(symbols, np.log2(symbols))  # equal shares below the empty context
    for k in range(order + 1):
        seen = counts.reshape(symbols ** (order - k), symbols**k, symbols).sum(axis=0)  # contexts of length k
        n, kinds = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
        shorter = np.tile(bits.reshape(-1, symbols), (symbols if k else 1, 1)).reshape(symbols**k, symbols)
        with np.errstate(divide="ignore", invalid="ignore"):
            here = np.log2(n + kinds) - np.log2(seen)
            escape = np.where(n > 0, np.log2(n + kinds) - np.log2(kinds), 0.0)
        bits = np.where(seen > 0, here, escape + shorter)
    return bits.reshape(-1)


def has_letter(column: pa.Array, part: Slice) -> np.ndarray:
    """Whether each text of a slice has a letter of any script."""
    running = np.concatenate([[0], np.cumsum(_LETTERS[part.data])])
    found = running[part.bounds[1:]] > running[part.bounds[:-1]]
    for t in np.flatnonzero(~found & (np.diff(part.bounds) > 0)).tolist():
        found[t] = any(c.isalpha() for c in column[part.first + t].as_py())
    return found


def identify(docs: DataFrame, modulus: int = 3, held: int = 1, order: int = ORDER, symbols: int = SYMBOLS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, bits_per_byte.

    Trees learn from about ``train_rows`` rows of each language outside the
    held-out fold, whole texts; every whole text is coded by each tree. The
    prediction is the language with the shortest code (ties: the first by
    name); ``score`` is its posterior share under equal priors. Texts that are
    null or without any letter are ``und`` with score 0, as is everything when
    there is nothing to learn from. Rows that repeat are predicted alike, an
    empty table gives no rows, and other columns are not read. The tables are
    broadcast: languages x ``symbols ** (order + 1)`` numbers.
    """
    sample = training_rows(docs, modulus, held, train_rows)
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    table = symbol_table(byte_counts(sample), symbols)
    counts = context_counts(sample, langs, table, order, symbols)
    lengths = np.stack([code_lengths(c, order, symbols) for c in counts], axis=1).astype(np.float32) if langs else np.zeros((1, 0), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(lengths)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in small_batches(batches):
            named, scores, shortest = [], [], []
            for part in text_slices(batch.column(1)):
                total = np.zeros((part.count, len(langs)))
                some = np.flatnonzero(np.diff(part.bounds) > 0)
                if len(some) and langs:
                    codes = context_codes(part, table, order, symbols)
                    total[some] = np.add.reduceat(bits[codes], part.bounds[:-1][some], axis=0, dtype=np.float64)
                known = has_letter(batch.column(1), part) & bool(langs)
                best = total.argmin(axis=1) if langs else np.zeros(part.count, dtype=int)
                least = total.min(axis=1, keepdims=True) if langs else np.zeros((part.count, 1))
                share = 1 / np.exp2(np.maximum(least - total, -1000)).sum(axis=1) if langs else np.zeros(part.count)
                named += [langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                scores += np.where(known, share, 0.0).tolist()
                shortest += (least[:, 0] / np.maximum(np.diff(part.bounds), 1)).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(shortest, pa.float64())],
                names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    kind = dict(docs.dtypes)["doc_id"]
    coded = docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")
    return coded.select("doc_id", (id_remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "lang_pred", "score", "bits_per_byte")
