"""Table functions over texts for a tokenizer that the user supplies.

Expansion by built-in rules needs no Python (``posexplode`` over arrays). A
supplied tokenizer does; here it is a table function, so SQL can call it in a
lateral join and the engine keeps the columns it stands beside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Tokenizer = Callable[[str], list[str]]
GRAMS = "n int, pos bigint, gram string"
#: Grams that a task holds before it sends them on.
HELD_GRAMS = 1 << 15


def grams_of(tokens: list[str], orders: tuple[int, ...], joint: str) -> Iterator[tuple[int, int, str]]:
    """(n, position, gram) of every run of ``n`` tokens, shorter runs first."""
    for n in orders:
        for k in range(len(tokens) - n + 1):
            yield n, k, joint.join(tokens[k : k + n])


def gram_table(make: Callable[[], Tokenizer], orders: tuple[int, ...] = (1,), joint: str = " "):
    """A table function of one text: ``(n, pos, gram)``. ``make`` builds the tokenizer once per task; a null text has no rows."""

    class Grams:
        def __init__(self) -> None:
            self.tokenize = make()

        def eval(self, text: str):
            if text is not None:
                yield from grams_of(self.tokenize(text), orders, joint)

    return F.udtf(Grams, returnType=GRAMS, useArrow=True)


def register_gram_table(spark: SparkSession, name: str, make: Callable[[], Tokenizer], orders: tuple[int, ...] = (1,), joint: str = " ") -> None:
    """Make ``name(text)`` callable from SQL, as in ``FROM t, LATERAL name(t.text)``."""
    spark.udtf.register(name, gram_table(make, orders, joint))


def gram_tables(batch: pa.RecordBatch, text: str, keep: list[str], tokenize: Tokenizer, orders: tuple[int, ...], joint: str) -> Iterator[pa.Table]:
    """The rows of a batch's grams, in tables of at most ``HELD_GRAMS``."""

    def table(found: list[tuple[int, int, int, str]]) -> pa.Table:
        rows, n, pos, gram = zip(*found, strict=True) if found else ((), (), (), ())
        kept = {c: batch.column(batch.schema.get_field_index(c)).take(pa.array(rows, pa.int64())) for c in keep}
        return pa.table(kept | {"n": pa.array(n, pa.int32()), "pos": pa.array(pos, pa.int64()), "gram": pa.array(gram, pa.string())})

    found: list[tuple[int, int, int, str]] = []
    for row, t in enumerate(batch.column(batch.schema.get_field_index(text))):
        if not t.is_valid:
            continue
        for gram in grams_of(tokenize(t.as_py()), orders, joint):
            found.append((row, *gram))
            if len(found) == HELD_GRAMS:
                yield table(found)
                found = []
    yield table(found)


def gram_rows(df: DataFrame, text: str, keep: list[str], make: Callable[[], Tokenizer], orders: tuple[int, ...] = (1,), joint: str = " ") -> DataFrame:
    """The columns of ``keep`` with ``n``, ``pos`` and ``gram``: the same rows, read by Arrow batches and sent on in tables of bounded size."""
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, *T.StructType.fromDDL(GRAMS).fields])

    @F.arrow_udtf(returnType=schema)
    class GramBatches:
        def __init__(self) -> None:
            self.tokenize = make()

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            yield from gram_tables(batch, text, keep, self.tokenize, orders, joint)

    return GramBatches(df.select(*keep, *([] if text in keep else [text])).asTable())
