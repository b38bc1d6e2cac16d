"""Nearest vectors by mean absolute difference, within groups, without meeting all pairs.

The mean absolute difference of tile sums is a distance of its own and never
above that of the full vectors. Every group chooses pivots among its originals;
distances to them bound all others: ``|d(x, p) - d(y, p)| <= d(x, y)``.

* Originals are dealt into blocks of like pivot distances: by their nearest
  pivot, then by range of the distance to it. A block is known by the least and
  greatest distance to every pivot.
* A query asks the block whose ranges are nearest first. There candidates come
  in the order of their bound until it exceeds the best tile distance found;
  the true distance to that one limits the search.
* All other blocks whose ranges lie beyond the limit are ruled out by a filter
  in the join. Neighbouring blocks stand on shelves; a query goes to a shelf once,
  with the numbers of the blocks that are open to it, not once per block. There
  pivots rule out vectors, tiles the next, and only what is left is compared in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import draw
from ..session import cut

#: Vectors of either side that one task compares, tiles per vector, and pivots per group (one of them all zeros).
BLOCK_ROWS, TILES, PIVOTS = 512, 64, 32
#: Blocks on a shelf, and queries that meet a shelf in one task: with them rows sent fall as one over either.
SHELF_BLOCKS, SHELF_QUERIES = 32, 8192


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def tile_sums(data: pd.Series) -> pd.Series:
    """Sums of at most ``TILES`` equal runs of a vector, divided by its length."""

    def sums(values) -> list[float]:
        numbers = np.asarray(values, dtype="float64")
        tiles = min(TILES, len(numbers))
        return (np.add.reduceat(numbers, np.arange(tiles) * len(numbers) // tiles) / len(numbers)).tolist() if tiles else []

    return data.map(sums)


def _gaps(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.abs(left - right).sum(axis=-1)


def _cogrouped(left: DataFrame, right: DataFrame, keys: list[str], fn, schema) -> DataFrame:
    """``fn`` over the rows of both sides with equal keys; both sides may come from one frame."""
    other = {k: f"_right_{i}" for i, k in enumerate(keys)}
    return left.groupBy(*keys).cogroup(right.withColumnsRenamed(other).groupBy(*other.values())).applyInPandas(fn, schema)


def _blocks_of(df: DataFrame, by: list[str]) -> DataFrame:
    """How many blocks the rows of a group fill."""
    return df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("long").alias("_blocks"))


def _pivots(originals: DataFrame, by: list[str]) -> DataFrame:
    """(by, _pivots): tile sums of some originals of each group, drawn by their ids."""
    sizes = originals.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    drawn = draw("pivot", F.col("_oid")) / F.lit(float(1 << 60))
    some = originals.join(sizes, by).where(drawn < F.lit(4.0 * PIVOTS) / F.col("_n"))  # about 4 x PIVOTS rows per group
    listed = F.sort_array(F.collect_list(F.struct(drawn.alias("at"), "_tiles")))
    return some.groupBy(*by).agg(F.slice(listed, 1, PIVOTS - 1).alias("_own")).select(*by, F.col("_own._tiles").alias("_pivots"))


def _with_pivot_distances(df: DataFrame, id_col: str, pivots: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with ``_to``: distances to zero and to the group's pivots. A group's rows are dealt over as many tasks as they fill."""
    dealt = df.join(_blocks_of(df, by), by).withColumn("_deal", F.pmod(draw("deal", F.col(id_col)), F.col("_blocks")))
    tasks = dealt.select(*by, "_deal").distinct().join(pivots, by)

    def measure(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if len(rows):
            own = np.stack(rows["_tiles"].to_numpy())
            points = np.concatenate([np.zeros((1, own.shape[1])), *(np.stack(list(p)) for p in known["_pivots"] if len(p))])
            rows["_to"] = list(np.stack([_gaps(own, p) for p in points], axis=1))
        return rows.reindex(columns=names)

    schema = T.StructType([*df.schema.fields, T.StructField("_to", T.ArrayType(T.DoubleType()))])
    names = schema.fieldNames()
    return _cogrouped(dealt.drop("_blocks"), tasks, [*by, "_deal"], measure, schema)


def _in_blocks(originals: DataFrame, by: list[str]) -> DataFrame:
    """``originals`` with ``_block``: by nearest pivot, by range of the distance to it, and dealt on where a range is too full.

    As many pivots name cells as the group fills blocks, so a small group is one block.
    """
    sized = originals.join(_blocks_of(originals, by), by)
    near = F.slice("_to", F.lit(1), F.least(F.col("_blocks"), F.size("_to")).cast("int"))
    placed = sized.withColumn("_away", F.array_min(near)).withColumn("_cell", F.array_position("_to", F.col("_away"))).drop("_blocks")
    spans = placed.groupBy(*by, "_cell").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("_parts"), F.min("_away").alias("_low"), F.max("_away").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / F.col("_parts")
    ring = F.when(width > 0, F.least(F.floor((F.col("_away") - F.col("_low")) / width), F.col("_parts") - 1)).otherwise(F.lit(0))
    ringed = placed.join(spans, [*by, "_cell"]).withColumn("_ring", ring.cast("long")).drop("_parts", "_low", "_high")
    fills = ringed.groupBy(*by, "_cell", "_ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("long").alias("_fill"))
    part = F.pmod(draw("part", F.col("_oid")), F.col("_fill"))
    named = F.concat_ws(":", F.col("_cell").cast("string"), F.col("_ring").cast("string"), part.cast("string"))
    return ringed.join(fills, [*by, "_cell", "_ring"]).withColumn("_block", named).drop("_cell", "_ring", "_away", "_fill")


def _ranges(blocked: DataFrame, by: list[str]) -> DataFrame:
    """(by, _block, _low, _high): least and greatest distance of a block to every pivot; a row per block."""
    at = blocked.select(*by, "_block", F.posexplode("_to").alias("_k", "_d"))
    per = at.groupBy(*by, "_block", "_k").agg(F.min("_d").alias("_l"), F.max("_d").alias("_h"))
    listed = F.sort_array(F.collect_list(F.struct("_k", "_l", "_h")))  # a struct per pivot
    return per.groupBy(*by, "_block").agg(listed.alias("_r")).select(*by, "_block", F.col("_r._l").alias("_low"), F.col("_r._h").alias("_high"))


def _beyond(low: str | Column = "_low", high: str | Column = "_high") -> Column:
    """How far outside a block's ranges a query lies at least."""
    under = F.zip_with(low, "_to", lambda edge, to: edge - to)
    over = F.zip_with("_to", high, lambda to, edge: to - edge)
    return F.greatest(F.array_max(under), F.array_max(over), F.lit(0.0))


def _off_centre() -> Column:
    """How far a query lies from the middle of a block's ranges."""
    middle = F.zip_with("_low", "_high", lambda low, high: (low + high) / 2)
    return F.array_max(F.zip_with(middle, "_to", lambda m, to: F.abs(m - to)))


def _shelved(ranges: DataFrame, by: list[str]) -> DataFrame:
    """``ranges`` with ``_shelf``, and with ``_at``, the block's number on it; neighbours by name stand together."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*(F.element_at(F.split("_block", ":"), k).cast("long") for k in (1, 2, 3)))) - 1  # a row per block
    return ranges.withColumn("_shelf", F.floor(place / SHELF_BLOCKS)).withColumn("_at", (place % SHELF_BLOCKS).cast("int"))


def _open_shelves(queries: DataFrame, shelved: DataFrame, by: list[str]) -> DataFrame:
    """Queries once per shelf that has blocks open to them, with ``_open``, the numbers of those blocks."""
    shelves = shelved.groupBy(*by, "_shelf").agg(F.collect_list(F.struct("_at", "_low", "_high")).alias("_ranges"))
    near = F.filter("_ranges", lambda r: _beyond(r["_low"], r["_high"]) <= F.col("_limit"))
    return queries.join(shelves, by).withColumn("_open", F.transform(near, lambda r: r["_at"])).drop("_ranges").where(F.size("_open") > 0)


def _asked(queries: DataFrame, blocked: DataFrame, by: list[str]) -> DataFrame:
    """(_did, _oid, _seen): the original of the least tile distance in a query's block; a row without ``_oid`` counts its tile comparisons."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            tiles, to, names = np.stack(right["_tiles"].to_numpy()), np.stack(right["_to"].to_numpy()), right["_oid"].to_numpy()
            for did, own, mine in zip(left["_did"], left["_tiles"], left["_to"], strict=True):
                bound = np.abs(to - np.asarray(mine)).max(axis=1)
                best, found, seen = np.inf, -1, 0
                for k in np.argsort(bound, kind="stable").tolist():
                    if bound[k] > best:
                        break
                    distance = _gaps(tiles[k], np.asarray(own))
                    seen += 1
                    if distance < best:
                        best, found = distance, k
                out += [(did, names[found], 0)] * (found >= 0) + [(did, None, seen)]
        return _found(out)

    return _met(queries, blocked, [*by, "_block"], BLOCK_ROWS, compare)


def _within(queries: DataFrame, blocked: DataFrame, by: list[str]) -> DataFrame:
    """(_did, _oid, _seen): all originals of a query's open blocks within its limit by tiles; a row without ``_oid`` counts its tile comparisons."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            right = right.sort_values("_at", kind="stable")
            tiles, to, names = np.stack(right["_tiles"].to_numpy()), np.stack(right["_to"].to_numpy()), right["_oid"].to_numpy()
            edges = np.searchsorted(right["_at"].to_numpy(), np.arange(SHELF_BLOCKS + 1)).tolist()
            for did, own, mine, limit, open_ in zip(left["_did"], left["_tiles"], left["_to"], left["_limit"], left["_open"], strict=True):
                own, mine, seen = np.asarray(own), np.asarray(mine), 0
                for at in open_:
                    i, j = edges[at], edges[at + 1]
                    near = np.flatnonzero(np.abs(to[i:j] - mine).max(axis=1) <= limit) + i
                    distance = _gaps(tiles[near], own)
                    out += [(did, names[k], 0) for k in near[distance <= limit].tolist()]
                    seen += len(near)
                out.append((did, None, seen))
        return _found(out)

    return _met(queries, blocked, [*by, "_shelf"], SHELF_QUERIES, compare)


def _found(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["_did", "_oid", "_seen"]).astype({"_seen": "int64"})


def _met(queries: DataFrame, held: DataFrame, keys: list[str], most: int, compare) -> DataFrame:
    """``compare`` over queries, ``most`` at a time, and all originals of the same keys."""
    fills = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("_deals"))
    dealt = queries.join(fills, keys).withColumn("_deal", F.pmod(draw("ask", F.col("_did")), F.col("_deals"))).drop("_deals")
    copies = held.join(fills, keys).withColumn("_deal", F.explode(F.expr("sequence(0L, _deals - 1)"))).drop("_deals")
    return _cogrouped(dealt, copies, [*keys, "_deal"], compare, "_did string, _oid string, _seen long")


def nearest(derived: DataFrame, original: DataFrame, by: list[str]) -> DataFrame:
    """(_did, _distance, _nearest, _max_abs, _seen) per derived row that has originals in its group.

    ``derived`` holds the columns of ``by``, ``_did`` and ``_ddata``, ``original``
    those of ``by``, ``_oid`` and ``_odata``; vectors of a group have one length.
    Distances are rounded to nine places; of equal ones the least ``_oid``
    counts. ``_seen`` is the number of tile comparisons spent on the row.
    """
    slack = 2e-9  # for that rounding
    o = cut(original.select(*by, "_oid", tile_sums("_odata").alias("_tiles")))
    pivots = _pivots(o, by)
    d = cut(_with_pivot_distances(derived.select(*by, "_did", tile_sums("_ddata").alias("_tiles")), "_did", pivots, by))
    blocked = cut(_in_blocks(_with_pivot_distances(o, "_oid", pivots, by), by))
    ranges = cut(_ranges(blocked, by))  # a row per block
    gaps = F.zip_with(F.col("_ddata"), F.col("_odata"), lambda x, y: F.abs(x.cast("double") - y.cast("double")))

    def measured(pairs: DataFrame) -> DataFrame:
        met = pairs.join(derived.select("_did", "_ddata"), "_did").join(original.select("_oid", "_odata"), "_oid")
        mean = F.round(F.aggregate("_gaps", F.lit(0.0), lambda total, x: total + x) / F.size("_gaps"), 9)
        return met.select("_did", "_oid", gaps.alias("_gaps")).select("_did", "_oid", mean.alias("_distance"), F.array_max("_gaps").alias("_max_abs"))

    one = d.join(ranges, by).groupBy("_did").agg(F.min_by("_block", F.struct(_beyond().alias("away"), _off_centre().alias("off"), "_block")).alias("_block"))
    guess = cut(_asked(d.join(one, "_did"), blocked.select(*by, "_block", "_oid", "_tiles", "_to"), by))
    first = cut(measured(guess.where("_oid IS NOT NULL").select("_did", "_oid")))  # one pair per row
    limits = d.join(first.select("_did", (F.col("_distance") + slack).alias("_limit")), "_did")
    shelved = cut(_shelved(ranges, by))
    placed = blocked.join(shelved.select(*by, "_block", "_shelf", "_at"), [*by, "_block"]).select(*by, "_shelf", "_at", "_oid", "_tiles", "_to")
    rest = cut(_within(_open_shelves(limits, shelved, by), placed, by))
    more = rest.where("_oid IS NOT NULL").join(first.select("_did", "_oid"), ["_did", "_oid"], "left_anti").select("_did", "_oid")
    best = F.min(F.struct("_distance", F.col("_oid").alias("_nearest"), "_max_abs")).alias("_b")
    found = first.unionByName(measured(more)).groupBy("_did").agg(best).select("_did", "_b.*")
    return found.join(guess.unionByName(rest).groupBy("_did").agg(F.sum("_seen").alias("_seen")), "_did")
