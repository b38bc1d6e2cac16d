"""Connected components of a graph given as rows, by alternating star steps.

Neighbours are replaced by the least neighbour until every vertex points at the
least vertex of its component. Both steps are a map-side combined minimum and a
join; no vertex's neighbours are gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

FILE_ROWS = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a vertex are tied to the least of it and its neighbours."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a vertex, and itself, are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for every vertex of ``links``: the root is the least vertex of the component.

    Links may repeat, in either direction; a link with a null end or of a
    vertex to itself is left out, and such a vertex is not listed for it.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while True:
        # The steps' rows are few and short: as many files as they need, not one per shuffle partition.
        files = max(1, math.ceil(state[0] / FILE_ROWS))
        edges = cut(_small_star(_large_star(edges)).coalesce(files))
        last, state = state, _state(edges)
        if state == last:
            break
    roots = edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return roots.unionAll(edges.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
