"""View detection and view cascades over image names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import base_name

# Caption patterns, with Unicode word boundaries.
FRONTAL_WORDS = r"(?iU)\b(pa|ap|p\.a\.|a\.p\.|frontal|postero-?anterior|antero-?posterior)\b"
LATERAL_WORDS = r"(?iU)\b(lateral|lat|decubitus|oblique)\b"
TWO_VIEWS_WORDS = r"(?iU)\b(2|two|ii)\s*-?\s*(v|view|views)\b"
VIEWS = ("frontal", "lateral")


def caption_views(c: Column) -> Column:
    """``struct(frontal, lateral)`` of nullable flags; null means unknown."""
    frontal, lateral = c.rlike(FRONTAL_WORDS), c.rlike(LATERAL_WORDS)
    two = c.rlike(TWO_VIEWS_WORDS)

    def flag(own: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) == "", None).when(two, True).when(frontal | lateral, own)

    return F.struct(flag(frontal).alias("frontal"), flag(lateral).alias("lateral"))


def _hits(path: Column) -> list[Column]:
    name = F.lower(base_name(path))
    return [F.contains(name, F.lit(v)) for v in VIEWS]


def view_of(path: Column) -> Column:
    """The one view word in the base name, else null."""
    f, l = _hits(path)
    return F.when(f & ~l, "frontal").when(l & ~f, "lateral")


def view_reason(path: Column) -> Column:
    """Why ``view_of`` is null: none or ambiguous."""
    f, l = _hits(path)
    return F.when(f & l, "ambiguous").when(~f & ~l, "none")


def _count(paths: Column, view: str | None) -> Column:
    if view is None:
        return F.size(F.filter(paths, lambda p: view_of(p).isNull()))
    return F.size(F.filter(paths, lambda p: view_of(p) == view))


def classify_views(paths: Column) -> Column:
    """``struct(status, n_frontal, n_lateral, n_unknown)`` of an image list."""
    n_f, n_l, n_u = (_count(paths, v) for v in ("frontal", "lateral", None))
    status = (
        F.when(n_u > 0, "UNCLASSIFIED")
        .when((n_f == 1) & (n_l == 1), "OK")
        .when(F.size(paths) != 2, "WRONG_COUNT")
        .when((n_f == 2) | (n_l == 2), "SAME_VIEW")
        .when(n_f == 0, "MISSING_FRONTAL")
        .when(n_l == 0, "MISSING_LATERAL")
        .otherwise("DUPLICATE_VIEW")
    )
    return F.struct(
        status.alias("status"), n_f.alias("n_frontal"), n_l.alias("n_lateral"), n_u.alias("n_unknown")
    )


def classify_pair(files: Column) -> Column:
    """Pair type of an image list; a null list is a missing folder."""
    return pair_type(F.when(files.isNotNull(), F.size(files)), _count(files, "frontal"), _count(files, "lateral"))


def pair_type(n_files: Column, n_f: Column, n_l: Column) -> Column:
    """Pair type by the number of files and of frontal and lateral ones; a null number is a missing folder."""
    return (
        F.when(n_files.isNull(), "DIR_MISSING")
        .when(n_files != 2, "OTHER")
        .when(n_f == 2, "FRONTAL_PAIR")
        .when(n_l == 2, "LATERAL_PAIR")
        .when((n_f == 1) & (n_l == 1), "MIXED_PAIR")
        .otherwise("OTHER")
    )


def select_images(paths: Column, mode: str) -> Column:
    """``struct(names, views)`` of the images a dataset version uses."""
    named = F.array_sort(F.transform(paths, lambda p: F.struct(base_name(p).alias("name"), p.alias("path"))))
    if mode == "frontal":
        kept = F.slice(F.filter(named, lambda x: view_of(x.path) == "frontal"), 1, 1)
    elif mode == "frontal_lateral":
        kept = named
    else:
        raise ValueError(f"unknown view mode {mode!r}")
    return F.struct(
        F.transform(kept, lambda x: x["name"]).alias("names"),
        F.transform(kept, lambda x: F.coalesce(view_of(x.path), F.lit("unknown"))).alias("views"),
    )


def order_pair(paths: Column) -> Column:
    """``struct(paths, state)`` with the frontal image first where it can be."""
    frontal = F.filter(paths, lambda p: view_of(p) == "frontal")
    lateral = F.filter(paths, lambda p: view_of(p) == "lateral")
    orderable = (F.size(paths) == 2) & (F.size(frontal) == 1) & (F.size(lateral) == 1)
    ordered = F.concat(frontal, lateral)
    return F.struct(
        F.when(orderable, ordered).otherwise(paths).alias("paths"),
        F.when(~orderable, "NOT_ORDERABLE")
        .when(ordered == paths, "ALREADY_OK")
        .otherwise("REORDERED")
        .alias("state"),
    )
