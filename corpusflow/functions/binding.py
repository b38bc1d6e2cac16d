"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct with the named values, each computed once.

    A lambda body is evaluated per element, so a costly expression written
    inside it would be recomputed for each one; bound here, it is not.
    """
    bound = F.struct(*[c.alias(k) for k, c in values.items()])
    return F.get(F.transform(F.array(bound), body), F.lit(0))
