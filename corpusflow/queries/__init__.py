"""Queries over the given tables, one per operator, with their oracles."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = ("texts", "sources", "labels", "joins", "aggregates", "windows", "metrics", "overlap", "sampling", "curation", "streams")


def load():
    """Registered queries and SQL, after importing every query module."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
