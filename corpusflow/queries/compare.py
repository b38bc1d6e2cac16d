"""Order-free comparison of a query's rows with its oracle's."""

from __future__ import annotations

import math

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def plain(value):
    """A value both engines write alike: numbers rounded, lists as tuples."""
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float) and math.isnan(value):
        return None
    try:
        return round(float(value), 5) + 0.0
    except (TypeError, ValueError):
        return str(value)


def _key(row: tuple) -> tuple:
    return tuple((v is None, isinstance(v, str), v if isinstance(v, (int, float)) else str(v)) for v in row)


def canonical(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=_key)


def connect(folder: str):
    """A DuckDB connection with the given tables as views."""
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def oracle_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    rows = cursor.fetchall()
    return canonical([d[0] for d in cursor.description], rows)
