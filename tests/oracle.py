"""Comparison of a query's rows with its SQL in DuckDB on the same tables."""

from __future__ import annotations

import math
from datetime import datetime
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df) -> list[tuple]:
    return rows_of(df.columns, df.collect())


def sql_rows(con, sql: str) -> list[tuple]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return rows_of(names, got.fetchall())


def same(a: list[tuple], b: list[tuple]) -> bool:
    """Equal rows; numbers may differ by the rounding of the sixth digit."""
    close = lambda x, y: x == y or (isinstance(x, int | float) and isinstance(y, int | float) and abs(x - y) <= 2e-6 * max(1.0, abs(x)))
    return len(a) == len(b) and all(len(r) == len(s) and all(map(close, r, s)) for r, s in zip(a, b, strict=True))
