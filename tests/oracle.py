"""Comparing a catalog query with its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, query, sf_dir: str) -> str | None:
    """None if both sides agree, else a short description."""
    df = query.run(spark, sf_dir)
    ours = df.collect()
    if query.sql is None:
        return None
    cur = con.execute(query.sql)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(df.columns, ours), _rows(names, theirs)
    if len(a) != len(b):
        extra = [r for r in a if r not in b][:2] if len(a) < 3000 else []
        lost = [r for r in b if r not in a][:2] if len(b) < 3000 else []
        return f"rows {len(a)} != {len(b)}; ours only {extra}; sql only {lost}"
    for x, y in zip(a, b, strict=True):
        if len(x) != len(y) or any(not _same(p, q) for p, q in zip(x, y, strict=True)):
            return f"row {x} != {y}"
        types = [(p, q) for p, q in zip(x, y, strict=True) if p is not None and q is not None and type(p) is not type(q)]
        if types:
            return f"types differ: {types[:3]}"
    return None


def _same(p, q) -> bool:
    if isinstance(p, float) and isinstance(q, float):
        return abs(p - q) <= 1.01e-6
    return p == q
