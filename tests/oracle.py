"""Compare a registered query with its SQL on the same tables, value by value."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if hasattr(v, "is_finite"):
        return _cell(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def _kind(v) -> str:
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return "float" if hasattr(v, "is_finite") else type(v).__name__


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else what differs."""
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in res.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for i, c in enumerate(cols):
        a, b = ({_kind(r[i]) for r in rows if r[i] is not None} for rows in (got, want))
        if a and b and a != b:
            return f"column {c}: types {a} != {b}"
    x, y = (sorted([tuple(map(_cell, r)) for r in rows]) for rows in (got, want))
    if x != y:
        diff = [(p, q) for p, q in zip(x, y) if p != q]
        return f"{len(diff)} rows differ, first {cols}: {diff[0]}"
    return None
