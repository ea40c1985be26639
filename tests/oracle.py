"""Runs a query and its SQL side by side and compares their rows."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb


def connected(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """An empty string if the rows are equal."""
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    q = con.execute(sql)
    names = [x[0] for x in q.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in q.fetchall())
    if ours != theirs:
        first = next(((a, b) for a, b in zip(ours, theirs, strict=False) if a != b), None)
        return f"{len(ours)} and {len(theirs)} rows; first difference {first}"
    return ""
