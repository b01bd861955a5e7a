"""Runs a query and its SQL side by side: rows, column names, kinds of type, and values in any order."""

from __future__ import annotations

import math
import os

import duckdb


def connection(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in sorted(os.listdir(d)):
        name = f.split(".")[0]
        path = os.path.join(d, f)
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}" if not float(v).is_integer() else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(cell(x)) for x in v) + "]"
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(cell(r[i])) for i in order) for r in rows)


def compare(spark, d, query, sql) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, d)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connection(d).execute(sql)
    want = table_of([x[0] for x in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
