"""Compare a query's rows with DuckDB's answer to its SQL."""

from __future__ import annotations

import glob
import math
import os
from datetime import date, datetime

import duckdb


def database(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (datetime, date)):
        return str(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(frame, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    got_names = frame.columns
    got = _rows(got_names, [tuple(r) for r in frame.collect()])
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = _rows(want_names, cur.fetchall())
    if sorted(got_names) != sorted(want_names):
        return f"columns: {sorted(set(got_names) ^ set(want_names))}"
    if len(got) != len(want):
        return f"rows: {len(got)} against {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ; {sorted(got_names)}: {wrong[0]}"
    return None
