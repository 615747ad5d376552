"""Side-by-side comparison of a registered query and its SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _kind(v):
    if v is None:
        return "null"
    return type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=repr
    )


def compare(spark, con, name, fn, sql, sf_dir, allow_empty=False):
    """None when equal, else a short text on the first difference."""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = rows_of(cols, cur.fetchall())
    if got_cols != want_cols:
        return f"{name}: columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{name}: rows {len(got)} != {len(want)}"
    if not got:
        return None if allow_empty else f"{name}: no rows on both sides"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{name}: {len(bad)} of {len(got)} rows differ, first {bad[0]}"
    kinds = [tuple(_kind(x) for x in g) for g in got[:200]]
    wkinds = [tuple(_kind(x) for x in w) for w in want[:200]]
    if kinds != wkinds:
        pair = next((k, w) for k, w in zip(kinds, wkinds) if k != w)
        return f"{name}: value kinds differ {got_cols} {pair}"
    return None
