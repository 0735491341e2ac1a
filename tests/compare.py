"""Run a registered query and its SQL side by side and compare names, row counts and values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return repr(v)


def difference(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = [names.index(c) for c in df.columns]
    want = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    got = [tuple(r) for r in df.collect()]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    a = sorted(tuple(_cell(v) for v in r) for r in got)
    b = sorted(tuple(_cell(v) for v in r) for r in want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[0][0]} against {bad[0][1]}" if bad else None
