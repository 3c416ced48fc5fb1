"""Compare a Spark result with DuckDB's over the same tables."""

import math
from pathlib import Path

import duckdb


def tables(con, sf_dir):
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def same(df, sql, sf_dir):
    """Row multisets and column names agree."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    tables(con, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    at = [names.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g == w, (g, w)
