"""Comparison of a query with its SQL on DuckDB."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def views(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def same(df, c, sql: str) -> None:
    r = c.sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    names = sorted(df.columns)
    at = [r.columns.index(n) for n in names]
    got = sorted(tuple(plain(x[n]) for n in names) for x in df.collect())
    want = sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())
    assert got == want
