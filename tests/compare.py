"""Runs a query and its SQL on the same tables and compares rows as sets of text."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return "null" if value is None else str(value)


def differing(df, con, sql):
    """Rows of one side only, with the column names of both."""
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[k]) for k in at) for r in done.fetchall())
    return [(a, b) for a, b in zip(got, want, strict=True) if a != b] if len(got) == len(want) else [(len(got), len(want))]
