"""Compares a query with its SQL in DuckDB."""

import os

import duckdb
import numpy as np

FOLDER = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, list | tuple | np.ndarray):
        return str([norm(x) for x in v])
    if v is None or v != v:
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def compare(spark, query, sql):
    df = query(spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in os.listdir(FOLDER):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{FOLDER}/{t}'")
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want
