"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def connect(d):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(glob.glob(f"{d}/*.parquet")):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def compare(df, sql, d):
    """Asserts that both give the same columns and rows; returns the number of rows."""
    got = rows(df.columns, df.collect())
    rel = connect(d).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want):
        assert a == b, (a, b)
    return len(got)
