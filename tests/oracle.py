"""Spark results held against DuckDB on the same Parquet files."""

import datetime as dt
import math
import os

import duckdb


def connect(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for name in os.listdir(sf):
        if name.endswith(".parquet"):
            c.execute(f"create view {name[:-8]} as select * from '{sf}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(spark, sf, query, sql):
    got = query(spark, sf)
    left = rows(got.columns, [tuple(r) for r in got.collect()])
    cursor = connect(sf).execute(sql)
    right = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert left[0] == right[0]
    assert len(left[1]) == len(right[1])
    assert left[1] == right[1]
    return len(left[1])
