"""Rows of a Spark result and of a DuckDB query, in a common form."""

import glob
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order] for _ in [0]), sorted(tuple(plain(r[i]) for i in order) for r in data)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(c, sql):
    r = c.sql(sql)
    return rows(r.columns, r.fetchall())
