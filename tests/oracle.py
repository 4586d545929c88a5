"""Comparison of a Spark result with DuckDB's, order aside."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb

DATA = os.environ.get("LEDGERLENS_TEST_DATA", "/root/testdata/sf0.001")


def connect(folder: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in records)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    got = con.execute(sql)
    return rows([c[0] for c in got.description], got.fetchall())
