"""Runs queries in Spark and their SQL in DuckDB on the same tables, and tells where they differ."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, int):
        return float(x)
    return str(x)


def differences(spark, con, query, sql: str, sf: str) -> list:
    got = query(spark, sf)
    want = con.sql(sql)
    if sorted(got.columns) != sorted(want.columns):
        return ["columns", sorted(got.columns), sorted(want.columns)]
    order = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in order]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    if a == b:
        return []
    in_a, in_b = set(a), set(b)
    return [f"{len(a)} rows, {len(b)} in SQL", [r for r in a if r not in in_b][:3], [r for r in b if r not in in_a][:3]]
