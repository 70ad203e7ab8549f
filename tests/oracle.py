"""Spark against DuckDB on the same Parquet files."""

from __future__ import annotations

import math
import os

import duckdb

from keytide.session import TABLES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connection(sf: str = SF) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def compare(spark, name: str, query, sql: str, c: duckdb.DuckDBPyConnection, sf: str = SF) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} and {b}"
    return None
