"""Rows of a query against DuckDB's, as multisets."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)


def sql_rows(con, sql: str, columns: list[str]) -> list[tuple]:
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
