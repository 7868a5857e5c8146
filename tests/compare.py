"""Compares a query's rows with those of its SQL in DuckDB, without regard to order."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if v is None or isinstance(v, (int, str, bool)):
        return v
    return str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[k]) for k in order) for r in cur.fetchall())


_KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def difference(df, con, sql: str) -> str:
    """Empty if names, types and rows agree."""
    a, b = rows_of_spark(df), rows_of_sql(con, sql)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    types = dict(df.dtypes)
    theirs = {d[0]: d[1] for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    off = {n: (types[n], theirs[n]) for n in types if _KIND.get(types[n]) and not str(theirs[n]).startswith(_KIND[types[n]])}
    if off:
        return f"types {off}"
    if a[1] != b[1]:
        return f"{sum(a[1].values())} and {sum(b[1].values())} rows; only here {list((a[1] - b[1]).items())[:3]}, only in SQL {list((b[1] - a[1]).items())[:3]}"
    return ""
