"""Compare registered queries with their SQL on a folder of tables."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str, tables: list[str] = TABLES) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9) if math.isfinite(value) else str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, con) -> str:
    """What tells a query's rows from its SQL's; empty when nothing does."""
    ours = rows_of(df.columns, df.collect())
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    theirs = rows_of(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if ours != theirs:
        a, b = [r for r in ours if r not in set(theirs)], [r for r in theirs if r not in set(ours)]
        return f"{len(ours)} rows against {len(theirs)}; only ours {a[:3]}; only SQL's {b[:3]}"
    return ""
