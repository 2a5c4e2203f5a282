"""Order-insensitive comparison of a Spark result with the result of its SQL counterpart."""

from __future__ import annotations

import datetime
import glob
import os
from collections import Counter

import duckdb

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime) and value.time() == datetime.time(0):
        return value.date()
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = bag(names, cursor.fetchall())
    actual = bag(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if expected == actual:
        return None
    return (f"{sum(actual.values())} rows, expected {sum(expected.values())}; "
            f"extra {list((actual - expected))[:2]}, missing {list((expected - actual))[:2]}")
