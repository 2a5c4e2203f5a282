"""Tiny role tables for edge cases."""

from __future__ import annotations

import datetime

from opscheck.roles import SCHEMAS


def make(spark, role: str, *rows, columns: str | None = None):
    """Rows of a role table; ``columns`` picks a subset of its columns."""
    schema = SCHEMAS[role]
    if columns:
        types = dict(part.split(" ") for part in schema.split(", "))
        schema = ", ".join(f"{c} {types[c]}" for c in columns.split())
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def keys(spark, column: str, *values, type_: str = "STRING"):
    return spark.createDataFrame([(v,) for v in values], f"{column} {type_}")


def rows(df, *columns):
    """Sorted tuples of the chosen columns."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


def at(text: str) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text)
