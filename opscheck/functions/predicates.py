"""Row predicates with the three-valued logic the checks rely on."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unset(df: DataFrame, name: str) -> Column:
    """True where a reference is NULL, an empty text or a numeric zero.

    The test follows the column's type: the text ``'0'`` counts as set, and a
    text is never compared to a number.
    """
    column = F.col(name)
    empty = F.lit("") if df.schema[name].dataType.typeName() == "string" else F.lit(0)
    return column.isNull() | (column == empty)


def null_or_zero(column: Column) -> Column:
    return column.isNull() | (column == 0)


def has_text(column: Column) -> Column:
    """Non-NULL and not made of blanks only (trailing blanks never count)."""
    return F.rtrim(column) != ""


def on_day(column: Column, day: str | datetime.date | Column) -> Column:
    """``column`` falls on ``day``, written as a range so that it reaches the scan."""
    if isinstance(day, Column):
        return (column >= day) & (column < F.date_add(day, 1))
    start = datetime.date.fromisoformat(day) if isinstance(day, str) else day
    after = start + datetime.timedelta(days=1)
    return (column >= F.lit(start)) & (column < F.lit(after))
