"""Text forms of rows and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(column: Column) -> Column:
    """Trimmed text; NULL becomes the empty text so that positions are kept."""
    return F.trim(F.coalesce(column.cast("string"), F.lit("")))


def delimited(fields: list[str], delimiter: str) -> Column:
    """Join fields, given as SQL expressions, trimmed and with NULL as the empty text; positions are kept."""
    cleaned = ", ".join(f"trim(coalesce(CAST({f} AS STRING), ''))" for f in fields)
    return F.expr(f"concat_ws('{delimiter}', {cleaned})")


def quoted(column: Column) -> Column:
    """SQL string literal with embedded quotes doubled."""
    return F.concat(F.lit("'"), F.replace(column.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))


def shown(column: Column) -> Column:
    """Value as display text; NULL is shown as ``None``."""
    return F.coalesce(column.cast("string"), F.lit("None"))


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All fields of a row as one line."""
    return F.concat_ws(" | ", *[shown(F.col(c)) for c in (columns or df.columns)])


def padded(column: Column, width: int) -> Column:
    """Left-aligned, at least ``width`` wide, never truncated."""
    text = shown(column)
    return F.rpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def field_lines(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One ``field: value`` row per field, for a record card."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value"),
                 F.concat(F.lit(f + ": "), shown(F.col(f))).alias("line"))
        for i, f in enumerate(fields)
    ])
    return df.select(*key, F.inline(pairs))


def json_detail(columns: list[str]) -> Column:
    """Row as JSON with NULL fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
