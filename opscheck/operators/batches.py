"""Bounded batches of ids, for texts that list ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.functions.text import quoted
from opscheck.operators.keyed import complete
from opscheck.operators.ranking import numbered, numbered_within


def batched(df: DataFrame, key: str, size: int, by: Sequence[str] = ()) -> DataFrame:
    """The distinct keys with their ``batch`` (from 0): every ``size`` keys in key order, of each ``by`` on its own.

    The positions come from sorted ranges, so neither a count beforehand nor a task with all keys is needed.
    """
    keys = complete(df.select(*by, key), key).distinct()
    order = [F.col(key)]
    placed = numbered_within(keys, by, order, "_position") if by else numbered(keys, order, "_position")
    return placed.withColumn("batch", F.floor(F.col("_position") / size)).drop("_position")


def id_lists(df: DataFrame, key: str, size: int, separator: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per batch: number of ids, and their quoted literals in key order."""
    listed = (batched(df, key, size, by)
              .groupBy(*by, "batch")
              .agg(F.count("*").alias("n_ids"), F.sort_array(F.collect_list(key)).alias("ids")))
    literals = F.transform("ids", lambda i: quoted(i))
    return listed.select(*by, "batch", "n_ids", F.array_join(literals, separator).alias("literals"))


def in_clause(df: DataFrame, column: str, size: int = 1000) -> DataFrame:
    """SQL ``IN`` lists over the distinct non-NULL values of a column, at most ``size`` values each."""
    return id_lists(df, column, size, ", ").select(
        "batch", "n_ids", F.concat(F.lit("("), "literals", F.lit(")")).alias("clause"))
