"""Positions in a global order, without a task that holds the whole order.

Rows are dealt to range partitions of the order and sorted there.  A row's position is its place
in its partition plus the number of rows in the partitions before it.  Only one count per partition
comes to the driver; no window runs over rows, so one task never sorts more than one range.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opscheck.operators.keyed import probe
from opscheck.session import stored

_PLACE, _SALT = "_place", "_salt"
_PART_BITS = 33  # monotonically_increasing_id() is the partition shifted by as many bits, plus the place in it


def ranges(df: DataFrame, order: Sequence[Column], n: int | None = None) -> DataFrame:
    """``df`` in ``n`` sorted range partitions (default: the session's number of shuffle partitions).

    Spark samples the input for the range bounds, so ``df`` should be a scan or a stored result.
    Rows that are equal in all of ``order`` meet in one partition.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position", spread: bool = False) -> DataFrame:
    """``df`` with the 0-based position of every row in ``order``; rows equal in ``order`` get any of their positions.

    The sorted rows are stored once, since positions read from two runs of the same sort could differ.
    ``spread`` stores ``df`` first with a salt that is last in the order: then any number of equal rows spreads over
    several ranges, and a costly ``df`` is computed once.
    """
    if spread:
        df = stored(df.withColumn(_SALT, F.xxhash64(F.monotonically_increasing_id())))
        return numbered(df, [*order, F.col(_SALT)], name).drop(_SALT)
    placed = stored(ranges(df, order).withColumn(_PLACE, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(_PLACE), _PART_BITS)
    counts = dict(placed.groupBy(part).count().collect())  # a number per partition
    starts = [0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=0)))]
    start = F.element_at(F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>"), part.cast("int") + 1)
    within = F.col(_PLACE) - F.shiftleft(part, _PART_BITS)
    return placed.withColumn(name, start + within).drop(_PLACE)


def numbered_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "position",
                    size: str | None = None, spread: bool = False) -> DataFrame:
    """``df`` with the 0-based position of every row in its group, and the group's ``size`` if named.

    NULL is a group of its own.  A group of any size is spread over as many ranges as it fills.
    """
    placed = numbered(df, [*[F.asc_nulls_first(g) for g in groups], *order], "_global", spread)
    firsts = placed.groupBy(*groups).agg(F.min("_global").alias("_first"), F.count("*").alias("_size"))
    joined = probe(placed, firsts, groups, null_safe=True)
    joined = joined.withColumn(name, F.col("_global") - F.col("_first"))
    return (joined.withColumn(size, F.col("_size")) if size else joined).drop("_global", "_first", "_size")
