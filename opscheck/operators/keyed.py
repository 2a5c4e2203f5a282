"""Joins and picks by key that stay balanced when one key holds much of a table.

The probe (left) side of a check is often skewed: one delivery, one location or
the NULL key may hold a third of all rows.  Three rules keep every task small:

* the looked-up side is reduced to its distinct keys (or one row per key) before
  it is joined, so its own hot keys collapse in the map-side aggregate;
* the join is made on the key plus a routing column.  For a complete key the
  routing column is a function of the key; for a key with a NULL part, which
  can never match, it is a hash of the other columns, so such rows spread out;
* both inputs of the join come straight from a shuffle (the routing column rules
  out reuse of the aggregate's own partitioning).  That is the shape in which
  adaptive execution can split a hot partition, or switch to a broadcast once
  the measured size of the looked-up side is below the session's threshold.

No broadcast is forced anywhere; size checks are left to adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROUTES = 4096  # a power of two
_ROUTE = "_route"
_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
_ROUTABLE = _INTEGRAL | {"string", "binary", "boolean", "date", "timestamp", "timestamp_ntz"}
#: Collations and what texts that are equal under them have in common, as an expression over the plain text.
_CASE_RULES = {
    "string collate UTF8_LCASE": "translate(lower(CAST({} AS STRING)), 'ς', 'σ')",
    "string collate UTF8_LCASE_RTRIM": "translate(lower(rtrim(CAST({} AS STRING))), 'ς', 'σ')",
}
_ROUTABLE |= set(_CASE_RULES)


def _can_route(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> bool:
    """Whether equal keys have equal hashes: same type, without a collation or with one that is known, or both integral."""
    def routable(a: str, b: str) -> bool:
        return (a == b and (a in _ROUTABLE or a.startswith("decimal"))) or (a in _INTEGRAL and b in _INTEGRAL)

    lt, rt = dict(left.dtypes), dict(right.dtypes)
    return all(routable(lt[k], rt[k]) for k in keys)


def _routed(df: DataFrame, keys: Sequence[str], spread_nulls: bool) -> DataFrame:
    types = dict(df.dtypes)
    route = "xxhash64({})".format(", ".join(
        f"CAST(`{k}` AS BIGINT)" if types[k] in _INTEGRAL else _CASE_RULES.get(types[k], "{}").format(f"`{k}`") for k in keys))
    rest = [c for c in df.columns if c not in keys]
    if spread_nulls and rest:
        incomplete = " OR ".join(f"`{k}` IS NULL" for k in keys)
        others = ", ".join(f"`{c}`" for c in rest)
        route = f"CASE WHEN {incomplete} THEN xxhash64({others}) ELSE {route} END"
    return df.selectExpr("*", f"({route}) & {_ROUTES - 1} AS {_ROUTE}")


def complete(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows whose key columns are all set; the filter reaches the scan."""
    return df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in ([keys] if isinstance(keys, str) else keys)))


def probe(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner",
          null_safe: bool = False, unique: bool = False) -> DataFrame:
    """Join ``left`` to a ``right`` that was reduced beforehand (few rows per key).

    ``how`` is inner, left, left_semi or left_anti.  NULL keys match nothing
    unless ``null_safe``.  Key columns appear once, with the left side's values.
    ``unique`` says that the left side has one row per key, so nothing can be
    hot: the join is then made on the key alone and uses the partitioning that
    both sides already have.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    routed = not unique and _can_route(left, right, keys)
    spread = not null_safe and how in ("left", "left_anti")
    if how in ("inner", "left_semi") and not null_safe:
        left = complete(left, keys)
    if routed:
        left, right = _routed(left, keys, spread), _routed(right, keys, False)
    on = keys + [_ROUTE] if routed else keys
    if not null_safe:
        joined = left.join(right, on, how)
    else:
        renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
        condition = F.expr(" AND ".join(
            f"`{k}` {'=' if k == _ROUTE else '<=>'} `_right_{k}`" for k in on))
        joined = left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in on])
    return joined.drop(_ROUTE)


def restrict(df: DataFrame, key: str, subjects: DataFrame | Sequence | None) -> DataFrame:
    """Keep the rows of the given subjects: a value list (pushed to the scan) or a key DataFrame."""
    if subjects is None:
        return df.filter(F.col(key).isNotNull())
    if isinstance(subjects, DataFrame):
        return probe(df, subjects.select(key).distinct(), key, "left_semi")
    return df.filter(F.col(key).isin(list(subjects)))


def first_per_key(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """The first row of every non-NULL key under a total order.

    Ties under ``order`` are broken by all remaining columns, ascending with
    NULLs first.  Spark keeps only each task's own candidate before the shuffle,
    so a hot key sends one row per task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ties = [F.asc_nulls_first(c) for c in df.columns if c not in keys]
    window = Window.partitionBy(*keys).orderBy(*order, *ties)
    return (complete(df, keys)
              .withColumn("_position", F.row_number().over(window))
              .filter(F.col("_position") == 1)
              .drop("_position"))


def repeated(df: DataFrame, n: str, keep: bool = False, block: int = 10_000) -> DataFrame:
    """Expand every row ``n`` times, one block per row first so that no task expands a hot row alone."""
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / block) - 1)))
    spread = blocks.repartition(*blocks.columns)
    copies = spread.withColumn("copy", F.explode(F.sequence(
        F.col("_block") * block + 1, F.least((F.col("_block") + 1) * block, F.col(n)))))
    return copies.drop("_block") if keep else copies.drop("_block", n, "copy")
