"""Tables of one site, from files or over JDBC."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opscheck.operators.ranking import numbered
from opscheck.roles import SCHEMAS
from opscheck.sources.sites import Site

LOGIN_TIMEOUT_SECONDS = 10


def jdbc_options(site: Site, table: str, columns: list[str] | None = None,
                 read_uncommitted: bool = True, partition: tuple[str, object, object, int] | None = None,
                 **extra: str) -> dict[str, str]:
    """Reader options for one table of a site's database.

    ``partition`` is (column, lower bound, upper bound, number of partitions) and
    makes the read parallel.  The isolation hint goes into the table expression,
    where filters and column pruning are still pushed down.
    """
    hint = " WITH (READUNCOMMITTED)" if read_uncommitted else ""
    listed = ", ".join(columns) if columns else "*"
    options = {
        "url": f"jdbc:sqlserver://{site.server};databaseName={site.database};"
               f"integratedSecurity=true;loginTimeout={LOGIN_TIMEOUT_SECONDS}",
        "dbtable": f"(SELECT {listed} FROM {table}{hint}) AS t",
    }
    if partition:
        column, lower, upper, count = partition
        options |= {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(count)}
    return options | extra


def _literal(value: object) -> str:
    """A value as SQL text; a text or a date is quoted."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"{value!r} bounds nothing")
    if isinstance(value, (datetime.date, datetime.datetime)):
        return f"'{value.isoformat()}'"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def range_predicates(column: str, bounds: Sequence) -> list[str]:
    """Conditions that split a table at ``bounds`` into ranges, each row in exactly one; NULL goes with the first.

    Every condition is one task's query, so a read over JDBC is as parallel as there are ranges.
    """
    cuts = [_literal(b) for b in sorted(set(bounds))]
    if not cuts:
        return ["1 = 1"]
    between = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *between, f"{column} >= {cuts[-1]}"]


def key_predicates(column: str, values: Sequence, n: int) -> list[str]:
    """Conditions for a column of few values, ``n`` lists of them and one for the rows with none of them.

    The values come in the order of their weight, heaviest first, and are dealt to the lists in turn, so that heavy ones part.
    """
    keys = [_literal(v) for v in dict.fromkeys(values)]
    if not keys:
        return ["1 = 1"]
    lists = [keys[k::n] for k in range(min(n, len(keys)))]
    rest = f"{column} IS NULL OR {column} NOT IN ({', '.join(keys)})"
    return [f"{column} IN ({', '.join(part)})" for part in lists] + [rest]


def sampled_bounds(sample: DataFrame, column: str, n: int) -> list:
    """At most ``n`` - 1 distinct values that split a sample into ``n`` parts of about equal size.

    Any ordered type will do, and a sample of any size: its values are numbered in sorted ranges, and of every
    ``n``-th of the positions the first value is a bound. Only the bounds come to the driver.
    """
    values = numbered(sample.select(F.col(column).alias("v")).filter("v IS NOT NULL"), [F.col("v")], "position", spread=True)
    part = F.floor(F.col("position") * n / F.lit(max(1, values.count()))).alias("part")
    firsts = values.groupBy(part).agg(F.min("v").alias("v")).filter("part > 0")
    return sorted({r["v"] for r in firsts.collect()})


def sample_query(table: str, column: str, percent: float = 1.0) -> str:
    """The query that reads a share of a table's pages for :func:`sampled_bounds`."""
    return f"(SELECT {column} FROM {table} TABLESAMPLE ({percent:g} PERCENT)) AS t"


def load_in_ranges(spark: SparkSession, site: Site, table: str, column: str, n: int, percent: float = 1.0,
                   **jdbc) -> DataFrame:
    """A table over JDBC in ``n`` ranges of ``column`` of about equal size, by bounds from a sample of its pages."""
    options = jdbc_options(site, table, **jdbc)
    sample = spark.read.format("jdbc").options(**options | {"dbtable": sample_query(table, column, percent)}).load()
    return _by_predicates(spark, options, range_predicates(column, sampled_bounds(sample, column, n)))


def _by_predicates(spark: SparkSession, options: dict[str, str], predicates: list[str]) -> DataFrame:
    rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(options["url"], options["dbtable"], predicates=predicates, properties=rest)


def load_table(spark: SparkSession, site: Site, table: str, role: str | None = None,
               predicates: Sequence[str] | None = None, **jdbc) -> DataFrame:
    """One table of a site.

    A site whose ``database`` is a path (it contains a slash) is read as Parquet
    from ``<database>/<table>.parquet``, with the role's declared schema if one is
    named; any other site is read over JDBC with a driver the user supplies, in one task
    unless ``partition`` or ``predicates`` (one task each) say otherwise.
    """
    if "/" in site.database:
        reader = spark.read.schema(SCHEMAS[role]) if role else spark.read
        return reader.parquet(f"{site.database.rstrip('/')}/{table}.parquet")
    options = jdbc_options(site, table, **jdbc)
    if predicates:
        return _by_predicates(spark, options, list(predicates))
    return spark.read.format("jdbc").options(**options).load()
