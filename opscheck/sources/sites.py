"""The site registry, and reads over several sites."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opscheck.fixed_values import SITE_DEFAULTS

_ENTRY = ", ".join(f"{field} STRING" for field in SITE_DEFAULTS)


@dataclass(frozen=True)
class Site:
    name: str
    code: str
    server: str
    database: str
    environment: str
    notes: str


def sites_frame(spark: SparkSession, path: str) -> DataFrame:
    """The registry file as a DataFrame, absent fields filled with their defaults."""
    document = spark.read.schema(f"plants ARRAY<STRUCT<{_ENTRY.replace(' STRING', ': STRING')}>>").json(
        path, multiLine=True)
    entries = document.select(F.inline("plants"))
    return entries.select(*[
        F.coalesce(F.col(field), F.lit(default)).alias(field) for field, default in SITE_DEFAULTS.items()
    ])


def load_sites(spark: SparkSession, path: str) -> list[Site]:
    """The sites of the registry file, which lists connections and is small by nature."""
    sites = [Site(**row.asDict()) for row in sites_frame(spark, path).collect()]
    if not sites:
        raise ValueError(f"no sites in {path}")
    return sites


def load_all_sites(spark: SparkSession, sites: Iterable[Site], table: str, role: str | None = None,
                   **jdbc) -> DataFrame:
    """One table of every site, tagged with ``site_code``; columns a site lacks are NULL."""
    from opscheck.sources.tables import load_table

    frames = [load_table(spark, s, table, role, **jdbc).withColumn("site_code", F.lit(s.code)) for s in sites]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def across_sites(spark: SparkSession, sites: Iterable[Site], check: Callable[..., DataFrame],
                 options: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Run a check on every site and stack the results, tagged with ``site_code``.

    ``check`` gets a loader ``load(table, role=None, **options)``.  ``options`` holds reader options per table
    (of :func:`opscheck.sources.tables.load_table`, such as ``partition``), which the loader's own arguments
    override.  Keys of different sites never meet, and all sites run in one job.
    """
    from opscheck.sources.tables import load_table

    def one(site: Site) -> DataFrame:
        def load(table: str, role: str | None = None, **own) -> DataFrame:
            return load_table(spark, site, table, role, **{**(options or {}).get(table, {}), **own})

        return check(load).withColumn("site_code", F.lit(site.code))

    return reduce(lambda a, b: a.unionByName(b), [one(s) for s in sites])
