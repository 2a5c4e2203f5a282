"""Key/value settings and the lists stored in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.fixed_values import (
    SHIPPING_POINT_FIELD,
    WAREHOUSE_CODE_FIELD,
    WAREHOUSE_CODES_SETTING,
    ZONES_SETTING,
)
from opscheck.operators.keyed import first_per_key, probe
from opscheck.operators.results import StateRule, state_status

CODES_RULE = StateRule({
    "none": ("issues_found", "No warehouse code setting found (%d)"),
    "unreadable": ("error", "The warehouse code setting is no list of codes (%d)"),
    "read": ("ok", "%d warehouse code(s) read"),
})


def setting(settings: DataFrame, package: str, code: str) -> DataFrame:
    """The rows of one setting; both filters reach the scan."""
    return settings.filter((F.col("PackageName") == package) & (F.col("Code") == code))


def zone_list(settings: DataFrame, key: tuple[str, str] = ZONES_SETTING) -> DataFrame:
    """Distinct zone ids of the comma-separated zone setting; a value that is no integer raises."""
    values = setting(settings, *key)
    return values.select(F.explode(F.split("Value", ",").cast("array<int>")).alias("ZoneId")).distinct()


def warehouse_codes(settings: DataFrame, by: tuple[str, ...] = (),
                    key: tuple[str, str] = WAREHOUSE_CODES_SETTING) -> DataFrame:
    """Warehouse codes (and shipping points) listed in a JSON setting, one row per code.

    ``by`` names site columns when several sites are read together.  A setting
    without codes yields one row with NULL codes, so that its status
    stays visible: ``issues_found`` without a value, ``error`` for text that
    is not a list of coded objects, else ``ok``.
    """
    mapping = f"array<struct<{WAREHOUSE_CODE_FIELD}:string,{SHIPPING_POINT_FIELD}:string>>"
    value = setting(settings, *key).select(*by, "Value")
    pick = F.asc_nulls_last("Value")
    value = first_per_key(value, by, [pick]) if by else value.orderBy(pick).limit(1)
    parsed = value.withColumn("entries", F.from_json("Value", mapping))
    unreadable = F.col("entries").isNull() | F.exists(
        "entries", lambda e: e[WAREHOUSE_CODE_FIELD].isNull())
    status = (F.when(F.col("Value").isNull() | (F.col("Value") == ""), "issues_found")
               .when(unreadable, "error")
               .otherwise("ok"))
    listed = F.when(F.col("status") == "ok", F.col("entries"))
    return (parsed.withColumn("status", status)
            .select(*by, "status", F.inline_outer(listed))
            .withColumnsRenamed({WAREHOUSE_CODE_FIELD: "WarehouseCode", SHIPPING_POINT_FIELD: "ShippingPoint"}))


def warehouse_code_statuses(settings: DataFrame, sites: DataFrame | None = None, by: str = "site_code") -> DataFrame:
    """One status per site: ``issues_found`` without a setting, ``error`` for one that can't be read, else ``ok``.

    The status follows from how the value reads, not from a number: an empty list is ``ok`` with no
    codes.  ``sites`` (column ``by``) adds the sites that have no such setting at all.
    """
    state = {"issues_found": "none", "error": "unreadable", "ok": "read"}
    named = F.create_map(*[F.lit(x) for pair in state.items() for x in pair])
    per_site = (warehouse_codes(settings, by=(by,)).groupBy(by)
                .agg(F.min("status").alias("_status"), F.count("WarehouseCode").alias("n_findings"))
                .select(F.col(by).alias("subject"), named[F.col("_status")].alias("state"), "n_findings"))
    if sites is not None:
        wanted = sites.select(F.col(by).alias("subject")).distinct()
        per_site = probe(wanted, per_site, "subject", "left", unique=True).select(
            "subject", F.coalesce("state", F.lit("none")).alias("state"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
    return state_status(per_site, "warehouse_codes", CODES_RULE)
