"""Cases that share a barcode: the keeper, and the stale copies still in active areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.fixed_values import IGNORED_LOCATIONS
from opscheck.operators.keyed import probe


def known_locations(area_locations: DataFrame, areas: DataFrame) -> DataFrame:
    """Every location that belongs to an area, and whether any of its areas is available."""
    by_area = areas.groupBy("WarehouseId", "AreaId").agg(
        F.bool_or(F.coalesce(F.col("IsAvailable") == 1, F.lit(False))).alias("live"))
    return (probe(area_locations.select("LocationId", "WarehouseId", "AreaId"), by_area,
                  ["WarehouseId", "AreaId"])
            .groupBy(F.col("LocationId").alias("WarehouseLocationId"))
            .agg(F.bool_or("live").alias("live")))


def duplicate_groups(cases: DataFrame, area_locations: DataFrame, areas: DataFrame,
                     ignore_locations: Sequence[str] = IGNORED_LOCATIONS,
                     ignore_null_barcode: bool = False) -> DataFrame:
    """Cases whose barcode occurs more than once, outside the ignored locations.

    Copies are counted over all locations; NULL barcodes form one group unless
    ``ignore_null_barcode``.  The keeper is the copy with the highest id.  Adds
    ``cnt``, ``maxinvid``, ``toploc`` and ``botloc`` of the barcode, ``maxloc``
    (the keeper's location when it is in an available area) and ``live`` (the
    same test for the row itself).  A location in several areas counts once.

    Group values come from one aggregate, pre-combined before its shuffle, and
    are joined back to the cases; a barcode with very many copies is split by
    adaptive execution instead of being windowed in one task.  Locations are
    looked up only for what is left after that.
    """
    if ignore_null_barcode:
        cases = cases.filter(F.col("Barcode").isNotNull())
    locations = known_locations(area_locations, areas)
    groups = (cases.groupBy("Barcode")
              .agg(F.count("*").alias("cnt"),
                   F.max(F.struct("InventoryId", "WarehouseLocationId")).alias("keeper"),
                   F.max("WarehouseLocationId").alias("toploc"),
                   F.min("WarehouseLocationId").alias("botloc"))
              .filter("cnt > 1")
              .select("Barcode", "cnt", "toploc", "botloc", F.col("keeper.InventoryId").alias("maxinvid"),
                      F.col("keeper.WarehouseLocationId").alias("maxloc")))
    live_keepers = locations.filter("live").select(
        F.col("WarehouseLocationId").alias("maxloc"), F.col("live").alias("keeper_live"))
    groups = (probe(groups, live_keepers, "maxloc", "left")
              .withColumn("maxloc", F.when(F.col("keeper_live"), F.col("maxloc"))).drop("keeper_live"))
    reportable = cases.filter(~F.col("WarehouseLocationId").isin(list(ignore_locations)))
    copies = probe(reportable, groups, "Barcode", null_safe=True)
    return probe(copies, locations, "WarehouseLocationId")


def stale_duplicates(groups: DataFrame) -> DataFrame:
    """Copies other than the keeper that sit in an available area."""
    return (groups
            .filter((F.col("InventoryId") != F.col("maxinvid")) & F.col("live"))
            .select("ProductionDate", "ProductId", "PalletNumber", "Barcode", "Weight",
                    F.col("cnt").alias("DuplicateCount"),
                    F.col("maxloc").alias("CurrentLocation"),
                    F.col("maxinvid").alias("CurrentInventoryId"),
                    F.col("WarehouseLocationId").alias("DuplicateLocation"),
                    F.col("InventoryId").alias("DuplicateInventoryId"),
                    "CreatedDate", "CreatedBy", "ModifiedDate", "ModifiedBy"))
