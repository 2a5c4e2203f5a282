"""Checks on the links delivery -> shipment -> trailer and inventory -> allocation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.functions.predicates import null_or_zero, unset
from opscheck.operators.keyed import probe, restrict

Subjects = DataFrame | Sequence | None


def missing_allocations(inventory: DataFrame, allocations: DataFrame, subjects: Subjects = None) -> DataFrame:
    """Inventory on a delivery without an allocation row.

    One row per inventory row; an inventory row with a NULL id counts as missing.
    """
    rows = restrict(
        inventory.select(F.col("ExitDeliveryNumber").alias("DeliveryNumber"), "InventoryId"),
        "DeliveryNumber", subjects)
    allocated = allocations.select("InventoryId").distinct()
    return probe(rows, allocated, "InventoryId", "left_anti").select("DeliveryNumber", "InventoryId")


def missing_shipment(subjects: DataFrame, stops: DataFrame) -> DataFrame:
    """Deliveries that are on no shipment."""
    served = stops.select("DeliveryNumber").distinct()
    return probe(subjects.select("DeliveryNumber"), served, "DeliveryNumber", "left_anti")


def found_shipments(stops: DataFrame, subjects: Subjects = None) -> DataFrame:
    """The shipments of each delivery, one row per stop."""
    return restrict(stops.select("DeliveryNumber", "ShipmentNumber"), "DeliveryNumber", subjects)


def missing_trailer(stops: DataFrame, shipments: DataFrame, subjects: Subjects = None) -> DataFrame:
    """Shipments of a delivery whose trailer is NULL, empty or zero.

    ``n_rows`` is the number of such shipment rows; stops only select shipments,
    so repeated stops do not multiply it.
    """
    unassigned = (shipments.select("ShipmentNumber", "TrailerId")
                  .filter(unset(shipments, "TrailerId"))
                  .groupBy("ShipmentNumber", "TrailerId").agg(F.count("*").alias("n_rows")))
    pairs = found_shipments(stops, subjects)
    return (probe(pairs, unassigned, "ShipmentNumber")
            .select("DeliveryNumber", "ShipmentNumber", "TrailerId", "n_rows").distinct())


def missing_trailer_capacity(stops: DataFrame, shipments: DataFrame, trailers: DataFrame,
                             subjects: Subjects = None) -> DataFrame:
    """Trailers of a delivery's shipments with NULL or zero capacity, or without a trailer row.

    Stop rows, shipment rows and trailer rows multiply as in a plain join; the
    product is carried in ``n_rows`` rather than spelled out row by row.
    """
    by_trailer = trailers.groupBy("TrailerId").agg(
        F.count_if(null_or_zero(F.col("TrailerCapacity"))).alias("n_bad"))
    affected = (probe(shipments.select("ShipmentNumber", "TrailerId"), by_trailer, "TrailerId", "left")
                .withColumn("n_bad", F.coalesce("n_bad", F.lit(1)))
                .filter("n_bad > 0")
                .groupBy("ShipmentNumber", "TrailerId").agg(F.sum("n_bad").alias("n_bad")))
    return (probe(found_shipments(stops, subjects), affected, "ShipmentNumber")
            .groupBy("DeliveryNumber", "ShipmentNumber", "TrailerId")
            .agg(F.sum("n_bad").alias("n_rows")))
