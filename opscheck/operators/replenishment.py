"""Pallets that match a pick face's product but cannot replenish it, with the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.fixed_values import (
    CLOSED_TASK_STATUS,
    REASON_ACTIVE_TASK,
    REASON_COMMITTED,
    REASON_UNKNOWN,
)
from opscheck.operators.keyed import complete, probe, repeated, restrict
from opscheck.operators.settings import zone_list


def pallet_states(inventory: DataFrame, tasks: DataFrame, closed_status: int = CLOSED_TASK_STATUS) -> DataFrame:
    """The pallets that are blocked: ``committed`` to a delivery, or with newest tasks (``n_latest``) that are open (``n_open``).

    Tasks and inventory rows with a delivery go through the same two aggregates, first by pallet and date, so tied
    tasks never travel as rows; pallets that nothing blocks end there.
    """
    open_task = F.coalesce(F.col("StatusId") != closed_status, F.lit(False))
    seen = (complete(tasks, ["PalletNumber", "CreatedDate"])
            .select("PalletNumber", "CreatedDate", open_task.alias("is_open"), F.lit(False).alias("committed")))
    held = (inventory.filter(F.col("PalletNumber").isNotNull() & F.col("DeliveryNumber").isNotNull())
            .select("PalletNumber", F.lit(None).cast(tasks.schema["CreatedDate"].dataType).alias("CreatedDate"),
                    F.lit(False).alias("is_open"), F.lit(True).alias("committed")))
    per_date = seen.unionByName(held).groupBy("PalletNumber", "CreatedDate").agg(
        F.count("CreatedDate").alias("n_latest"), F.count_if("is_open").alias("n_open"), F.max("committed").alias("committed"))
    newest = F.max(F.struct("CreatedDate", "n_latest", "n_open"))  # a NULL date is the smallest
    states = per_date.groupBy("PalletNumber").agg(newest.alias("newest"), F.max("committed").alias("committed"))
    return states.select("PalletNumber", "committed", "newest.n_latest", "newest.n_open").filter("committed OR n_open > 0")


def face_products(pick_faces: DataFrame, subjects=None) -> DataFrame:
    """The product of each pick face; of several the smallest id counts."""
    return (restrict(pick_faces, "LocationId", subjects)
            .groupBy("LocationId").agg(F.min("ProductId").alias("ProductId")))


def blocked_pallets(products: DataFrame, inventory: DataFrame, tasks: DataFrame,
                    area_locations: DataFrame, settings: DataFrame) -> DataFrame:
    """Blocked pallets of the given products in replenishment zones, with the reason.

    A pallet is blocked when any of its inventory rows has a delivery, or when
    one of its newest tasks has a known status other than closed.  The checked
    system lists one line per inventory row and tied task; ``n_rows`` is that
    number of lines.
    """
    in_zone = (probe(area_locations.select("LocationId", "ZoneId"), zone_list(settings), "ZoneId", "left_semi")
               .select(F.col("LocationId").alias("WarehouseLocationId")).distinct())
    wanted = products.select("ProductId").distinct()

    stock = inventory.filter(F.col("PalletNumber").isNotNull()).select("PalletNumber", "ProductId", "WarehouseLocationId")
    stock = probe(probe(stock, wanted, "ProductId", "left_semi"), in_zone, "WarehouseLocationId", "left_semi")
    stock = stock.groupBy("PalletNumber", "ProductId").agg(F.count("*").alias("n_stock"))
    blocked = probe(stock, pallet_states(inventory, tasks), "PalletNumber")
    return blocked.select(
        "ProductId", "PalletNumber",
        F.when(F.col("committed"), REASON_COMMITTED).when(F.col("n_open") > 0, REASON_ACTIVE_TASK)
         .otherwise(REASON_UNKNOWN).alias("Reason"),
        (F.col("n_stock") * F.when(F.col("committed"), F.greatest("n_latest", F.lit(1))).otherwise(F.col("n_open"))).alias("n_rows"))


@dataclass(frozen=True)
class BlockedFactors:
    """Blocked pallets by product, and the pick faces of each product, which together stand for all pairs.

    ``pallets`` has ProductId, PalletNumber, Reason, n_rows and n_faces, the number of pick faces it is listed for; ``faces``
    has LocationId and ProductId. :func:`pairs` joins them where a list is asked for.
    """
    pallets: DataFrame
    faces: DataFrame

    def pairs(self) -> DataFrame:
        pallets = self.pallets.drop("n_faces")
        return probe(pallets, self.faces, "ProductId").select("LocationId", "PalletNumber", "Reason", "n_rows")


def blocked_factors(pick_faces: DataFrame, inventory: DataFrame, tasks: DataFrame,
                    area_locations: DataFrame, settings: DataFrame, subjects=None) -> BlockedFactors:
    """:func:`blocked_pallets` of the products of the pick faces, without multiplying pallets by pick faces."""
    faces = face_products(pick_faces, subjects)
    blocked = blocked_pallets(faces, inventory, tasks, area_locations, settings)
    n_faces = faces.groupBy("ProductId").agg(F.count("*").alias("n_faces"))
    return BlockedFactors(probe(blocked, n_faces, "ProductId"), faces)


def replenishment_blocked(pick_faces: DataFrame, inventory: DataFrame, tasks: DataFrame,
                          area_locations: DataFrame, settings: DataFrame, subjects=None,
                          per: str = "pallet") -> DataFrame:
    """:func:`blocked_pallets` listed per pick face (``LocationId``).

    ``per='pallet'`` gives one row per pick face and pallet with ``n_rows``;
    ``per='row'`` repeats the lines.  Pick faces that share a product repeat its
    pallets; for counts alone use :func:`blocked_counts`.
    """
    faces = face_products(pick_faces, subjects)
    blocked = blocked_pallets(faces, inventory, tasks, area_locations, settings)
    listed = probe(blocked, faces, "ProductId").select("LocationId", "PalletNumber", "Reason", "n_rows")
    return listed if per == "pallet" else repeated(listed, "n_rows")


def blocked_counts(pick_faces: DataFrame, inventory: DataFrame, tasks: DataFrame,
                   area_locations: DataFrame, settings: DataFrame, subjects=None) -> DataFrame:
    """Number of blocked pallets and lines per pick face, summed per product before faces are joined."""
    faces = face_products(pick_faces, subjects)
    per_product = (blocked_pallets(faces, inventory, tasks, area_locations, settings)
                   .groupBy("ProductId")
                   .agg(F.count("*").alias("n_pallets"), F.sum("n_rows").alias("n_rows")))
    return probe(faces, per_product, "ProductId").select("LocationId", "n_pallets", "n_rows")
