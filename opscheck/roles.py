"""Table roles: the columns each operator reads, and how to map a table onto them.

Operators name their columns by role (``InventoryId``, ``DeliveryNumber`` ...).
A table that uses other names is projected once with :func:`adapt`; Catalyst
pushes the projection into the scan, so only the mapped columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "inventory_details": "InventoryId BIGINT, ExitDeliveryNumber STRING, PalletNumber STRING, "
                         "DeliveryNumber STRING, ProductId INT, WarehouseLocationId STRING",
    "delivery_allocations": "InventoryId BIGINT",
    "shipment_stop_deliveries": "ShipmentNumber STRING, DeliveryNumber STRING",
    "shipments": "ShipmentNumber STRING, TrailerId STRING",
    "trailers": "TrailerId STRING, TrailerCapacity DOUBLE",
    "qa_statuses": "PlantCode STRING, InventoryId BIGINT, QAStatusCode STRING, QAReasonCode STRING",
    "qa_status_reasons": "PlantCode STRING, InventoryId BIGINT, QAReasonCode STRING",
    "master_staging": "StagingId BIGINT, PosterType STRING, TransferStatus INT, FailReason STRING",
    "outbound_messages": "MessageName STRING, Status STRING, CreateTime TIMESTAMP_NTZ",
    "pick_faces": "LocationId STRING, ProductId INT",
    "directed_tasks": "PalletNumber STRING, CreatedDate TIMESTAMP_NTZ, StatusId INT",
    "area_locations": "LocationId STRING, WarehouseId STRING, AreaId STRING, ZoneId INT",
    "areas": "WarehouseId STRING, AreaId STRING, IsAvailable INT",
    "settings": "PackageName STRING, Code STRING, Value STRING",
    "inventory_cases": "InventoryId BIGINT, Barcode STRING, WarehouseLocationId STRING, PlantCode STRING, "
                       "ProductId INT, PalletNumber STRING, Weight DOUBLE, Qty DOUBLE, "
                       "ProductionDate TIMESTAMP_NTZ, CreatedDate TIMESTAMP_NTZ, CreatedBy STRING, "
                       "ModifiedDate TIMESTAMP_NTZ, ModifiedBy STRING",
    "plants": "PlantCode STRING, Description STRING",
    "backtag": "CarcassId STRING, KillDate TIMESTAMP_NTZ, KillGroupId STRING, PurchaseGroup STRING, "
               "CpsTransferStatus STRING, Eid STRING",
    "hot": "BackTagCarcassId STRING, Side STRING, KillDate TIMESTAMP_NTZ, "
           "BackTagKillDate TIMESTAMP_NTZ, ApprovedBy STRING, ApprovedDate TIMESTAMP_NTZ",
    "epv": "CarcassId STRING, Grade STRING, QualityProgram STRING, ApprovedBy STRING, "
           "ApprovedDate TIMESTAMP_NTZ, CpsTransfer STRING",
    "kill_groups": "KillGroupId STRING, ScheduleGroup STRING, PurchaseGroup STRING, HeadCount INT",
    "lot_details": "ScheduleGroup STRING, ScheduledHeadCount INT, ReceivedHeadCount INT",
    "raw_interface": "MessageId BIGINT, StatusId INT, ServiceId STRING, Data STRING",
    "third_parties": "ThirdPartyId STRING, VendorName STRING, Street1 STRING, Street2 STRING, "
                     "City STRING, ZipCode STRING, StateProvince STRING",
    "order_headers": "OrderNumber STRING, FileName STRING, ThirdPartyId STRING, ReferenceOrder STRING, "
                     "Priority STRING, OrderType STRING, Instructions STRING, DeliveryDate STRING, "
                     "LoadDate STRING, DeliveryTime STRING, GeoCode STRING, WarehouseCode STRING, "
                     "ShipTo STRING, PlantCode STRING, SenderId STRING, ReceiverId STRING",
    "order_lines": "OrderNumber STRING, Seq INT, ProductCode STRING, BaseQty STRING, "
                   "Instructions STRING, MinSellBy STRING",
}


def adapt(df: DataFrame, **roles: str | Column) -> DataFrame:
    """Project ``df`` onto role columns; a role is a column name or an expression."""
    return df.select(*[
        (F.col(source) if isinstance(source, str) else source).alias(role)
        for role, source in roles.items()
    ])


def under_collation(df: DataFrame, *columns: str, collation: str = "UTF8_LCASE") -> DataFrame:
    """``df`` with text columns (default: all) that compare under a collation, as on the server they come from.

    ``UTF8_LCASE`` ignores case, ``UTF8_LCASE_RTRIM`` trailing blanks too; ``UTF8_BINARY`` is Spark's own rule. Joins,
    groups, filters and the routing of hot keys then follow it; both sides of a comparison need the same one.
    """
    texts = columns or [c for c, kind in df.dtypes if kind.startswith("string")]
    return df.withColumns({c: F.collate(F.col(c), collation) for c in texts})
