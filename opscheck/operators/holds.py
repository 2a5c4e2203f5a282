"""Checks on inventory holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.fixed_values import HOLD_STATUS
from opscheck.operators.keyed import probe


def missing_hold_reason(statuses: DataFrame, reasons: DataFrame, hold_status: str = HOLD_STATUS) -> DataFrame:
    """Inventory on hold without a reason, as distinct ids.

    A hold fires when its own reason is NULL, when no reason row exists (a NULL
    plant or id never finds one), or when any of its reason rows has a NULL code.
    """
    by_hold = reasons.groupBy("PlantCode", "InventoryId").agg(
        F.bool_or(F.col("QAReasonCode").isNull()).alias("uncoded"))
    holds = (statuses.filter(F.col("QAStatusCode") == hold_status)
             .select("PlantCode", "InventoryId", "QAReasonCode"))
    return (probe(holds, by_hold, ["PlantCode", "InventoryId"], "left")
            .filter(F.col("QAReasonCode").isNull() | F.coalesce("uncoded", F.lit(True)))
            .select("InventoryId").distinct())
