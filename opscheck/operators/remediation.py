"""Corrections for stale duplicates: as a plan, as corrected tables, and as scripts."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opscheck.fixed_values import (
    ADJUSTMENT_LOCATION,
    ALLOCATIONS_TABLE,
    CASES_TABLE,
    QA_STATUSES_TABLE,
    REMEDIATION_USER,
    SCRIPT_CHANGES,
    SCRIPT_CLOSING,
    SCRIPT_OPENING,
)
from opscheck.operators.batches import id_lists
from opscheck.operators.keyed import probe


def stale_ids(stale: DataFrame) -> DataFrame:
    return stale.select(F.col("DuplicateInventoryId").alias("InventoryId")).distinct()


def remediation_plan(stale: DataFrame, allocations: DataFrame, qa_statuses: DataFrame) -> DataFrame:
    """Which ids to delete or update in which table, child tables first.

    ``n_rows`` is the number of rows of the target table the id stands for.
    """
    children = (allocations.select(F.lit(1).alias("step"), "InventoryId")
                .unionByName(qa_statuses.select(F.lit(2).alias("step"), "InventoryId")))
    touched = probe(children, stale_ids(stale), "InventoryId", "left_semi")
    cases = stale.select(F.lit(3).alias("step"), F.col("DuplicateInventoryId").alias("InventoryId"))
    counted = touched.unionByName(cases).groupBy("step", "InventoryId").agg(F.count("*").alias("n_rows"))
    step = F.col("step")
    return counted.select(
        "step", F.when(step == 3, "UPDATE").otherwise("DELETE").alias("action"),
        F.when(step == 1, ALLOCATIONS_TABLE).when(step == 2, QA_STATUSES_TABLE).otherwise(CASES_TABLE)
         .alias("target_table"),
        "InventoryId", "n_rows")


def remediate_cases(cases: DataFrame, stale: DataFrame, as_of: str | datetime.datetime | None = None,
                    location: str = ADJUSTMENT_LOCATION, user: str = REMEDIATION_USER) -> DataFrame:
    """The case table with its stale rows moved to the adjustment location."""
    flagged = probe(cases, stale_ids(stale).withColumn("_stale", F.lit(True)), "InventoryId", "left")
    modified = F.lit(as_of) if as_of is not None else F.current_timestamp()
    changes = {
        "WarehouseLocationId": F.lit(location),
        "ModifiedBy": F.lit(user),
        "ModifiedDate": modified,
    }
    return flagged.select(*[
        F.when(F.col("_stale"), changes[c].cast(cases.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in changes else F.col(c)
        for c in cases.columns
    ])


def remediate_children(table: DataFrame, stale: DataFrame) -> DataFrame:
    """A child table without the rows of stale cases."""
    return probe(table, stale_ids(stale), "InventoryId", "left_anti").select(*table.columns)


def deleted_children(table: DataFrame, stale: DataFrame) -> DataFrame:
    """The rows :func:`remediate_children` leaves out."""
    return probe(table, stale_ids(stale), "InventoryId", "left_semi").select(*table.columns)


remediate_allocations = remediate_children
remediate_hold_statuses = remediate_children


def apply_plan(table: DataFrame, plan: DataFrame, target_table: str, as_of=None) -> DataFrame:
    """Apply the steps of a plan that concern ``target_table``."""
    steps = plan.filter(F.col("target_table") == target_table)
    stale = steps.select(F.col("InventoryId").alias("DuplicateInventoryId"))
    if target_table == CASES_TABLE:
        return remediate_cases(table, stale, as_of)
    return remediate_children(table, stale)


def plant_name(plants: DataFrame, cases: DataFrame) -> Column:
    """Description of the first plant that holds cases, for a script header."""
    present = cases.select("PlantCode").distinct()
    return F.coalesce(
        probe(plants, present, "PlantCode", "left_semi").agg(F.min_by("Description", "PlantCode")).scalar(),
        F.lit("Unknown Plant"))


def render_scripts(plan: DataFrame, plant: Column | str, server: str, batch: int = 1000) -> DataFrame:
    """Transaction scripts for a plan, at most ``batch`` ids each, in the order of the steps.

    COMMIT and ROLLBACK stay commented out, for the operator to choose.
    """
    lists = id_lists(plan, "InventoryId", batch, ",\n    ", by=["step", "action", "target_table"])
    width = max(len(column) for column, _ in SCRIPT_CHANGES)
    changes = ",\n        ".join(f"{column:<{width}} = {value}" for column, value in SCRIPT_CHANGES)
    statement = (F.when(F.col("action") == "UPDATE", F.concat(F.lit("UPDATE "), "target_table", F.lit("\n    SET " + changes)))
                  .otherwise(F.concat(F.lit("DELETE FROM "), "target_table")))
    script = F.concat_ws(
        "\n",
        F.concat(F.lit("-- "), F.lit(plant) if isinstance(plant, str) else plant),
        F.lit(f"-- {server}"),
        F.lit(SCRIPT_OPENING),
        statement,
        F.concat(F.lit("WHERE InventoryId IN (\n    "), "literals"),
        F.lit(SCRIPT_CLOSING))
    return lists.select("step", "target_table", "batch", "n_ids", script.alias("script"))
