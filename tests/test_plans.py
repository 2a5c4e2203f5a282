"""Physical plans: nothing quadratic, no Python, pushed filters, and hot keys split at run time."""

import contextlib

import pytest
from pyspark.sql import functions as F

from opscheck.operators import carcass, duplicates, holds, payloads, queues, shipping
from opscheck.plans.registered import QUERIES, Roles
from tests.compare import TESTDATA

SF_DIR = f"{TESTDATA}/sf0.001"
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "InArrow")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def settings(spark, **values):
    values = {"spark.sql." + k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def large_data(spark):
    """Thresholds at which the small test tables behave like large ones."""
    return settings(spark, shuffle__partitions="8", autoBroadcastJoinThreshold="-1",
                    adaptive__autoBroadcastJoinThreshold="-1",
                    adaptive__skewJoin__skewedPartitionThresholdInBytes="40KB",
                    adaptive__skewJoin__skewedPartitionFactor="2",
                    adaptive__advisoryPartitionSizeInBytes="20KB")


@pytest.mark.parametrize("name", QUERIES)
def test_no_quadratic_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert not [node for node in UNWANTED if node in plan]


@pytest.mark.parametrize("name", [
    "missing_allocations", "duplicate_groups", "carcass_record", "order_payloads", "load_wont_close_summary"])
def test_no_broadcast_is_forced_on_large_sides(spark, name):
    with large_data(spark):
        plan = plan_of(QUERIES[name](spark, SF_DIR))
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not joins


def splits(df) -> bool:
    """Run, and tell whether a join input was split by adaptive execution."""
    counted = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.bit_xor("h"))
    counted.collect()
    return "skew=true" in plan_of(counted)


def hot(n: int, key: str, value="7"):
    """SQL for a key that takes ``value`` on a third of the rows and is spread elsewhere."""
    return f"CASE WHEN id % 3 = 0 THEN {value} ELSE {key} END"


def test_hot_probe_key_is_split(spark):
    with large_data(spark):
        inventory = spark.range(0, 60000, 1, 8).selectExpr(
            "concat('D', id % 100) AS ExitDeliveryNumber", f"{hot(60000, 'id')} AS InventoryId")
        allocations = spark.range(0, 60000, 2, 8).selectExpr("id AS InventoryId")
        assert splits(shipping.missing_allocations(inventory, allocations))


def test_null_probe_keys_spread_without_help(spark):
    with settings(spark, shuffle__partitions="8", autoBroadcastJoinThreshold="-1", adaptive__enabled="false"):
        inventory = spark.range(0, 60000, 1, 8).selectExpr(
            "concat('D', id % 5000) AS ExitDeliveryNumber", f"{hot(60000, 'id', 'NULL')} AS InventoryId")
        allocations = spark.range(0, 60000, 2, 8).selectExpr("id AS InventoryId")
        found = shipping.missing_allocations(inventory, allocations)
        sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_hot_barcode_is_split_and_whole(spark):
    with large_data(spark):
        cases = spark.range(0, 60000, 1, 8).selectExpr(
            "id AS InventoryId", f"{hot(60000, 'concat(\"b\", id)', '\"hot\"')} AS Barcode",
            "'L1' AS WarehouseLocationId", "md5(string(id)) AS pad")
        places = spark.sql("SELECT 'L1' AS LocationId, 'W' AS WarehouseId, 'A' AS AreaId")
        areas = spark.sql("SELECT 'W' AS WarehouseId, 'A' AS AreaId, 1 AS IsAvailable")
        groups = duplicates.duplicate_groups(cases, places, areas)
        assert splits(groups)
        assert groups.count() == 20000


def test_hot_foreign_key_is_split(spark):
    with large_data(spark):
        chain = spark.range(0, 60000, 1, 8).selectExpr(
            "md5(string(id)) AS CarcassId", f"{hot(60000, 'concat(\"k\", id)', '\"k1\"')} AS bt_KillGroupId")
        groups = spark.range(0, 60000, 1, 8).selectExpr(
            "concat('k', id) AS KillGroupId", "'s' AS ScheduleGroup", "'p' AS PurchaseGroup", "1 AS HeadCount")
        assert splits(carcass.kill_group(chain, groups))


def test_first_per_key_is_limited_before_its_shuffle(spark):
    r = Roles(spark, SF_DIR)
    plan = plan_of(carcass.latest_backtag(r.carcasses(), r.backtag()))
    assert "row_number(), 1, Partial" in plan and "row_number(), 1, Final" in plan


def test_filters_reach_the_scan(spark):
    r = Roles(spark, SF_DIR)
    plan = plan_of(queues.pending_backlog(r.messages(), "2024-01-15"))
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    single = plan_of(shipping.missing_allocations(r.inventory(), r.allocations(), [5]))
    assert "EqualTo(o_custkey,5)" in single
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in single


def test_counts_are_combined_before_the_shuffle(spark):
    r = Roles(spark, SF_DIR)
    assert "partial_count" in plan_of(queues.failed_transactions(r.staging(), ("click",)))
    assert "partial_bool_or" in plan_of(holds.missing_hold_reason(r.statuses(), r.reasons())) or "partial_max" in plan_of(
        holds.missing_hold_reason(r.statuses(), r.reasons()))
    assert "partial_count" in plan_of(payloads.line_counts(r.order_lines()))
