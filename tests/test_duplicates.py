import pytest
from pyspark.sql import functions as F

from opscheck.operators import duplicates, remediation
from opscheck.operators.batches import batched, in_clause
from opscheck.plans import scenarios
from tests.fixtures import keys, make, rows

CASES = "InventoryId Barcode WarehouseLocationId PlantCode ModifiedBy ModifiedDate"
FULL = ("ProductId", "PalletNumber", "Weight", "ProductionDate", "CreatedDate", "CreatedBy")


def case(spark, *triples):
    short = make(spark, "inventory_cases", *[(i, b, loc, "P1", "u", None) for i, b, loc in triples], columns=CASES)
    return short.withColumns({c: F.lit(None).cast("string") for c in FULL})


@pytest.fixture
def places(spark):
    return dict(
        area_locations=make(spark, "area_locations", ("A1", "W", "live", 1), ("A2", "W", "live", 1),
                            ("BOTH", "W", "live", 1), ("BOTH", "W", "dead", 1), ("DEAD", "W", "dead", 1),
                            ("SHIPPED", "W", "live", 1), ("LVADJ", "W", "live", 1), ("BELLY", "W", "live", 1)),
        areas=make(spark, "areas", ("W", "live", 1), ("W", "dead", 0)))


@pytest.fixture
def cases(spark):
    return case(
        spark,
        (1, "shipped", "A1"), (2, "shipped", "SHIPPED"),              # one shipped, one active: stale 1
        (3, "three", "A1"), (4, "three", "BOTH"), (5, "three", "A2"),  # stale 3 and 4
        (6, None, "A1"), (7, None, "A2"),                              # NULL barcodes form a group: stale 6
        (8, "deadkeeper", "A1"), (9, "deadkeeper", "DEAD"),           # keeper in no available area
        (10, "stuck", "DEAD"), (11, "stuck", "A1"),                    # stale copy in no available area
        (12, "ignored", "BELLY"), (13, "ignored", "A1"),               # stale copy in an ignored location
        (14, "nolocation", None), (15, "nolocation", "A1"), (16, "unknown", "Z9"), (17, "unknown", "A1"),
        (18, "single", "A1"))


def stale(cases, places, **options):
    return duplicates.stale_duplicates(duplicates.duplicate_groups(cases, **places, **options))


def test_stale_copies(cases, places):
    found = stale(cases, places)
    assert rows(found, "DuplicateInventoryId", "CurrentInventoryId", "CurrentLocation", "DuplicateCount") == sorted([
        (1, 2, "SHIPPED", 2), (3, 5, "A2", 3), (4, 5, "A2", 3), (6, 7, "A2", 2), (8, 9, None, 2)], key=repr)
    assert len(found.columns) == 14


def test_group_values(cases, places):
    groups = duplicates.duplicate_groups(cases, **places)
    assert rows(groups.filter("Barcode = 'three'"), "InventoryId", "cnt", "maxinvid", "toploc", "botloc", "live") == [
        (3, 3, 5, "BOTH", "A1", True), (4, 3, 5, "BOTH", "A1", True), (5, 3, 5, "BOTH", "A1", True)]
    assert rows(groups.filter("Barcode = 'stuck'"), "InventoryId", "live") == [(10, False), (11, True)]


def test_null_barcodes_can_be_left_out(cases, places):
    assert (6,) not in rows(stale(cases, places, ignore_null_barcode=True), "DuplicateInventoryId")


def test_plan_and_remediation(spark, cases, places):
    found = stale(cases, places)
    allocations = make(spark, "delivery_allocations", 1, 3, 3, 5, None)
    holds = make(spark, "qa_statuses", ("P1", 4, "HLD", None), ("P1", 9, "HLD", None))
    plan = remediation.remediation_plan(found, allocations, holds)
    assert rows(plan, "step", "action", "target_table", "InventoryId", "n_rows") == sorted([
        (1, "DELETE", "DeliveryAllocations", 1, 1), (1, "DELETE", "DeliveryAllocations", 3, 2),
        (2, "DELETE", "InventoryCasesQAStatuses", 4, 1),
        *[(3, "UPDATE", "InventoryCases", i, 1) for i in (1, 3, 4, 6, 8)]], key=repr)

    assert rows(remediation.apply_plan(allocations, plan, "DeliveryAllocations")) == [(5,), (None,)]
    assert rows(remediation.deleted_children(allocations, found)) == [(1,), (3,), (3,)]
    assert rows(remediation.remediate_hold_statuses(holds, found), "InventoryId") == [(9,)]

    corrected = remediation.apply_plan(cases, plan, "InventoryCases", "2024-06-01 00:00:00")
    assert corrected.columns == cases.columns and corrected.count() == cases.count()
    assert rows(corrected.filter("ModifiedBy = 'DuplicatedJob'"), "InventoryId", "WarehouseLocationId") == sorted(
        [(i, "LVADJ") for i in (1, 3, 4, 6, 8)], key=repr)
    assert rows(stale(corrected, places)) == []


def test_scripts(spark, cases, places):
    plan = remediation.remediation_plan(stale(cases, places), make(spark, "delivery_allocations", 1),
                                        make(spark, "qa_statuses", ("P1", 99, "HLD", None)))
    plants = make(spark, "plants", ("P0", "Elsewhere"), ("P1", "North"))
    scripts = remediation.render_scripts(plan, remediation.plant_name(plants, cases), "DB01")
    assert rows(scripts, "step", "n_ids") == [(1, 1), (3, 5)]
    assert rows(scripts.filter("step = 1"), "script") == [(
        "-- North\n-- DB01\n\nBEGIN TRAN t1\n\nDELETE FROM DeliveryAllocations\nWHERE InventoryId IN (\n    '1'\n)\n\n"
        "-- COMMIT TRAN t1\n-- ROLLBACK TRAN t1",)]
    update = scripts.filter("step = 3").first()["script"]
    assert "'1',\n    '3',\n    '4',\n    '6',\n    '8'\n)" in update
    assert "SET WarehouseLocationId = 'LVADJ'," in update


def test_batches_are_bounded_and_whole(spark):
    ids = spark.range(1000).selectExpr("id % 500 AS id")
    numbered = batched(ids, "id", 40)
    per_batch = {r["batch"]: r["count"] for r in numbered.groupBy("batch").count().collect()}
    assert per_batch == {b: 40 if b < 12 else 20 for b in range(13)}
    assert sorted(r["id"] for r in numbered.collect()) == list(range(500))


def test_in_clause_escapes_quotes(spark):
    assert rows(in_clause(keys(spark, "x", "b", "O'Hara", "b", None), "x")) == [(0, 2, "('O''Hara', 'b')")]


def test_scenario_statuses(spark, cases, places):
    result = scenarios.duplicate_inventory(
        cases, **places, allocations=make(spark, "delivery_allocations", 3, 3),
        qa_statuses=make(spark, "qa_statuses", ("P1", 99, "HLD", None)), reuse=True)
    assert rows(result.statuses, "check", "status", "n_findings") == [
        ("duplicate_inventory", "issues_found", 5), ("remediate_allocations", "issues_found", 2),
        ("remediate_cases", "issues_found", 5), ("remediate_hold_statuses", "ok", 0)]
    assert rows(result.summary, "overall", "issues", "scripts") == [("issues_found", 3, 2)]
