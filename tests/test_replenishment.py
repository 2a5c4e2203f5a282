import pytest

from opscheck.fixed_values import ZONES_SETTING
from opscheck.operators.replenishment import blocked_counts, replenishment_blocked
from opscheck.operators.settings import zone_list
from opscheck.plans import scenarios
from tests.fixtures import at, keys, make, rows

COMMITTED = "Pallet is committed to a delivery"
ACTIVE = "Active directed task already exists for pallet"
STOCK = "PalletNumber DeliveryNumber ProductId WarehouseLocationId"


@pytest.fixture
def tables(spark):
    day1, day2 = at("2024-01-01T00:00:00"), at("2024-01-02T00:00:00")
    stock = [
        ("free", None, 1, "in"), ("tied", None, 1, "in"), ("nullstatus", None, 1, "in"), ("nodate", None, 1, "in"),
        ("elsewhere", None, 1, "in"), ("elsewhere", "D1", 2, "out"), ("outside", "D2", 1, "out"),
        ("twice", None, 1, "in"), ("twice", None, 1, "in"), ("closed", None, 1, "in"), ("other", "D3", 3, "in"),
        (None, "D4", 1, "in")]
    tasks = [
        ("tied", day2, 7), ("tied", day2, 5), ("tied", day1, 5), ("nullstatus", day2, None), ("nodate", None, 5),
        ("elsewhere", day1, 7), ("elsewhere", day1, 7), ("twice", day2, 5), ("twice", day2, 6), ("closed", day1, 5),
        ("closed", day2, 7)]
    return dict(
        pick_faces=make(spark, "pick_faces", ("F1", 1), ("F1", 2), ("F2", 99)),
        inventory=make(spark, "inventory_details", *stock, columns=STOCK),
        tasks=make(spark, "directed_tasks", *tasks),
        area_locations=make(spark, "area_locations", ("in", "W", "A", 3), ("in", "W", "B", 5), ("out", "W", "A", 4)),
        settings=make(spark, "settings", (*ZONES_SETTING, "1, 3 ,5"),
                      (ZONES_SETTING[0], "Other", "4"), ("Else", ZONES_SETTING[1], "4")))


def test_reasons_and_row_counts(tables):
    assert rows(replenishment_blocked(**tables)) == [
        ("F1", "elsewhere", COMMITTED, 2), ("F1", "tied", ACTIVE, 1), ("F1", "twice", ACTIVE, 4)]


def test_rows_are_repeated_on_request(tables):
    listed = rows(replenishment_blocked(**tables, per="row"))
    assert listed == sorted([("F1", "elsewhere", COMMITTED)] * 2 + [("F1", "tied", ACTIVE)]
                            + [("F1", "twice", ACTIVE)] * 4, key=repr)


def test_unknown_pick_face_is_silent(spark, tables):
    assert rows(replenishment_blocked(**tables, subjects=["nowhere"])) == []
    assert rows(replenishment_blocked(**tables, subjects=keys(spark, "LocationId", "F2"))) == []


def test_zone_that_is_no_number_raises(spark):
    settings = make(spark, "settings", (*ZONES_SETTING, "1,x"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        zone_list(settings).collect()


def test_counts_per_pick_face(spark, tables):
    tables["pick_faces"] = make(spark, "pick_faces", ("F1", 1), ("F2", 99), ("F3", 1))
    assert rows(blocked_counts(**tables)) == [("F1", 3, 7), ("F3", 3, 7)]


def test_scenario_statuses(spark, tables):
    statuses = scenarios.pallet_wont_replenish(**tables).statuses
    assert rows(statuses, "subject", "status", "n_findings") == [("F1", "issues_found", 7), ("F2", "ok", 0)]


def test_factors_stand_for_all_pairs(spark, tables):
    from opscheck.operators.replenishment import blocked_factors

    tables["pick_faces"] = make(spark, "pick_faces", ("F1", 1), ("F2", 99), ("F3", 1))
    factors = blocked_factors(**tables)
    assert rows(factors.pairs()) == rows(replenishment_blocked(**tables))
    assert {r["n_faces"] for r in factors.pallets.collect()} == {2} and factors.pallets.count() == 3
    plan = factors.pallets._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FullOuter") == 0


def test_asked_pick_faces_and_unknown_ones(spark, tables):
    for asked in (["F1", "nowhere"], keys(spark, "LocationId", "F1", "nowhere", type_="STRING")):
        result = scenarios.pallet_wont_replenish(**tables, subjects=asked)
        assert rows(result.statuses, "subject", "status", "n_findings") == [("F1", "issues_found", 7), ("nowhere", "ok", 0)]
        assert {r["subject"] for r in result.findings.collect()} == {"F1"}
    assert rows(scenarios.pallet_wont_replenish(**tables, subjects=[]).statuses) == []
