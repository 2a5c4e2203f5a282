from opscheck.operators import shipping
from tests.fixtures import keys, make, rows

INVENTORY = "ExitDeliveryNumber InventoryId"


def test_missing_allocations_keeps_duplicates_and_null_ids(spark):
    inventory = make(spark, "inventory_details", ("D1", 1), ("D1", 2), ("D1", 2), ("D1", None), ("D2", 3),
                     (None, 9), columns=INVENTORY)
    allocations = make(spark, "delivery_allocations", 1, 1, 4, None)
    assert rows(shipping.missing_allocations(inventory, allocations)) == [
        ("D1", 2), ("D1", 2), ("D1", None), ("D2", 3)]
    assert rows(shipping.missing_allocations(inventory, allocations, ["D2"])) == [("D2", 3)]
    assert rows(shipping.missing_allocations(inventory, allocations, keys(spark, "DeliveryNumber", "D2", "D9"))) == [
        ("D2", 3)]


def test_missing_shipment_by_number_of_shipments(spark):
    stops = make(spark, "shipment_stop_deliveries", ("S1", "D1"), ("S2", "D2"), ("S3", "D2"))
    subjects = keys(spark, "DeliveryNumber", "D0", "D1", "D2")
    assert rows(shipping.missing_shipment(subjects, stops)) == [("D0",)]
    assert rows(shipping.found_shipments(stops, subjects)) == [("D1", "S1"), ("D2", "S2"), ("D2", "S3")]


def test_missing_trailer_tests_falsiness_by_type(spark):
    stops = make(spark, "shipment_stop_deliveries", *[(f"S{i}", "D1") for i in range(1, 5)], ("S1", "D1"))
    shipments = make(spark, "shipments", ("S1", None), ("S2", ""), ("S3", "0"), ("S4", "T4"), ("S1", None))
    assert rows(shipping.missing_trailer(stops, shipments)) == [("D1", "S1", None, 2), ("D1", "S2", "", 1)]
    numeric = shipments.selectExpr("ShipmentNumber", "CAST(CASE WHEN TrailerId = '' THEN '5' ELSE "
                                   "replace(TrailerId, 'T', '') END AS INT) AS TrailerId")
    assert rows(shipping.missing_trailer(stops, numeric)) == [("D1", "S1", None, 2), ("D1", "S3", 0, 1)]


def test_missing_trailer_is_silent_without_shipment(spark):
    stops = make(spark, "shipment_stop_deliveries", ("S9", "D1"))
    assert rows(shipping.missing_trailer(stops, make(spark, "shipments", ("S1", None)))) == []


def test_missing_trailer_capacity(spark):
    stops = make(spark, "shipment_stop_deliveries", *[(f"S{i}", "D1") for i in range(1, 6)], ("S2", "D1"), ("S6", None))
    shipments = make(spark, "shipments", ("S1", "absent"), ("S2", "null"), ("S3", "zero"), ("S4", "ten"), ("S5", None),
                     ("S6", "zero"))
    trailers = make(spark, "trailers", ("null", None), ("zero", 0.0), ("zero", 0.0), ("ten", 10.0))
    assert rows(shipping.missing_trailer_capacity(stops, shipments, trailers)) == [
        ("D1", "S1", "absent", 1), ("D1", "S2", "null", 2), ("D1", "S3", "zero", 2), ("D1", "S5", None, 1)]
