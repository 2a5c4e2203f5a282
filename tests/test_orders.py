import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from opscheck.fixed_values import SHIPPING_POINT_FIELD, WAREHOUSE_CODE_FIELD, WAREHOUSE_CODES_SETTING
from opscheck.operators import payloads
from opscheck.operators.settings import warehouse_codes
from opscheck.operators.vendors import vendor_lookup
from opscheck.plans import scenarios
from opscheck.sources.sinks import write_order_payloads
from tests.fixtures import keys, make, rows

KEY = WAREHOUSE_CODES_SETTING


def coded(code, point):
    return {WAREHOUSE_CODE_FIELD: code, SHIPPING_POINT_FIELD: point}


def header(number, file_name, **fields):
    names = ["ThirdPartyId", "ReferenceOrder", "Priority", "OrderType", "Instructions", "DeliveryDate", "LoadDate",
             "DeliveryTime", "GeoCode", "WarehouseCode", "ShipTo", "PlantCode", "SenderId", "ReceiverId"]
    return (number, file_name, *[fields.get(n) for n in names])


@pytest.fixture
def vendors(spark):
    return make(spark, "third_parties", ("V1", "Vendor", "Street", None, "City", "12345", "SD"))


@pytest.fixture
def orders(spark):
    return make(
        spark, "order_headers",
        header("1", "SO1", ThirdPartyId="V1", OrderType=" T ", WarehouseCode="W1", SenderId="S", ReceiverId="R"),
        header("2", " SO2", ThirdPartyId="V9"), header("3", "SO3"), header("4", "SO4", Instructions="a|b"),
        header("5", "SO5", ThirdPartyId="V9", WarehouseCode="W9", Priority="10"), header(" ", "SO6"),
        header("7", "SO7"))


@pytest.fixture
def lines(spark):
    twelve = [("1", i, f"P{i}", "2", None, "01/01/24") for i in range(12, 0, -1)]
    return make(spark, "order_lines", *twelve, ("2", 1, "P", "1", None, None), ("4", 1, "P", "1", None, None),
                ("5", 1, "P", "1", "say \"hi\"", None), (" ", 1, "P", "1", None, None),
                ("7", 1, "P|Q", "1", None, None))


def test_vendor_lookup(spark, vendors):
    found = vendor_lookup(keys(spark, "ThirdPartyId", "V1", "V9", None), vendors)
    assert rows(found, "ThirdPartyId", "VendorName", "Street2", "vendor_found") == sorted([
        ("V1", "Vendor", "", True), ("V9", "", "", False), (None, "", "", False)], key=repr)


def test_payload_of_one_order(orders, lines, vendors):
    payload = payloads.order_payloads(orders.filter("OrderNumber = '1'"), lines, vendors).collect()
    assert len(payload) == 1 and (payload[0]["part"], payload[0]["n_parts"]) == (0, 1)
    expected = {
        "FileName": "SO1",
        "FileLines": ["H|1|12|V1|Vendor|Street||City|12345|SD||50|T||||00:00|000|1|W1|||S|R|"]
        + [f"D|1|{i:03d}.00|P{i}|2||01/01/24|" for i in range(1, 13)],
        "ExtraInfo": None,
    }
    assert payload[0]["payload"] == json.dumps(expected, separators=(",", ":"))
    assert len(expected["FileLines"][0].split("|")) == 25 and len(expected["FileLines"][1].split("|")) == 8


def test_parts_join_to_the_same_text(orders, lines, vendors):
    one = orders.filter("OrderNumber = '1'")
    whole = payloads.order_payloads(one, lines, vendors).first()["payload"]
    parts = payloads.order_payloads(one, lines, vendors, part_lines=5).orderBy("part").collect()
    assert [p["n_parts"] for p in parts] == [3, 3, 3]
    assert "".join(p["payload"] for p in parts) == whole


def test_large_orders_are_numbered_alike(spark):
    lines = spark.sql("""
        SELECT CAST(id % 3 AS STRING) AS OrderNumber, CAST(nullif(id % 50, 7) AS INT) AS Seq,
               CAST(id % 7 AS STRING) AS ProductCode, CAST(nullif(id % 4, 0) AS STRING) AS BaseQty,
               CAST(NULL AS STRING) AS Instructions, CAST(id % 2 AS STRING) AS MinSellBy
        FROM range(3000) UNION ALL
        SELECT '1', 3, 'copy', '1', NULL, NULL FROM range(25000)""")
    order = Window.partitionBy("OrderNumber").orderBy(*[F.asc_nulls_first(c) for c in ["Seq", *payloads.LINE_FIELDS]])
    sorted_ = lines.withColumn("LineNo", F.row_number().over(order).cast("bigint"))
    counted = payloads.number_lines(lines)
    assert rows(sorted_.exceptAll(counted.select(*sorted_.columns))) == []
    assert sorted_.count() == counted.count() == 28000
    assert {r["n_lines"] for r in counted.filter("OrderNumber = '1'").select("n_lines").distinct().collect()} == {26000}
    with pytest.raises(ValueError, match="Seq"):
        payloads.number_lines(lines.withColumn("Seq", F.col("Seq").cast("string")))


def test_equal_lines_of_one_order_spread_over_tasks(spark):
    """An order of 30,000 lines with one Seq and product, a third of them equal in all fields."""
    lines = spark.range(30_000, numPartitions=4).selectExpr(
        "'1' AS OrderNumber", "1 AS Seq", "'P' AS ProductCode", "CASE WHEN id % 3 > 0 THEN CAST(id AS STRING) END AS BaseQty",
        "CAST(NULL AS STRING) AS Instructions", "CAST(NULL AS STRING) AS MinSellBy")
    numbered = payloads.number_lines(lines)
    assert sorted(r["LineNo"] for r in numbered.select("LineNo").collect()) == list(range(1, 30_001))
    plan = payloads.order_detail_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange") <= 6 and "Window" not in plan


def test_validation_order_and_reasons(orders, lines):
    checked = payloads.validate_orders(orders, lines)
    assert rows(checked, "OrderNumber", "reject_reason") == sorted([
        ("1", None), ("2", "file name must begin with SO"), ("3", "at least one line is required"),
        ("4", "field contains delimiter"), ("5", None), (" ", "order number is required"),
        ("7", "field contains delimiter")], key=repr)


def test_a_delimiter_in_a_vendor_field_rejects(spark, orders, lines):
    piped = make(spark, "third_parties", ("V1", "Ven|dor", None, None, None, None, None))
    reasons = dict(rows(payloads.validate_orders(orders, lines, piped), "OrderNumber", "reject_reason"))
    assert (reasons["1"], reasons["5"]) == ("field contains delimiter", None)


def test_order_files_split_valid_and_rejected(spark, orders, lines, vendors, tmp_path):
    settings = make(spark, "settings", (*KEY, json.dumps([coded("W1", "P1")])))
    files = scenarios.order_files(orders, lines, vendors, warehouse_codes(settings))
    assert rows(files.payloads, "OrderNumber") == [("1",)]
    assert ("5", "unknown warehouse code") in rows(files.rejects, "OrderNumber", "reject_reason")
    assert files.rejects.count() == 6

    free = scenarios.order_files(orders, lines, vendors, part_lines=5)
    write_order_payloads(free.payloads, str(tmp_path / "out"))
    texts = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("part").collect():
        texts[r["OrderNumber"]] = texts.get(r["OrderNumber"], "") + r["payload"]
    written = {k: json.loads(v)["FileLines"] for k, v in texts.items()}
    assert written["5"][1] == 'D|5|001.00|P|1|say "hi"||' and len(written["1"]) == 13


def test_orders_without_a_number_are_spread(spark, lines):
    numbers = spark.range(4000).selectExpr("CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN ' ' ELSE CAST(id AS STRING) END AS OrderNumber")
    orders = numbers.select("OrderNumber", F.lit("SO").alias("FileName"), *[F.lit(None).cast("string").alias(c) for c in payloads.HEADER_FIELDS])
    checked = payloads.validate_orders(orders, lines)
    assert checked.count() == 4000
    assert checked.filter("reject_reason = 'order number is required'").count() == 2000
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan


@pytest.mark.parametrize("value, status, codes", [
    (json.dumps([coded("W1", "P1"), coded("W2", None)]), "ok", [("W1", "P1"), ("W2", None)]),
    ("[]", "ok", [(None, None)]), ("", "issues_found", [(None, None)]), (None, "issues_found", [(None, None)]),
    ("[{", "error", [(None, None)]), ('{"a":1}', "error", [(None, None)])])
def test_warehouse_codes(spark, value, status, codes):
    settings = make(spark, "settings", (*KEY, value), ("Else", KEY[1], "[]"))
    found = warehouse_codes(settings)
    assert rows(found, "WarehouseCode", "ShippingPoint") == sorted(codes, key=repr)
    assert {r["status"] for r in found.collect()} == {status}


def test_warehouse_codes_without_setting(spark):
    assert rows(warehouse_codes(make(spark, "settings", ("a", "b", "c")))) == []


def test_statuses_of_code_settings(spark):
    from opscheck.operators.settings import warehouse_code_statuses

    values = {"read": json.dumps([coded("W1", "P1"), coded("W2", "P")]), "empty": "[]", "blank": "", "null": None, "broken": "[{"}
    settings = spark.createDataFrame([(site, *KEY, v) for site, v in values.items()],
                                     "site_code STRING, PackageName STRING, Code STRING, Value STRING")
    sites = keys(spark, "site_code", *values, "absent")
    found = rows(warehouse_code_statuses(settings, sites), "subject", "status", "n_findings")
    assert found == sorted([("read", "ok", 2), ("empty", "ok", 0), ("blank", "issues_found", 0), ("null", "issues_found", 0),
                            ("broken", "error", 0), ("absent", "issues_found", 0)], key=repr)
    told = {r["subject"]: r["headline"] for r in warehouse_code_statuses(settings).collect()}
    assert told["read"] == "2 warehouse code(s) read" and "absent" not in told


def test_order_builder_statuses(spark, orders, lines, vendors):
    codes = warehouse_codes(make(spark, "settings", (*KEY, json.dumps([coded("W1", "P1")]))))
    result = scenarios.order_builder(orders, lines, vendors, codes, reuse=True)
    table = {}
    for r in result.statuses.collect():
        table.setdefault(r["subject"], {})[r["check"]] = r["status"]
    assert table["1"] == {"vendor_lookup": "ok", "warehouse_code": "ok", "valid_order": "ok"}
    assert table["5"] == {"vendor_lookup": "issues_found", "warehouse_code": "issues_found", "valid_order": "ok"}
    assert table["3"] == {"vendor_lookup": "skipped", "warehouse_code": "skipped", "valid_order": "error"}
    summary = {r["subject"]: (r["overall"], r["ran"], r["skipped"]) for r in result.summary.collect()}
    assert (summary["1"], summary["3"]) == (("ok", 3, 0), ("error", 1, 2))


def test_vendors_are_looked_up_once(spark, orders, lines, vendors):
    files = scenarios.order_files(orders, lines, vendors)
    plan = files.payloads._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number") == 1
