import json

import pytest

from opscheck.operators.results import LISTING_ORDER, RULES, findings, listed, positioned
from opscheck.operators.shipping import missing_allocations
from opscheck.plans.scenarios import SCENARIOS, scenarios_for
from opscheck.sources.sinks import write_findings, write_lines
from opscheck.sources.sites import across_sites, load_all_sites, load_sites
from opscheck.sources.tables import (
    jdbc_options,
    key_predicates,
    load_table,
    range_predicates,
    sample_query,
    sampled_bounds,
)
from tests.fixtures import keys, make, rows


@pytest.fixture
def registry(spark, tmp_path):
    for code, stock in {"A": [("D1", 1)], "B": [("D1", 1), ("D1", 2)]}.items():
        make(spark, "inventory_details", *stock, columns="ExitDeliveryNumber InventoryId").write.parquet(
            str(tmp_path / code / "inventory.parquet"))
        make(spark, "delivery_allocations", *([1] if code == "A" else [5])).write.parquet(
            str(tmp_path / code / "allocations.parquet"))
    path = tmp_path / "sites.json"
    path.write_text(json.dumps({"plants": [
        {"name": "North", "code": "A", "database": str(tmp_path / "A"), "environment": "QA"},
        {"code": "B", "database": str(tmp_path / "B")}]}, indent=2))
    return str(path)


def test_sites_have_defaults(spark, registry):
    north, other = load_sites(spark, registry)
    assert (north.name, north.environment, north.notes) == ("North", "QA", "")
    assert (other.name, other.code, other.environment, other.server) == ("Unnamed Plant", "B", "PROD", "")


def test_an_empty_registry_raises(spark, tmp_path):
    path = tmp_path / "none.json"
    path.write_text('{"plants": []}')
    with pytest.raises(ValueError, match="no sites"):
        load_sites(spark, str(path))


def test_reads_over_sites(spark, registry):
    sites = load_sites(spark, registry)
    assert rows(load_all_sites(spark, sites, "inventory"), "site_code", "InventoryId") == [("A", 1), ("B", 1), ("B", 2)]
    found = across_sites(spark, sites, lambda load: missing_allocations(load("inventory"), load("allocations")))
    assert rows(found, "site_code", "InventoryId") == [("B", 1), ("B", 2)]
    declared = load_table(spark, sites[0], "allocations", role="delivery_allocations")
    assert declared.schema.simpleString() == "struct<InventoryId:bigint>"


def test_jdbc_options(spark, registry):
    site = load_sites(spark, registry)[0]
    options = jdbc_options(site, "shipments", ["shipmentNumber"], partition=("id", 0, 100, 4), fetchsize="1000")
    assert options["dbtable"] == "(SELECT shipmentNumber FROM shipments WITH (READUNCOMMITTED)) AS t"
    assert options["numPartitions"] == "4" and options["fetchsize"] == "1000"
    assert jdbc_options(site, "t", read_uncommitted=False)["dbtable"] == "(SELECT * FROM t) AS t"


def test_options_per_table_reach_the_reader(spark, registry, monkeypatch):
    from opscheck.sources import tables

    seen = []
    monkeypatch.setattr(tables, "load_table", lambda spark, site, table, role=None, **own: seen.append((site.code, table, own)) or spark.range(1))
    sites = load_sites(spark, registry)
    across_sites(spark, sites, lambda load: load("a").unionByName(load("b", fetchsize="5")),
                 {"a": {"partition": ("id", 0, 10, 2)}, "b": {"fetchsize": "1"}})
    assert seen[:2] == [("A", "a", {"partition": ("id", 0, 10, 2)}), ("A", "b", {"fetchsize": "5"})]


@pytest.mark.parametrize("values", [[3, 1, 2, 2], ["b", "a'c", "é"], [], [5]])
def test_predicates_put_every_row_in_one_part(spark, values):
    kind = "STRING" if values and isinstance(values[0], str) else "INT"
    data = [*values, None, *(["", "zz", "a"] if kind == "STRING" else [-7, 99, 4])]
    df = keys(spark, "v", *data, type_=kind)
    for conditions in (range_predicates("v", values), key_predicates("v", values, 2)):
        parts = [df.filter(c).count() for c in conditions]
        assert sum(parts) == len(data) and len(parts) <= len(set(values)) + 1


def test_bounds_follow_the_sample(spark):
    skewed = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS v")
    bounds = sampled_bounds(skewed, "v", 8)
    sizes = [skewed.filter(c).count() for c in range_predicates("v", bounds)]
    assert sum(sizes) == 3000 and len(sizes) >= 6 and sorted(sizes)[-2] <= 800
    assert sampled_bounds(skewed.limit(0), "v", 8) == []
    words = keys(spark, "v", *[f"k{i:03d}" for i in range(100)], type_="STRING")
    assert sampled_bounds(words, "v", 4) == ["k025", "k050", "k075"]
    assert sample_query("t", "id", 2) == "(SELECT id FROM t TABLESAMPLE (2 PERCENT)) AS t"


def test_positions_of_every_listing(spark):
    for check, order in LISTING_ORDER.items():
        names = [c.lstrip("-") for c in order]
        data = [(k % 3, 10 - k, k % 2) for k in range(8)] + [(None, 1, None)]
        df = spark.createDataFrame([(a, b, c) for a, b, c in data], f"{names[0]} INT, x INT, s INT")
        for subject in (None, "s"):
            by_subject = {}
            for r in positioned(df, check, subject).collect():
                by_subject.setdefault(r["s"] if subject else 0, []).append((r["position"], r[names[0]], r["x"]))
            for found in by_subject.values():
                found.sort()
                assert [p for p, _, _ in found] == list(range(1, len(found) + 1))
                values = [v for _, v, _ in found]
                down = order[0].startswith("-")
                key = (lambda v: (v is None, -(v or 0))) if down else (lambda v: (v is not None, v or 0))
                assert values == sorted(values, key=key)


def test_sinks(spark, tmp_path):
    found = findings(spark.createDataFrame([("D1", 2), ("D1", None)], "d STRING, id INT"), "a_check", "d", "id")
    write_findings(found, str(tmp_path / "f"))
    assert rows(spark.read.parquet(str(tmp_path / "f")), "check", "subject", "finding_key", "n_rows") == [
        ("a_check", "D1", "2", 1), ("a_check", "D1", None, 1)]
    write_lines(found, str(tmp_path / "t"))
    assert rows(spark.read.text(str(tmp_path / "t")), "value") == [
        ('D1 | 2 | {"d":"D1","id":2}',), ('D1 | None | {"d":"D1","id":null}',)]


def test_listing_order(spark):
    backlog = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "MessageName STRING, PendingCount INT")
    assert [r[1] for r in listed(backlog, "pending_backlog").collect()] == [3, 2, 1]


def test_scenarios_by_environment_and_unit():
    assert scenarios_for("IWS") == ["message_delay"]
    assert "message_delay" not in scenarios_for("PROD", "Beef/Pork")
    assert scenarios_for("PROD", "Case-Ready") == []
    assert {c for s in SCENARIOS.values() for c in s.checks} <= RULES.keys()


@pytest.mark.parametrize("check, n, status", [
    ("missing_allocations", 0, "ok"), ("missing_allocations", 1, "issues_found"),
    ("missing_trailer", 0, "ok"), ("missing_trailer", 2, "issues_found"),
    ("missing_trailer_capacity", 1, "issues_found"), ("missing_hold_reason", 1, "issues_found"),
    ("failed_transactions", 0, "ok"), ("failed_transactions", 3, "issues_found"),
    ("replenishment_blocked", 1, "issues_found"), ("duplicate_inventory", 1, "issues_found"),
    ("remediate_cases", 0, "ok"), ("remediate_cases", 1, "issues_found"),
    ("missing_shipment", 0, "issues_found"), ("missing_shipment", 1, "ok"),
    ("hot_record", 0, "issues_found"), ("epv_record", 1, "ok"), ("kill_group", 0, "issues_found"),
    ("lot_details", 0, "issues_found"), ("raw_messages", 0, "issues_found"), ("vendor_lookup", 0, "issues_found"),
    ("latest_backtag", 0, "error"), ("latest_backtag", 1, "ok"),
    ("pending_backlog", 24, "ok"), ("pending_backlog", 25, "issues_found")])
def test_status_rules(spark, check, n, status):
    from pyspark.sql import functions as F

    rule = RULES[check]
    row = keys(spark, "n", n, type_="INT").select(rule.status(F.col("n")), rule.headline(F.col("n"))).first()
    assert row[0] == status and str(n) in row[1]
