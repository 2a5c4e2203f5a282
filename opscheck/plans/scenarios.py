"""Groups of checks that answer one question, for one subject or all of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.fixed_values import (
    BACKLOG_THRESHOLD,
    BUSINESS_UNITS,
    IGNORED_LOCATIONS,
    MESSAGING_ENVIRONMENTS,
    SITE_ENVIRONMENTS,
)
from opscheck.functions.text import clean
from opscheck.operators import carcass, duplicates, holds, payloads, queues, remediation, shipping
from opscheck.operators.keyed import probe
from opscheck.operators.replenishment import blocked_counts, replenishment_blocked
from opscheck.operators.results import RULES, check_status, findings, scenario_summary
from opscheck.operators.vendors import vendor_lookup
from opscheck.session import shared


@dataclass(frozen=True)
class Scenario:
    title: str
    checks: tuple[str, ...]
    environments: tuple[str, ...] = SITE_ENVIRONMENTS
    business_units: tuple[str, ...] = BUSINESS_UNITS


@dataclass(frozen=True)
class ScenarioResult:
    findings: DataFrame
    statuses: DataFrame
    summary: DataFrame


SCENARIOS = {
    "load_wont_close": Scenario("Load Won't Close", (
        "missing_shipment", "missing_trailer", "missing_trailer_capacity", "missing_allocations")),
    "inventory_cant_release": Scenario("Inventory Can't Be Released", ("missing_hold_reason",)),
    "message_delay": Scenario("Message Delay", ("pending_backlog",), environments=MESSAGING_ENVIRONMENTS),
    "pallet_wont_replenish": Scenario("Pallet Won't Replenish to Location", ("replenishment_blocked",)),
    "duplicate_inventory": Scenario("Duplicate Inventory", (
        "duplicate_inventory", "remediate_cases", "remediate_allocations", "remediate_hold_statuses")),
    "missing_carcasses": Scenario("Missing Carcasses", ("failed_transactions",)),
    "failed_transactions": Scenario("Failed Transactions", ("failed_transactions",)),
    "carcass_lookup": Scenario("Carcass Lookup", (
        "latest_backtag", "kill_group", "lot_details", "hot_record", "epv_record", "raw_messages")),
    "order_builder": Scenario("Order Builder", ("vendor_lookup", "warehouse_code", "valid_order")),
}


def scenarios_for(environment: str, business_unit: str | None = None) -> list[str]:
    """Scenarios that apply to a site's environment and, if given, to a business unit."""
    return [name for name, s in SCENARIOS.items()
            if environment in s.environments and business_unit in (None, *s.business_units)]


def _result(name: str, found: DataFrame, subjects: DataFrame | None, rules=RULES, **counts) -> ScenarioResult:
    scenario = SCENARIOS[name]
    statuses = check_status(subjects, found, list(scenario.checks), rules)
    return ScenarioResult(found, statuses, _summary(name, statuses, **counts))


def _summary(name: str, statuses: DataFrame, **counts) -> DataFrame:
    scenario = SCENARIOS[name]
    return scenario_summary(statuses, scenario.title, scenario.environments, scenario.business_units, **counts)


def load_wont_close(subjects: DataFrame, stops: DataFrame, shipments: DataFrame, trailers: DataFrame,
                    inventory: DataFrame, allocations: DataFrame) -> ScenarioResult:
    """Why deliveries do not close: four independent checks per delivery (column ``DeliveryNumber``).

    For the shipment check the findings are the shipments found; finding none is the issue.
    """
    parts = [
        findings(shipping.found_shipments(stops, subjects), "missing_shipment",
                 "DeliveryNumber", "ShipmentNumber"),
        findings(shipping.missing_trailer(stops, shipments, subjects), "missing_trailer",
                 "DeliveryNumber", "ShipmentNumber", "n_rows"),
        findings(shipping.missing_trailer_capacity(stops, shipments, trailers, subjects),
                 "missing_trailer_capacity", "DeliveryNumber", "TrailerId", "n_rows"),
        findings(shipping.missing_allocations(inventory, allocations, subjects), "missing_allocations",
                 "DeliveryNumber", "InventoryId"),
    ]
    return _result("load_wont_close", reduce(DataFrame.unionByName, parts),
                   subjects.select(F.col("DeliveryNumber").alias("subject")))


def inventory_cant_release(statuses: DataFrame, reasons: DataFrame) -> ScenarioResult:
    """Holds that block release, for the whole site."""
    found = findings(holds.missing_hold_reason(statuses, reasons), "missing_hold_reason")
    return _result("inventory_cant_release", found, None)


def message_delay(messages: DataFrame, as_of=None, threshold: int = BACKLOG_THRESHOLD,
                  **options) -> ScenarioResult:
    """Backlog of outbound messages on one day; the status counts messages, not names."""
    backlog = queues.pending_backlog(messages, as_of, **options)
    found = findings(backlog, "pending_backlog", key="MessageName", n_rows="PendingCount")
    base = RULES["pending_backlog"]
    rules = RULES | {"pending_backlog": type(base)(base.issue, base.fine, issue_at=threshold)}
    return _result("message_delay", found, None, rules)


def pallet_wont_replenish(pick_faces: DataFrame, inventory: DataFrame, tasks: DataFrame,
                          area_locations: DataFrame, settings: DataFrame,
                          subjects: DataFrame | Sequence[str] | None = None) -> ScenarioResult:
    """Blocked pallets per pick face (column ``LocationId``), for all of them or for those asked for.

    A pick face that is asked for but unknown has no blocked pallet and is ``ok``. Statuses come from counts per
    product, so pick faces that share a product do not multiply its pallets; only the listed findings spell them out.
    """
    tables = (pick_faces, inventory, tasks, area_locations, settings)
    name = "pallet_wont_replenish"
    if subjects is not None and not isinstance(subjects, DataFrame):
        subjects = pick_faces.sparkSession.createDataFrame([(s,) for s in subjects], pick_faces.select("LocationId").schema)
    asked = (pick_faces if subjects is None else subjects).select(F.col("LocationId").alias("subject"))
    found = findings(replenishment_blocked(*tables, subjects=subjects), "replenishment_blocked", "LocationId", "PalletNumber", "n_rows")
    counted = findings(blocked_counts(*tables, subjects=subjects), "replenishment_blocked", "LocationId", n_rows="n_rows")
    statuses = check_status(asked, counted, list(SCENARIOS[name].checks))
    return ScenarioResult(found, statuses, _summary(name, statuses))


def duplicate_inventory(cases: DataFrame, area_locations: DataFrame, areas: DataFrame,
                        allocations: DataFrame, qa_statuses: DataFrame,
                        ignore_locations: Sequence[str] = IGNORED_LOCATIONS,
                        reuse: bool = False) -> ScenarioResult:
    """Stale duplicates and what their remediation touches, for the whole site.

    ``scripts`` in the summary counts the remediation steps that have something to do.
    ``reuse`` computes the stale copies now and keeps them in the checkpoint folder for all outputs.
    """
    groups = duplicates.duplicate_groups(cases, area_locations, areas, ignore_locations)
    stale = duplicates.stale_duplicates(groups)
    stale = shared(stale) if reuse else stale
    plan = remediation.remediation_plan(stale, allocations, qa_statuses)
    check = {1: "remediate_allocations", 2: "remediate_hold_statuses", 3: "remediate_cases"}
    parts = [findings(stale, "duplicate_inventory", key="DuplicateInventoryId")] + [
        findings(plan.filter(F.col("step") == step), name, key="InventoryId", n_rows="n_rows")
        for step, name in check.items()
    ]
    scripts = F.count_if(F.startswith("check", F.lit("remediate_")) & (F.col("status") == "issues_found"))
    return _result("duplicate_inventory", reduce(DataFrame.unionByName, parts), None, scripts=scripts)


def failed_transactions(staging: DataFrame, scenario: str = "failed_transactions", **options) -> ScenarioResult:
    """Failed transactions per poster type; also run as the first step on missing carcasses."""
    found = findings(queues.failed_transactions(staging, **options), "failed_transactions", key="PosterType")
    return _result(scenario, found, None)


def missing_carcasses(staging: DataFrame, **options) -> ScenarioResult:
    return failed_transactions(staging, "missing_carcasses", **options)


def carcass_lookup(subjects: DataFrame, backtag: DataFrame, hot: DataFrame, epv: DataFrame,
                   kill_groups: DataFrame, lots: DataFrame, raw: DataFrame, reuse: bool = False,
                   **options) -> ScenarioResult:
    """All records of the subjects (column ``CarcassId``); the wide records are the findings.

    ``reuse`` computes them now and keeps them in the checkpoint folder.
    ``gate_failed`` in the summary: without a back-tag record, the only possible error here.
    """
    record = carcass.carcass_record(subjects, backtag, hot, epv, kill_groups, lots, raw, **options)
    record = shared(record) if reuse else record
    statuses = carcass.carcass_statuses(record)
    summary = _summary("carcass_lookup", statuses).withColumn("gate_failed", F.col("errors") > 0)
    return ScenarioResult(record, statuses, summary)


@dataclass(frozen=True)
class OrderFiles:
    payloads: DataFrame
    rejects: DataFrame


def order_files(orders: DataFrame, lines: DataFrame, third_parties: DataFrame,
                codes: DataFrame | None = None, reuse: bool = False, **options) -> OrderFiles:
    """Payloads of the valid orders, and the rejected orders with a reason.

    With ``codes`` an order's warehouse has to be one of the configured codes.  Vendors are looked up once;
    ``reuse`` computes the validated orders now and keeps them in the checkpoint folder for both outputs.
    """
    looked_up = vendor_lookup(orders, third_parties)
    checked = payloads.validate_orders(looked_up, lines, third_parties)
    checked = shared(checked) if reuse else checked
    valid = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rejects = checked.filter(F.col("reject_reason").isNotNull())
    if codes is not None:
        unknown = payloads.unknown_warehouse_codes(valid, codes)
        rejects = rejects.unionByName(unknown.withColumn("reject_reason", F.lit("unknown warehouse code")))
        valid = payloads.known_warehouse_codes(valid, codes)
    return OrderFiles(payloads.order_payloads(valid, lines, third_parties, **options),
                      rejects.select(*orders.columns, "reject_reason"))


def order_builder(orders: DataFrame, lines: DataFrame, third_parties: DataFrame, codes: DataFrame,
                  reuse: bool = False) -> ScenarioResult:
    """Whether a payload can be built for every order: its vendor, its warehouse code, and its validation.

    A lookup for which an order names nothing is ``skipped``; an order that is rejected is an ``error``, since no payload
    is built from it. The findings are the orders with all three results. ``reuse`` computes them now and keeps them in
    the checkpoint folder.
    """
    checked = payloads.validate_orders(vendor_lookup(orders, third_parties), lines, third_parties)
    configured = codes.select("WarehouseCode").filter(F.col("WarehouseCode").isNotNull()).distinct()
    record = probe(checked, configured.withColumn("_known", F.lit(True)), "WarehouseCode", "left").select(
        clean(F.col("OrderNumber")).alias("OrderNumber"), "ThirdPartyId", "vendor_found", "WarehouseCode",
        F.coalesce("_known", F.lit(False)).alias("code_known"), "reject_reason")
    record = shared(record) if reuse else record

    def asked(field: str, found: str):
        return (F.when(F.coalesce(clean(F.col(field)), F.lit("")) == "", "skipped")
                 .when(F.col(found), "ok").otherwise("issues_found"))

    states = {
        "vendor_lookup": (asked("ThirdPartyId", "vendor_found"), F.col("vendor_found")),
        "warehouse_code": (asked("WarehouseCode", "code_known"), F.col("code_known")),
        "valid_order": (F.when(F.col("reject_reason").isNull(), "ok").otherwise("error"), F.col("reject_reason").isNotNull()),
    }
    rows = F.array(*[F.struct(F.lit(check).alias("check"), status.alias("status"), n.cast("bigint").alias("n_findings"))
                     for check, (status, n) in states.items()])
    statuses = record.select(F.col("OrderNumber").alias("subject"), F.inline(rows))
    return ScenarioResult(record, statuses, _summary("order_builder", statuses))
