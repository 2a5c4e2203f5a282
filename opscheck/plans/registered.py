"""The checks on the star-schema test tables: role mappings and one query per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opscheck.fixed_values import (
    SHIPPING_POINT_FIELD,
    WAREHOUSE_CODE_FIELD,
    WAREHOUSE_CODES_SETTING,
    ZONES_SETTING,
)
from opscheck.functions.text import field_lines, padded, row_text
from opscheck.operators import carcass, duplicates, payloads, queues, remediation, results, shipping
from opscheck.operators.batches import in_clause
from opscheck.operators.holds import missing_hold_reason
from opscheck.operators.replenishment import blocked_counts, blocked_factors, replenishment_blocked
from opscheck.operators.settings import warehouse_code_statuses, warehouse_codes
from opscheck.operators.vendors import vendor_lookup
from opscheck.plans import scenarios
from opscheck.plans.suites import run_suite
from opscheck.roles import adapt, under_collation
from opscheck.session import checkpoint_folder
from opscheck.sources.sinks import write_findings, write_order_payloads
from opscheck.sources.sites import Site, across_sites

AS_OF = "2024-01-15"
DONE = ("purchase", "error")
IGNORED_SOURCES = ("src0", "src1", "src2", "src3")
POSTERS = ("click", "error", "purchase")
REMEDIATED_ON = "2024-06-01"
NO_PRIORITY = "4-NOT SPECIFIED"


def _text(column: str):
    return F.col(column).cast("string")


_SCHEMAS: dict[str, StructType] = {}


class Roles:
    """The test tables in the roles of the checks."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A table; its schema is inferred once per process."""
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    # deliveries, shipments, trailers
    def inventory(self):
        return adapt(self.table("orders"), ExitDeliveryNumber="o_custkey", InventoryId="o_orderkey")

    def allocations(self):
        return adapt(self.table("lineitem"), InventoryId="l_orderkey")

    def inventory_in_capitals(self):
        """Text ids in capitals, a third of them the same."""
        key = F.when(F.col("o_orderkey") % 3 == 0, "HOT").otherwise(F.concat(F.lit("LOT É"), _text("o_orderkey")))
        return under_collation(adapt(self.table("orders"), ExitDeliveryNumber="o_custkey", InventoryId=key))

    def allocations_in_lower_case(self):
        return under_collation(adapt(self.table("lineitem").filter("l_linenumber > 3"),
                                     InventoryId=F.concat(F.lit("lot é"), _text("l_orderkey"))))

    def deliveries(self):
        return adapt(self.table("customer"), DeliveryNumber="c_custkey")

    def order_stops(self):
        return adapt(self.table("orders"), DeliveryNumber="o_custkey", ShipmentNumber="o_orderkey")

    def order_shipments(self):
        return adapt(self.table("orders"), ShipmentNumber="o_orderkey",
                     TrailerId=F.nullif(F.col("o_custkey") % 120, F.lit(0)))

    def supplier_trailers(self):
        return adapt(self.table("supplier"), TrailerId="s_suppkey",
                     TrailerCapacity=F.when(F.col("s_acctbal") < 0, 0.0).otherwise(F.col("s_acctbal")))

    # holds
    def statuses(self):
        return adapt(self.table("orders"), PlantCode="o_custkey", InventoryId="o_orderkey",
                     QAStatusCode=F.when(F.col("o_orderstatus") == "P", "HLD").otherwise(F.col("o_orderstatus")),
                     QAReasonCode=F.nullif("o_orderpriority", F.lit(NO_PRIORITY)))

    def reasons(self):
        joined = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return adapt(joined, PlantCode="o_custkey", InventoryId="o_orderkey",
                     QAReasonCode=F.nullif("l_returnflag", F.lit("N")))

    # queues
    def staging(self):
        k = F.get_json_object("props", "$.k").cast("int")
        return adapt(self.table("events"), StagingId="event_id", PosterType="event_type",
                     TransferStatus=F.when(F.col("value") < 5, -3).otherwise(0),
                     FailReason=F.when(k < 50, "").otherwise(F.col("props")))

    def messages(self):
        return adapt(self.table("events"), MessageName="event_type", Status="event_type", CreateTime="ts")

    # replenishment
    def stock(self):
        committed = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)
        return adapt(self.table("lineitem"), PalletNumber="l_orderkey", ProductId="l_partkey",
                     WarehouseLocationId="l_suppkey",
                     DeliveryNumber=F.when(committed, F.col("l_orderkey")))

    def tasks(self):
        return adapt(self.table("lineitem"), PalletNumber="l_orderkey", CreatedDate="l_shipdate",
                     StatusId=F.when(F.col("l_returnflag") == "R", 7).otherwise(1))

    def pick_faces(self):
        return adapt(self.table("part"), LocationId="p_partkey", ProductId="p_partkey")

    def shared_pick_faces(self):
        """Pick faces of which several hold one product."""
        return adapt(self.table("part"), LocationId="p_partkey", ProductId=F.col("p_partkey") - F.col("p_partkey") % 4)

    def asked_pick_faces(self):
        """Every pick face whose number is a supplier's, and as many that do not exist."""
        known = self.table("supplier").select(F.col("s_suppkey").alias("LocationId"))
        return known.unionByName(known.select((-F.col("LocationId")).alias("LocationId")))

    def zoned_locations(self):
        return adapt(self.table("supplier"), LocationId="s_suppkey", ZoneId="s_nationkey")

    def zone_settings(self):
        return self.spark.createDataFrame(
            [(*ZONES_SETTING, "1, 3,5,7")],
            "PackageName STRING, Code STRING, Value STRING")

    # duplicates
    def cases(self):
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
        return adapt(self.table("documents"), InventoryId="doc_id", Barcode=F.md5("text"),
                     WarehouseLocationId="source", PlantCode="lang", ProductId="n_chars", PalletNumber="lang",
                     Weight=F.col("n_chars").cast("double"), ProductionDate=day, CreatedDate=day,
                     CreatedBy="lang", ModifiedDate=F.date_add(day, 1), ModifiedBy="source")

    def area_locations(self):
        number = F.substring("source", 4, 10).cast("int")
        return adapt(self.table("documents").select("source").distinct(), LocationId="source",
                     WarehouseId=F.lit("W1"), AreaId=number % 3)

    def areas(self):
        return adapt(self.area_locations().select("WarehouseId", "AreaId").distinct(),
                     WarehouseId="WarehouseId", AreaId="AreaId",
                     IsAvailable=F.when(F.col("AreaId") == 0, 0).otherwise(1))

    def case_allocations(self):
        return adapt(self.table("labels"), InventoryId="doc_id", Quality="quality")

    def case_holds(self):
        return adapt(self.table("labels"), InventoryId="doc_id", QAStatusCode="toxic")

    def groups(self):
        return duplicates.duplicate_groups(self.cases(), self.area_locations(), self.areas(), IGNORED_SOURCES)

    def stale(self):
        return duplicates.stale_duplicates(self.groups())

    def plan(self):
        return remediation.remediation_plan(self.stale(), self.case_allocations(), self.case_holds())

    # carcasses
    def carcasses(self):
        return adapt(self.table("customer"), CarcassId=_text("c_custkey"))

    def backtag(self):
        return adapt(self.table("orders"), CarcassId=_text("o_custkey"), KillDate="o_orderdate",
                     KillGroupId=F.nullif((F.col("o_orderkey") % 27).cast("int"), F.lit(26)),
                     PurchaseGroup="o_orderpriority", CpsTransferStatus="o_orderstatus", Eid="o_orderkey")

    def hot(self):
        return adapt(self.table("lineitem"), BackTagCarcassId=_text("l_orderkey"), Side="l_returnflag",
                     KillDate="l_shipdate", BackTagKillDate="l_linenumber", ApprovedBy="l_linestatus",
                     ApprovedDate="l_partkey")

    def epv(self):
        return adapt(self.table("labels"), CarcassId=_text("doc_id"), Grade="quality", QualityProgram="toxic",
                     ApprovedBy="quality", ApprovedDate="toxic", CpsTransfer="quality")

    def kill_groups(self):
        return adapt(self.table("nation"), KillGroupId="n_nationkey",
                     ScheduleGroup=F.nullif("n_regionkey", F.lit(4)).cast("string"), PurchaseGroup="n_name",
                     HeadCount="n_nationkey")

    def lots(self):
        return adapt(self.table("region"), ScheduleGroup=F.nullif(_text("r_regionkey"), F.lit("3")),
                     ScheduledHeadCount="r_regionkey", ReceivedHeadCount=F.length("r_name"))

    def raw(self):
        return adapt(self.table("events"), MessageId="event_id", StatusId="user_id", ServiceId="event_type",
                     Data="props")

    def searched_ids(self):
        return adapt(self.table("supplier"), CarcassId=_text("s_suppkey"))

    def searched_patterns(self):
        """Ids with wildcards at the end, in the middle and without any."""
        key, rest = _text("s_suppkey"), F.col("s_suppkey") % 3
        return adapt(self.table("supplier"), CarcassId=F.when(rest == 0, F.concat(F.lit("k%"), key))
                     .when(rest == 1, F.concat(key, F.lit("_"))).otherwise(key))

    # orders
    def order_headers(self):
        key = _text("o_orderkey")
        return adapt(
            self.table("orders"), OrderNumber=key,
            FileName=F.concat(F.when(F.col("o_orderkey") % 11 == 0, " SO").otherwise("SO"), key),
            ThirdPartyId=(F.col("o_custkey") % 120).cast("string"),
            ReferenceOrder=F.nullif(_text("o_custkey"), F.lit("7")), Priority=F.lit(None).cast("string"),
            OrderType="o_orderstatus",
            Instructions=F.when(F.col("o_orderkey") % 13 == 0, "ring|twice").otherwise(F.col("o_orderpriority")),
            DeliveryDate=F.date_format("o_orderdate", "dd/MM/yy"), LoadDate=F.lit(None).cast("string"),
            DeliveryTime=F.lit(None).cast("string"), GeoCode=F.lit(None).cast("string"),
            WarehouseCode=F.concat(F.lit("W"), (F.col("o_custkey") % 30).cast("string")),
            ShipTo=_text("o_custkey"), PlantCode="o_orderstatus",
            SenderId=F.lit("A"), ReceiverId=F.lit("B"))

    def order_lines(self):
        return adapt(self.table("lineitem"), OrderNumber=_text("l_orderkey"), Seq="l_linenumber",
                     ProductCode=_text("l_partkey"), BaseQty=F.col("l_quantity").cast("int").cast("string"),
                     Instructions=F.nullif("l_returnflag", F.lit("N")),
                     MinSellBy=F.date_format("l_shipdate", "dd/MM/yy"))

    def third_parties(self):
        return adapt(self.table("supplier"), ThirdPartyId=_text("s_suppkey"), VendorName="s_name",
                     Street1=F.nullif(_text("s_nationkey"), F.lit("3")), Street2=F.lit(None).cast("string"),
                     City=_text("s_nationkey"), ZipCode=_text("s_suppkey"),
                     StateProvince=F.lit(None).cast("string"))

    def code_settings(self):
        """One site per supplier, with readable, empty, and broken settings."""
        key, nation = _text("s_suppkey"), _text("s_nationkey")
        entry = F.to_json(F.struct(F.concat(F.lit("W"), nation).alias(WAREHOUSE_CODE_FIELD),
                                   F.concat(F.lit("P"), key).alias(SHIPPING_POINT_FIELD)))
        broken = (F.when(F.col("s_suppkey") % 10 == 1, "").when(F.col("s_suppkey") % 10 == 2, '{"a":1}')
                  .when(F.col("s_suppkey") % 10 == 3, "[]").when(F.col("s_suppkey") % 10 == 4, "[{"))
        return adapt(
            self.table("supplier"), site_code="s_name",
            PackageName=F.lit(WAREHOUSE_CODES_SETTING[0]), Code=F.lit(WAREHOUSE_CODES_SETTING[1]),
            Value=F.coalesce(broken, F.concat(F.lit("["), entry, F.lit(","), entry, F.lit("]"))))


def _load_wont_close(r: Roles) -> scenarios.ScenarioResult:
    return scenarios.load_wont_close(r.deliveries(), r.order_stops(), r.order_shipments(),
                                     r.supplier_trailers(), r.inventory(), r.allocations())


def _carcass_lookup(r: Roles) -> scenarios.ScenarioResult:
    return scenarios.carcass_lookup(r.carcasses(), r.backtag(), r.hot(), r.epv(), r.kill_groups(), r.lots(),
                                    r.raw(), service="error")


def _duplicate_inventory(r: Roles) -> scenarios.ScenarioResult:
    return scenarios.duplicate_inventory(r.cases(), r.area_locations(), r.areas(), r.case_allocations(),
                                         r.case_holds(), IGNORED_SOURCES)


def _flat(summary: DataFrame) -> DataFrame:
    """Tags as text, for comparison with other engines."""
    return summary.withColumns({c: F.array_join(c, ",") for c in ("environments", "business_units")})


def delivery_suite(sf_dir: str) -> dict:
    """Two chained load checks as a user would write them."""
    orders, lineitem = f"parquet.`{sf_dir}/orders.parquet`", f"parquet.`{sf_dir}/lineitem.parquet`"
    return {
        "title": "Open orders", "environments": ["PROD"], "business_units": ["Poultry"],
        "queries": [
            {"id": "unallocated", "title": "Orders without lines",
             "sql_blocks": [
                 {"label": "wanted orders",
                  "sql": f"SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderstatus = :status"},
                 {"label": "check",
                  "sql": f"SELECT o_orderkey, o_custkey FROM wanted_orders w WHERE NOT EXISTS "
                         f"(SELECT 1 FROM {lineitem} WHERE l_orderkey = w.o_orderkey)"}],
             "parameters": [{"name": "status", "label": "Status", "default": "P"}],
             "gives": ["O_CUSTKEY"], "creates_temp_tables": ["#wanted_orders"]},
            {"id": "siblings", "title": "Other orders of the same customers",
             "sql_blocks": [{"label": "check",
                             "sql": "SELECT o_orderkey FROM wanted_orders WHERE o_custkey IN "
                                    "(SELECT customers FROM customers)"}],
             "takes": [{"source_query_id": "unallocated", "extracted_key": "O_CUSTKEY",
                        "target_param": "@customers"}],
             "reads_temp_tables": ["#wanted_orders"]},
            {"id": "broken", "title": "A step that fails",
             "sql_blocks": [{"label": "check", "sql": f"SELECT no_such_column FROM {orders}"}]},
            {"id": "after_broken", "title": "Skipped",
             "sql_blocks": [{"label": "check", "sql": "SELECT 1 AS one"}],
             "takes": [{"source_query_id": "broken", "extracted_key": "x", "target_param": "x"}]},
        ],
    }


def _fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = [Site(f"Site {c}", c, "", sf_dir, "PROD", "") for c in ("S1", "S2")]
    return across_sites(spark, sites, lambda load: shipping.missing_allocations(
        adapt(load("orders"), ExitDeliveryNumber="o_custkey", InventoryId="o_orderkey"),
        adapt(load("lineitem"), InventoryId="l_orderkey")))


def _on_roles(build: Callable[[Roles], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Roles(spark, sf_dir))


def _kill_group_chain(r: Roles) -> DataFrame:
    return adapt(r.table("customer"), CarcassId=_text("c_custkey"), bt_KillGroupId="c_nationkey")


def _vendor_statuses(r: Roles) -> DataFrame:
    found = vendor_lookup(r.order_headers().select("OrderNumber", "ThirdPartyId"), r.third_parties())
    return results.check_status(
        r.order_headers().select(F.col("OrderNumber").alias("subject")),
        results.findings(found.filter("vendor_found"), "vendor_lookup", "OrderNumber", "ThirdPartyId"),
        ["vendor_lookup"])


def _replenishment(r: Roles) -> tuple[DataFrame, ...]:
    return r.stock(), r.tasks(), r.zoned_locations(), r.zone_settings()


def _order_builder(r: Roles) -> scenarios.ScenarioResult:
    return scenarios.order_builder(r.order_headers(), r.order_lines(), r.third_parties(),
                                   warehouse_codes(r.code_settings(), by=("site_code",)))


def _sites(r: Roles) -> DataFrame:
    """The sites of the code settings, and one per nation that has none."""
    return r.code_settings().select("site_code").unionByName(adapt(r.table("nation"), site_code="n_name"))


def _written(r: Roles, build: Callable[[str], None]) -> DataFrame:
    """What ``build`` writes to a folder of the shared one, read back."""
    path = f"{checkpoint_folder(r.spark)}/written-{uuid.uuid4().hex}"
    build(path)
    return r.spark.read.parquet(path)


def _document_stops(r: Roles):
    return adapt(r.table("documents"), DeliveryNumber="source", ShipmentNumber="doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _on_roles(build) for name, build in {
    # single checks
    "missing_allocations": lambda r: shipping.missing_allocations(r.inventory(), r.allocations()),
    "missing_allocations_any_case": lambda r: shipping.missing_allocations(
        r.inventory_in_capitals(), r.allocations_in_lower_case()).withColumn("InventoryId", F.collate("InventoryId", "UTF8_BINARY")),
    "missing_shipment": lambda r: shipping.missing_shipment(
        adapt(r.table("documents"), DeliveryNumber="doc_id"),
        adapt(r.table("labels"), DeliveryNumber="doc_id", ShipmentNumber="quality")),
    "found_shipments": lambda r: shipping.found_shipments(r.order_stops(), r.deliveries()),
    "missing_trailer": lambda r: shipping.missing_trailer(
        adapt(r.table("lineitem"), DeliveryNumber="l_suppkey", ShipmentNumber="l_orderkey"),
        adapt(r.table("orders"), ShipmentNumber="o_orderkey",
              TrailerId=F.nullif("o_orderpriority", F.lit(NO_PRIORITY)))),
    "missing_trailer_capacity": lambda r: shipping.missing_trailer_capacity(
        _document_stops(r), adapt(r.table("documents"), ShipmentNumber="doc_id", TrailerId="doc_id"),
        adapt(r.table("labels"), TrailerId="doc_id", TrailerCapacity="quality")),
    "missing_hold_reason": lambda r: missing_hold_reason(r.statuses(), r.reasons()),
    "failed_transactions": lambda r: queues.failed_transactions(r.staging(), POSTERS),
    "pending_backlog": lambda r: queues.pending_backlog(r.messages(), AS_OF, DONE),
    "backlog_status": lambda r: queues.backlog_status(queues.pending_backlog(r.messages(), AS_OF, DONE)),
    "replenishment_blocked": lambda r: replenishment_blocked(
        r.pick_faces(), r.stock(), r.tasks(), r.zoned_locations(), r.zone_settings()),
    "replenishment_blocked_rows": lambda r: replenishment_blocked(
        r.pick_faces(), r.stock(), r.tasks(), r.zoned_locations(), r.zone_settings(), per="row"),
    "blocked_counts": lambda r: blocked_counts(
        r.pick_faces(), r.stock(), r.tasks(), r.zoned_locations(), r.zone_settings()),
    "blocked_pallets": lambda r: blocked_factors(r.shared_pick_faces(), *_replenishment(r)).pallets,
    "blocked_pairs": lambda r: blocked_factors(r.shared_pick_faces(), *_replenishment(r)).pairs(),
    "pick_face_products": lambda r: blocked_factors(r.shared_pick_faces(), *_replenishment(r)).faces,
    # customary order
    "listed_allocations": lambda r: results.positioned(
        shipping.missing_allocations(r.inventory(), r.allocations()), "missing_allocations", "DeliveryNumber"),
    "listed_backlog": lambda r: results.positioned(
        queues.pending_backlog(r.messages(), AS_OF, DONE), "pending_backlog"),
    "listed_duplicates": lambda r: results.positioned(r.stale().select(
        "ProductionDate", "DuplicateInventoryId", "Barcode"), "duplicate_inventory"),
    "listed_messages": lambda r: results.positioned(
        carcass.raw_messages(r.searched_ids(), r.raw(), "error"), "raw_messages", "CarcassId"),
    # duplicates and remediation
    "duplicate_groups": lambda r: r.groups(),
    "stale_duplicates": lambda r: r.stale(),
    "remediation_plan": lambda r: r.plan(),
    "remediate_cases": lambda r: remediation.remediate_cases(r.cases(), r.stale(), REMEDIATED_ON),
    "remediate_allocations": lambda r: remediation.remediate_allocations(r.case_allocations(), r.stale()),
    "deleted_allocations": lambda r: remediation.deleted_children(r.case_allocations(), r.stale()),
    "remediate_hold_statuses": lambda r: remediation.remediate_hold_statuses(r.case_holds(), r.stale()),
    "apply_plan": lambda r: remediation.apply_plan(
        r.case_allocations(), r.plan(), "DeliveryAllocations"),
    "remediation_scripts": lambda r: remediation.render_scripts(
        r.plan(),
        remediation.plant_name(adapt(r.cases(), PlantCode="PlantCode", Description=F.upper("PlantCode")),
                               r.cases()), "DB01", batch=10),
    "in_clause": lambda r: in_clause(QUERIES["missing_allocations"](r.spark, r.sf_dir), "InventoryId", 100),
    # carcass lookup
    "latest_backtag": lambda r: carcass.latest_backtag(r.carcasses(), r.backtag()),
    "hot_record": lambda r: carcass.hot_record(
        adapt(r.table("orders"), CarcassId=_text("o_orderkey")), r.hot()),
    "epv_record": lambda r: carcass.epv_record(
        adapt(r.table("documents"), CarcassId=_text("doc_id")), r.epv()),
    "kill_group": lambda r: carcass.kill_group(_kill_group_chain(r), r.kill_groups()),
    "lot_details": lambda r: carcass.lot_details(
        carcass.kill_group(_kill_group_chain(r), r.kill_groups()), r.lots()),
    "raw_messages": lambda r: carcass.raw_messages(r.searched_ids(), r.raw(), "error"),
    "raw_messages_by_token": lambda r: carcass.raw_messages(r.searched_ids(), r.raw(), "error", "token"),
    "raw_messages_like": lambda r: carcass.raw_messages(r.searched_patterns(), r.raw(), "error", "like"),
    "raw_messages_of_one": lambda r: carcass.raw_messages("7", r.raw(), "error"),
    "carcass_record": lambda r: _carcass_lookup(r).findings,
    "carcass_statuses": lambda r: _carcass_lookup(r).statuses,
    "carcass_summary": lambda r: _flat(_carcass_lookup(r).summary),
    "backtag_lines": lambda r: field_lines(
        carcass.latest_backtag(r.carcasses(), r.backtag()), ["CarcassId"],
        ["bt_KillGroupId", "bt_PurchaseGroup", "bt_CpsTransferStatus", "bt_Eid"]),
    # orders
    "vendor_lookup": lambda r: vendor_lookup(
        r.order_headers().select("OrderNumber", "ThirdPartyId"), r.third_parties()),
    "vendor_statuses": lambda r: _vendor_statuses(r),
    "warehouse_codes": lambda r: warehouse_codes(r.code_settings(), by=("site_code",)),
    "warehouse_code_statuses": lambda r: warehouse_code_statuses(r.code_settings(), _sites(r)),
    "order_header_lines": lambda r: payloads.order_header_lines(
        r.order_headers(), r.order_lines(), r.third_parties()),
    "order_detail_lines": lambda r: payloads.order_detail_lines(r.order_lines()),
    "order_payloads": lambda r: payloads.order_payloads(
        r.order_headers(), r.order_lines(), r.third_parties()),
    "order_payload_parts": lambda r: payloads.order_payloads(
        r.order_headers(), r.order_lines(), r.third_parties(), part_lines=3),
    "validate_orders": lambda r: payloads.validate_orders(r.order_headers(), r.order_lines()).select(
        "OrderNumber", "FileName", "reject_reason"),
    "unknown_warehouse_codes": lambda r: payloads.unknown_warehouse_codes(
        r.order_headers(), warehouse_codes(r.code_settings(), by=("site_code",))).select(
        "OrderNumber", "WarehouseCode"),
    "order_file_rejects": lambda r: scenarios.order_files(
        r.order_headers(), r.order_lines(), r.third_parties(),
        warehouse_codes(r.code_settings(), by=("site_code",))).rejects.select("OrderNumber", "reject_reason"),
    "order_files": lambda r: scenarios.order_files(
        r.order_headers(), r.order_lines(), r.third_parties(),
        warehouse_codes(r.code_settings(), by=("site_code",))).payloads,
    "written_payloads": lambda r: _written(r, lambda path: write_order_payloads(payloads.order_payloads(
        r.order_headers(), r.order_lines(), r.third_parties()), path)),
    "order_builder_statuses": lambda r: _order_builder(r).statuses,
    "order_builder_summary": lambda r: _flat(_order_builder(r).summary),
    # results and scenarios
    "findings": lambda r: results.findings(
        shipping.missing_allocations(r.inventory(), r.allocations()),
        "missing_allocations", "DeliveryNumber", "InventoryId"),
    "written_findings": lambda r: _written(r, lambda path: write_findings(_load_wont_close(r).findings, path)),
    "check_status": lambda r: results.check_status(
        r.deliveries().select(F.col("DeliveryNumber").alias("subject")),
        results.findings(shipping.missing_allocations(r.inventory(), r.allocations()),
                         "missing_allocations", "DeliveryNumber", "InventoryId"), ["missing_allocations"]),
    "blocked_pallet_lines": lambda r: replenishment_blocked(
        r.pick_faces(), r.stock(), r.tasks(), r.zoned_locations(), r.zone_settings()).select(
        "LocationId", F.concat(padded(F.col("PalletNumber"), 20), F.lit(" "), "Reason").alias("line")),
    "stale_lines": lambda r: r.stale().select(
        "DuplicateInventoryId",
        row_text(r.stale(), ["DuplicateInventoryId", "Barcode", "CurrentLocation"]).alias("line")),
    "load_wont_close_findings": lambda r: _load_wont_close(r).findings,
    "load_wont_close_statuses": lambda r: _load_wont_close(r).statuses,
    "load_wont_close_summary": lambda r: _flat(_load_wont_close(r).summary),
    "inventory_cant_release": lambda r: _flat(
        scenarios.inventory_cant_release(r.statuses(), r.reasons()).summary),
    "message_delay": lambda r: scenarios.message_delay(r.messages(), AS_OF, done=DONE).statuses,
    "pallet_wont_replenish": lambda r: _flat(scenarios.pallet_wont_replenish(
        r.pick_faces(), r.stock(), r.tasks(), r.zoned_locations(), r.zone_settings()).summary),
    "pallet_wont_replenish_asked": lambda r: scenarios.pallet_wont_replenish(
        r.pick_faces(), *_replenishment(r), subjects=r.asked_pick_faces()).statuses,
    "duplicate_inventory_findings": lambda r: _duplicate_inventory(r).findings.drop("detail"),
    "duplicate_inventory_summary": lambda r: _flat(_duplicate_inventory(r).summary),
    "missing_carcasses": lambda r: _flat(
        scenarios.missing_carcasses(r.staging(), poster_types=POSTERS).summary),
    "failed_transactions_summary": lambda r: _flat(
        scenarios.failed_transactions(r.staging(), poster_types=POSTERS).summary),
    # suites
    "suite_findings": lambda r: run_suite(r.spark, delivery_suite(r.sf_dir)).findings.select(
        "suite", "title", "check", "finding_key", "detail"),
    "suite_statuses": lambda r: run_suite(r.spark, delivery_suite(r.sf_dir)).statuses.select(
        "check", "status", "n_findings"),
    "suite_summary": lambda r: _flat(run_suite(r.spark, delivery_suite(r.sf_dir)).summary),
}.items()}
QUERIES["fleet_missing_allocations"] = _fleet
