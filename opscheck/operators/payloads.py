"""Order payloads: delimited header and detail lines in a JSON envelope.

``orders`` holds every order number once; ``lines`` any number of lines per order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from opscheck.fixed_values import (
    DEFAULT_DELIVERY_TIME,
    DEFAULT_GEO_CODE,
    DEFAULT_PRIORITY,
    FIELD_DELIMITER,
    FILE_NAME_PREFIX,
    ORDER_HEADER_FIELDS,
    ORDER_LINE_FIELDS,
)
from opscheck.functions.text import clean, delimited
from opscheck.operators.keyed import complete, probe
from opscheck.operators.ranking import numbered_within
from opscheck.operators.vendors import VENDOR_FIELDS, vendor_lookup

LINE_FIELDS, HEADER_FIELDS = list(ORDER_LINE_FIELDS), list(ORDER_HEADER_FIELDS)


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("OrderNumber").agg(F.count("*").alias("n_lines"))


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``LineNo``, the position of each line in its order by Seq and then its other fields, and the order's ``n_lines``.

    All lines are sorted in ranges, so that an order of any length spreads over as many tasks as it
    fills, whatever its lines have in common.  ``Seq`` is a number; a text would not follow its order.
    """
    if not isinstance(lines.schema["Seq"].dataType, NumericType):
        raise ValueError("Seq has to be a number")
    lines = complete(lines.select("OrderNumber", "Seq", *LINE_FIELDS), "OrderNumber")
    placed = numbered_within(lines, ["OrderNumber"], [F.asc_nulls_first(c) for c in ["Seq", *LINE_FIELDS]], "LineNo",
                             size="n_lines", spread=True)
    return placed.withColumn("LineNo", F.col("LineNo") + 1)


def _detail_text(numbered: DataFrame) -> DataFrame:
    text = delimited(["'D'", "OrderNumber", "format_string('%03d.00', LineNo)", *LINE_FIELDS, "''"], FIELD_DELIMITER)
    return numbered.select("OrderNumber", "LineNo", "n_lines", text.alias("line"))


def order_detail_lines(lines: DataFrame) -> DataFrame:
    """``D`` lines: order number, position as ``001.00``, product, quantity, instructions, minimum sell-by."""
    return _detail_text(number_lines(lines)).drop("n_lines")


def order_header_lines(orders: DataFrame, lines: DataFrame, third_parties: DataFrame) -> DataFrame:
    """``H`` lines with the vendor's address and the number of detail lines; absent fields keep their position."""
    counted = probe(vendor_lookup(orders, third_parties), line_counts(lines), "OrderNumber", "left")
    counted = counted.withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    return counted.select("OrderNumber", "FileName", "n_lines", _header_text().alias("line"))


def _header_text() -> Column:
    return delimited([
        "'H'", "OrderNumber", "n_lines", "ThirdPartyId", *VENDOR_FIELDS,
        "ReferenceOrder", f"coalesce(Priority, '{DEFAULT_PRIORITY}')", "OrderType", "Instructions",
        "DeliveryDate", "LoadDate", f"coalesce(DeliveryTime, '{DEFAULT_DELIVERY_TIME}')",
        f"coalesce(GeoCode, '{DEFAULT_GEO_CODE}')", "OrderNumber", "WarehouseCode", "ShipTo",
        "PlantCode", "SenderId", "ReceiverId", "''",
    ], FIELD_DELIMITER)


def _json_items(texts: Column) -> Column:
    """The JSON list of some texts without its brackets."""
    document = F.to_json(texts)
    return F.substring(document, F.lit(2), F.length(document) - 2)


def order_payloads(orders: DataFrame, lines: DataFrame, third_parties: DataFrame,
                   part_lines: int = 10_000) -> DataFrame:
    """The JSON text ``{FileName, FileLines: [H, D ...], ExtraInfo: null}`` of every order with lines.

    Every order comes in ``n_parts`` rows of up to ``part_lines`` lines whose texts, joined by ``part``, are the
    JSON text, so that no task has to hold a whole order of any length.
    """
    details = _detail_text(number_lines(lines)).withColumn("part", F.floor((F.col("LineNo") - 1) / part_lines))
    bodies = (details.groupBy("OrderNumber", "part", "n_lines")
              .agg(F.sort_array(F.collect_list(F.struct("LineNo", "line"))).alias("parts"))
              .select("OrderNumber", "part", "n_lines", _json_items(F.col("parts.line")).alias("body")))
    headers = vendor_lookup(orders, third_parties)
    n_parts = F.ceil(F.col("n_lines") / part_lines)
    joined = probe(bodies, headers.drop("part", "n_lines", "body"), "OrderNumber").withColumn("line", _header_text())
    opening = F.concat(F.lit('{"FileName":'), _json_items(F.array(clean(F.col("FileName")))),
                       F.lit(',"FileLines":['), _json_items(F.array("line")))
    text = F.concat(F.when(F.col("part") == 0, opening).otherwise(F.lit("")), F.lit(","), F.col("body"),
                    F.when(F.col("part") == n_parts - 1, F.lit('],"ExtraInfo":null}')).otherwise(F.lit("")))
    return joined.select("OrderNumber", clean(F.col("FileName")).alias("FileName"), "part",
                         n_parts.alias("n_parts"), text.alias("payload"))


def _has_delimiter(fields: list[str]) -> Column:
    return F.expr(" OR ".join(
        f"coalesce(contains(CAST({f} AS STRING), '{FIELD_DELIMITER}'), false)" for f in fields))


def validate_orders(orders: DataFrame, lines: DataFrame, third_parties: DataFrame | None = None) -> DataFrame:
    """Orders with ``reject_reason``, NULL for a valid one.

    The order number and a file name with the required prefix (tested before
    trimming) are needed, as is at least one line.  Fields are not escaped in
    a payload, so a delimiter inside one is a reason too; with ``third_parties``
    the vendor's fields are tested as well.  Orders without a number are rejected
    before the joins, which their common key would make one-sided.
    """
    blank = F.coalesce(clean(F.col("OrderNumber")) == "", F.lit(True))
    unnumbered = orders.filter(blank).select(*orders.columns, F.lit("order number is required").alias("reject_reason"))
    by_order = lines.groupBy("OrderNumber").agg(
        F.count("*").alias("_lines"), F.bool_or(_has_delimiter(LINE_FIELDS)).alias("_delimiter"))
    joined = probe(orders.filter(~blank), by_order, "OrderNumber", "left", unique=True)
    fields = ["OrderNumber", *HEADER_FIELDS]
    if third_parties is not None:
        joined, fields = vendor_lookup(joined, third_parties), fields + VENDOR_FIELDS
    reason = (F.when(~F.coalesce(F.startswith("FileName", F.lit(FILE_NAME_PREFIX)), F.lit(False)),
                     f"file name must begin with {FILE_NAME_PREFIX}")
               .when(F.col("_lines").isNull(), "at least one line is required")
               .when(F.coalesce("_delimiter", F.lit(False)) | _has_delimiter(fields), "field contains delimiter"))
    return joined.select(*orders.columns, reason.alias("reject_reason")).unionByName(unnumbered)


def _configured(codes: DataFrame) -> DataFrame:
    return complete(codes.select("WarehouseCode"), "WarehouseCode").distinct()


def unknown_warehouse_codes(orders: DataFrame, codes: DataFrame) -> DataFrame:
    """Orders whose warehouse code is not among the configured ones."""
    return probe(orders, _configured(codes), "WarehouseCode", "left_anti").select(*orders.columns)


def known_warehouse_codes(orders: DataFrame, codes: DataFrame) -> DataFrame:
    """The orders :func:`unknown_warehouse_codes` leaves out."""
    return probe(orders, _configured(codes), "WarehouseCode", "left_semi").select(*orders.columns)
