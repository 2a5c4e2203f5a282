"""Vendor master data for orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.operators.keyed import first_per_key, probe

VENDOR_FIELDS = ["VendorName", "Street1", "Street2", "City", "ZipCode", "StateProvince"]


def vendor_lookup(orders: DataFrame, third_parties: DataFrame) -> DataFrame:
    """Orders with the name and address of their vendor, NULL fields as empty texts.

    ``vendor_found`` tells whether the vendor exists.  Of several rows for one
    id the first by its columns counts.  Orders that have been looked up before are returned as they are.
    """
    if "vendor_found" in orders.columns:
        return orders
    vendors = (first_per_key(third_parties.select("ThirdPartyId", *VENDOR_FIELDS), "ThirdPartyId")
               .withColumn("vendor_found", F.lit(True)))
    found = probe(orders, vendors, "ThirdPartyId", "left")
    return found.select(
        *orders.columns,
        *[F.coalesce(f, F.lit("")).alias(f) for f in VENDOR_FIELDS],
        F.coalesce("vendor_found", F.lit(False)).alias("vendor_found"))
