"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Findings (or statuses), one directory per check."""
    findings.write.mode(mode).format(fmt).partitionBy("check").save(path)


def write_lines(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Findings as text lines ``subject | key | detail``, one directory per check."""
    line = F.concat_ws(" | ", "subject", F.coalesce("finding_key", F.lit("None")), "detail")
    findings.select("check", line.alias("value")).write.mode(mode).partitionBy("check").text(path)


def write_order_payloads(payloads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Order payloads as Parquet rows; an order's parts, joined by ``part``, are its JSON text.

    All orders are written alike and in one job, whatever their length.
    """
    payloads.write.mode(mode).parquet(path)
