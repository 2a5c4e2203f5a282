import datetime

import pytest

from opscheck.operators import queues
from opscheck.operators.holds import missing_hold_reason
from opscheck.plans import scenarios
from tests.fixtures import at, make, rows


def test_missing_hold_reason(spark):
    statuses = make(
        spark, "qa_statuses",
        ("P", 1, "HLD", None),      # own reason NULL, coded child
        ("P", 2, "HLD", "R"),       # no child
        ("P", 3, "HLD", "R"),       # one NULL and one coded child
        (None, 4, "HLD", "R"),      # NULL plant never matches
        ("P", 5, "REL", None),      # not on hold
        ("P", 6, "HLD", "R"),       # fine
        ("P", 2, "HLD", None))      # listed once
    reasons = make(spark, "qa_status_reasons", ("P", 1, "X"), ("P", 3, None), ("P", 3, "X"), (None, 4, "X"),
                   ("P", 6, "X"))
    assert rows(missing_hold_reason(statuses, reasons)) == [(1,), (2,), (3,), (4,)]


def test_failed_transactions(spark):
    staging = make(
        spark, "master_staging",
        (1, "ShipLoad", -3, "x"), (None, "ShipLoad", -3, "x"), (2, "ShipLoad", 0, "x"), (3, "ShipLoad", -3, ""),
        (4, "ShipLoad", -3, "  "), (5, "ShipLoad", -3, None), (6, "Other", -3, "x"),
        (None, "InventoryStatus", -3, "x"))
    assert rows(queues.failed_transactions(staging), "PosterType", "FailedCount") == [
        ("InventoryStatus", 0), ("ShipLoad", 1)]
    summary = scenarios.failed_transactions(staging)
    assert rows(summary.statuses, "status", "n_findings") == [("issues_found", 2)]
    assert rows(scenarios.missing_carcasses(staging).summary, "scenario", "overall") == [
        ("Missing Carcasses", "issues_found")]


@pytest.mark.parametrize("day", ["2024-01-15", datetime.date(2024, 1, 15)])
def test_pending_backlog_day_and_status(spark, day):
    messages = make(
        spark, "outbound_messages",
        ("A", "NEW", at("2024-01-15T00:00:00")), ("A", "SENT", at("2024-01-15T23:59:59.999999")),
        ("A", "NEW", at("2024-01-14T23:59:59")), ("A", "NEW", at("2024-01-16T00:00:00")),
        ("B", "COMPLETED", at("2024-01-15T10:00:00")), ("B", "ERROR", at("2024-01-15T10:00:00")),
        ("B", None, at("2024-01-15T10:00:00")))
    assert rows(queues.pending_backlog(messages, day)) == [("A", 2)]


@pytest.mark.parametrize("total, status", [(24, "ok"), (25, "issues_found")])
def test_backlog_threshold(spark, total, status):
    messages = make(spark, "outbound_messages", *[
        ("A" if i % 2 else "B", "NEW", at("2024-01-15T08:00:00")) for i in range(total)])
    backlog = queues.pending_backlog(messages, "2024-01-15")
    assert rows(queues.backlog_status(backlog)) == [(total, 2, status)]
    result = scenarios.message_delay(messages, "2024-01-15")
    assert rows(result.statuses, "status", "n_findings") == [(status, total)]
    assert result.findings.count() == 2
    assert rows(scenarios.message_delay(messages, "2024-01-15", threshold=10).statuses, "status") == [("issues_found",)]


def test_backlog_status_of_an_empty_day(spark):
    none = make(spark, "outbound_messages", ("A", "NEW", at("2024-01-15T08:00:00")))
    assert rows(queues.backlog_status(queues.pending_backlog(none, "2023-01-01"))) == [(0, 0, "ok")]


def test_backlog_of_the_current_day(spark):
    from pyspark.sql import functions as F

    from opscheck.operators.queues import pending_backlog

    messages = spark.range(3).select(F.lit("m").alias("MessageName"), F.lit("OPEN").alias("Status"),
                                     (F.current_date() - F.col("id").cast("int")).cast("timestamp_ntz").alias("CreateTime"))
    assert rows(pending_backlog(messages), "PendingCount") == [(1,)]
