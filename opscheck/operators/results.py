"""Findings, check statuses and scenario summaries as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opscheck.fixed_values import BACKLOG_THRESHOLD
from opscheck.functions.text import json_detail
from opscheck.operators.ranking import numbered, numbered_within


@dataclass(frozen=True)
class Rule:
    """How a number of findings becomes a status.

    ``issue_at`` findings or more are an issue; without it, finding nothing is
    the ``none`` status.  The two texts describe either case.
    """
    issue: str
    fine: str
    issue_at: int | None = 1
    none: str = "issues_found"

    def status(self, n: Column) -> Column:
        if self.issue_at is None:
            return F.when(n > 0, "ok").otherwise(self.none)
        return F.when(n >= self.issue_at, "issues_found").otherwise("ok")

    def headline(self, n: Column) -> Column:
        return (F.when(self.status(n) == "ok", F.format_string(self.fine, n))
                 .otherwise(F.format_string(self.issue, n)))


@dataclass(frozen=True)
class StateRule:
    """How the state of a thing read, not a number of findings, becomes a status: each state has a status and a text."""
    states: dict[str, tuple[str, str]]

    def status(self, state: Column) -> Column:
        return self._pick(state, 0)

    def headline(self, state: Column, n: Column) -> Column:
        return F.printf(self._pick(state, 1), n)

    def _pick(self, state: Column, part: int) -> Column:
        column = F.lit(None).cast("string")
        for name, told in self.states.items():
            column = F.when(state == name, told[part]).otherwise(column)
        return column


def state_status(states: DataFrame, check: str, rule: StateRule) -> DataFrame:
    """:func:`check_status` for a check with a :class:`StateRule`; ``states`` has ``subject``, ``state`` and ``n_findings``."""
    state, n = F.col("state"), F.col("n_findings").cast("bigint")
    return states.select(F.lit(check).alias("check"), F.col("subject").cast("string").alias("subject"),
                         rule.status(state).alias("status"), n.alias("n_findings"), rule.headline(state, n).alias("headline"))


def _absence(record: str, none: str = "issues_found") -> Rule:
    return Rule(f"No {record} found (%d)", f"%d {record}(s) found", issue_at=None, none=none)


RULES = {
    "missing_allocations": Rule("%d inventory id(s) without an allocation", "All inventory is allocated (%d)"),
    "missing_shipment": _absence("shipment"),
    "missing_trailer": Rule("%d shipment(s) without a trailer", "No shipment lacks a trailer (%d)"),
    "missing_trailer_capacity": Rule("%d trailer(s) without a capacity", "No trailer lacks a capacity (%d)"),
    "missing_hold_reason": Rule("%d inventory id(s) on hold without a reason", "All holds have a reason (%d)"),
    "failed_transactions": Rule("%d poster type(s) with failed transactions", "No failed transactions (%d)"),
    "pending_backlog": Rule("%d pending message(s), a backlog", "%d pending message(s), below the threshold",
                            issue_at=BACKLOG_THRESHOLD),
    "replenishment_blocked": Rule("%d pallet line(s) blocked", "No blocked pallets (%d)"),
    "duplicate_inventory": Rule("%d stale duplicate(s)", "No stale duplicates (%d)"),
    "remediate_cases": Rule("%d case(s) to adjust", "No cases to adjust (%d)"),
    "remediate_allocations": Rule("%d allocation(s) to delete", "No allocations to delete (%d)"),
    "remediate_hold_statuses": Rule("%d hold status(es) to delete", "No hold statuses to delete (%d)"),
    "latest_backtag": _absence("back-tag record", none="error"),
    "hot_record": _absence("hot-line record"),
    "epv_record": _absence("grading record"),
    "kill_group": _absence("kill group"),
    "lot_details": _absence("lot"),
    "raw_messages": _absence("raw message"),
    "vendor_lookup": _absence("vendor"),
    "warehouse_code": _absence("warehouse code"),
    "valid_order": Rule("%d reason(s) to reject the order", "The order is valid (%d)"),
    "suite_step": Rule("%d record(s) found", "No records found (%d)"),
}


def findings(df: DataFrame, check: str, subject: str | None = None, key: str | None = None,
             n_rows: str | None = None) -> DataFrame:
    """Any check result in the common shape (check, subject, finding_key, detail, n_rows).

    A result without a subject column is about the whole site, subject ``*``.
    """
    key = key or next(c for c in df.columns if c != subject)
    return df.select(
        F.lit(check).alias("check"),
        (F.col(subject).cast("string") if subject else F.lit("*")).alias("subject"),
        F.col(key).cast("string").alias("finding_key"),
        json_detail([c for c in df.columns if c != n_rows]).alias("detail"),
        (F.col(n_rows) if n_rows else F.lit(1)).cast("bigint").alias("n_rows"),
    )


def check_status(subjects: DataFrame | None, found: DataFrame, checks: list[str],
                 rules: dict[str, Rule] = RULES) -> DataFrame:
    """One status per subject and check, including subjects without any finding.

    ``subjects`` has the column ``subject``; None stands for the whole site,
    subject ``*``.  The expected (subject, check) pairs are stacked on the
    findings with a count of zero, so a single aggregate gives all counts.
    """
    spark = found.sparkSession
    if subjects is None:
        subjects = spark.range(1).select(F.lit("*").alias("subject"))
    expected = subjects.select(
        F.col("subject").cast("string"), F.explode(F.array(*[F.lit(c) for c in checks])).alias("check"),
        F.lit(0).cast("bigint").alias("n_rows"), F.lit(True).alias("expected"))
    counted = found.select("subject", "check", "n_rows", F.lit(False).alias("expected"))
    rows = (expected.unionByName(counted).groupBy("subject", "check")
            .agg(F.sum("n_rows").alias("n_findings"), F.bool_or("expected").alias("expected"))
            .filter("expected"))

    def per_rule(pick) -> Column:
        n = F.col("n_findings")
        column = F.lit(None).cast("string")
        for check in checks:
            column = F.when(F.col("check") == check, pick(rules[check], n)).otherwise(column)
        return column

    return rows.select("check", "subject", per_rule(Rule.status).alias("status"), "n_findings",
                       per_rule(Rule.headline).alias("headline"))


def scenario_summary(statuses: DataFrame, scenario: str, environments: tuple[str, ...] = (),
                     business_units: tuple[str, ...] = (), **counts: Column) -> DataFrame:
    """Counts of check outcomes per subject; an error outranks an issue, skipped checks did not run.

    ``counts`` adds further aggregates over the statuses as columns.
    """
    state = F.col("status")
    counted = statuses.groupBy("subject").agg(
        F.count_if(state != "skipped").alias("ran"),
        F.count_if(state == "ok").alias("clean"),
        F.count_if(state == "issues_found").alias("issues"),
        F.count_if(state == "error").alias("errors"),
        F.count_if(state == "skipped").alias("skipped"),
        *[column.alias(name) for name, column in counts.items()])
    overall = (F.when(F.col("errors") > 0, "error").when(F.col("issues") > 0, "issues_found").otherwise("ok"))

    def tags(values: tuple[str, ...]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return counted.select(
        F.lit(scenario).alias("scenario"), "subject", "ran", "clean", "issues", "errors", "skipped",
        overall.alias("overall"), tags(environments).alias("environments"),
        tags(business_units).alias("business_units"), *counts)


# Listing order per check, for reports; operators themselves do not sort.
LISTING_ORDER = {
    "missing_allocations": ["InventoryId"],
    "missing_trailer_capacity": ["ShipmentNumber"],
    "pending_backlog": ["-PendingCount"],
    "replenishment_blocked": ["PalletNumber"],
    "duplicate_inventory": ["ProductionDate"],
    "raw_messages": ["MessageId"],
}


def _listing(check: str) -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in LISTING_ORDER.get(check, [])]


def listed(df: DataFrame, check: str) -> DataFrame:
    """A check result in its customary order; a leading minus means descending."""
    order = _listing(check)
    return df.orderBy(*order) if order else df


def positioned(df: DataFrame, check: str, subject: str | None = None) -> DataFrame:
    """A check result with every row's ``position`` (from 1) in its customary order, of each ``subject`` on its own if named.

    NULL comes first, in a descending order last; equal rows of the order stand by their other columns.  The positions
    come from sorted ranges, so a result of any size is listed without a task that holds all of it.
    """
    first = {c.lstrip("-") for c in LISTING_ORDER.get(check, [])} | {subject}
    order = [*_listing(check), *[F.asc_nulls_first(c) for c in df.columns if c not in first]]
    placed = numbered_within(df, [subject], order, spread=True) if subject else numbered(df, order, spread=True)
    return placed.withColumn("position", F.col("position") + 1)
