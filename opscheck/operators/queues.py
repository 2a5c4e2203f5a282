"""Checks on transaction and message queues."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.fixed_values import BACKLOG_THRESHOLD, FAIL_STATUS, FINAL_MESSAGE_STATUSES, POSTER_TYPES
from opscheck.functions.predicates import has_text, on_day


def failed_transactions(staging: DataFrame, poster_types: Sequence[str] = POSTER_TYPES,
                        fail_status: int = FAIL_STATUS) -> DataFrame:
    """Failed transactions with a stated reason, counted per poster type."""
    return (staging
            .filter((F.col("TransferStatus") == fail_status)
                    & F.col("PosterType").isin(list(poster_types))
                    & has_text(F.col("FailReason")))
            .groupBy("PosterType").agg(F.count("StagingId").alias("FailedCount")))


def pending_backlog(messages: DataFrame, as_of: str | datetime.date | None = None,
                    done: Sequence[str] = FINAL_MESSAGE_STATUSES) -> DataFrame:
    """Messages of one day that are not final, counted per name.

    A NULL status counts as unknown and is left out.  Without ``as_of`` the day is the session's current one.
    """
    day = as_of or F.current_date()
    return (messages
            .filter(on_day(F.col("CreateTime"), day) & ~F.col("Status").isin(list(done)))
            .groupBy("MessageName").agg(F.count("*").alias("PendingCount")))


def backlog_status(backlog: DataFrame, threshold: int = BACKLOG_THRESHOLD) -> DataFrame:
    """One row: total, number of message names, and status (an issue from the threshold on)."""
    total = backlog.agg(F.coalesce(F.sum("PendingCount"), F.lit(0)).alias("total_pending"),
                        F.count("*").alias("n_names"))
    return total.withColumn(
        "status", F.when(F.col("total_pending") >= threshold, "issues_found").otherwise("ok"))
