"""Records of one tracked unit across its six sources, for one unit or all of them.

``subjects`` holds every unit once, in the column ``CarcassId``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opscheck.fixed_values import MESSAGE_SERVICE
from opscheck.operators.containment import texts_like, texts_with_substring, texts_with_token
from opscheck.operators.keyed import first_per_key, probe

BACKTAG_FIELDS = ["KillDate", "KillGroupId", "PurchaseGroup", "CpsTransferStatus", "Eid"]
HOT_FIELDS = ["Side", "KillDate", "BackTagKillDate", "ApprovedBy", "ApprovedDate"]
EPV_FIELDS = ["Grade", "QualityProgram", "ApprovedBy", "ApprovedDate", "CpsTransfer"]
KILL_GROUP_FIELDS = ["ScheduleGroup", "PurchaseGroup", "HeadCount"]
LOT_FIELDS = ["ScheduledHeadCount", "ReceivedHeadCount"]


def _attach(left: DataFrame, right: DataFrame, key: str, order: list[Column], prefix: str,
            unique: bool = False) -> DataFrame:
    """Left-join the first record per key, prefixed, with a ``<prefix>_found`` flag."""
    record = first_per_key(right, key, order)
    record = record.withColumnsRenamed({
        c: f"{prefix}_{c}" for c in record.columns if c != key
    }).withColumn(f"{prefix}_found", F.lit(True))
    return (probe(left, record, key, "left", unique=unique)
            .withColumn(f"{prefix}_found", F.coalesce(f"{prefix}_found", F.lit(False))))


def latest_backtag(subjects: DataFrame, backtag: DataFrame) -> DataFrame:
    """Newest back-tag record per subject; NULL dates come last, ties go by the other columns."""
    return _attach(subjects, backtag.select("CarcassId", *BACKTAG_FIELDS),
                   "CarcassId", [F.desc_nulls_last("KillDate")], "bt", unique=True)


def hot_record(subjects: DataFrame, hot: DataFrame) -> DataFrame:
    """Newest hot-line record per subject, found by its back-tag id."""
    records = hot.select(F.col("BackTagCarcassId").alias("CarcassId"), *HOT_FIELDS)
    return _attach(subjects, records, "CarcassId", [F.desc_nulls_last("KillDate")], "hot", unique=True)


def epv_record(subjects: DataFrame, epv: DataFrame) -> DataFrame:
    """One grading record per subject: the first by its columns in ascending order."""
    return _attach(subjects, epv.select("CarcassId", *EPV_FIELDS), "CarcassId", [], "epv", unique=True)


def kill_group(chain: DataFrame, kill_groups: DataFrame) -> DataFrame:
    """Add the kill group of each back-tag record; a NULL group id finds none."""
    keyed = chain.withColumnRenamed("bt_KillGroupId", "KillGroupId")
    return _attach(keyed, kill_groups.select("KillGroupId", *KILL_GROUP_FIELDS), "KillGroupId", [], "kg")


def lot_details(chain: DataFrame, lots: DataFrame) -> DataFrame:
    """Add scheduled and received head counts of each kill group's schedule group."""
    keyed = chain.withColumnRenamed("kg_ScheduleGroup", "ScheduleGroup")
    return _attach(keyed, lots.select("ScheduleGroup", *LOT_FIELDS), "ScheduleGroup", [], "lot")


def _service_messages(raw: DataFrame, service: str) -> DataFrame:
    """Messages of one service; ``_message`` tells them apart by all their columns, since ids may repeat."""
    content = F.to_json(F.struct("MessageId", "StatusId", F.md5("Data").alias("digest")))
    return (raw.filter(F.col("ServiceId") == service)
            .select("MessageId", "StatusId", "Data", F.md5(content).alias("_message")))


def message_pairs(subjects: DataFrame, raw: DataFrame, service: str = MESSAGE_SERVICE,
                  mode: str = "substring") -> DataFrame:
    """Distinct pairs (CarcassId, _message) for every message of a service that contains the id.

    ``mode`` is 'substring' (literal containment anywhere), 'like' (``%`` and ``_`` in an id are
    wildcards) or 'token' (whole alphanumeric tokens only, cheaper).
    """
    matches = {"substring": texts_with_substring, "like": texts_like, "token": texts_with_token}
    if mode not in matches:
        raise ValueError(f"mode {mode!r} is none of {sorted(matches)}")
    return matches[mode](subjects, _service_messages(raw, service), "CarcassId", "Data", "_message").distinct()


def raw_messages(subjects: DataFrame | str, raw: DataFrame, service: str = MESSAGE_SERVICE,
                 mode: str = "substring") -> DataFrame:
    """Messages of one service whose payload contains the subject's id.

    A single id given as text becomes a filter of the scan.  With ``mode='like'``
    ``%`` and ``_`` in an id are wildcards.  For a DataFrame of ids see
    :func:`message_pairs`.
    """
    messages = _service_messages(raw, service)
    if isinstance(subjects, str):
        pattern = "%" + subjects.replace("\\", "\\\\") + "%"
        hit = F.col("Data").like(pattern) if mode == "like" else F.col("Data").contains(subjects)
        return messages.filter(hit).select(F.lit(subjects).alias("CarcassId"), "MessageId", "StatusId", "Data")
    return (probe(message_pairs(subjects, raw, service, mode), messages, "_message")
            .select("CarcassId", "MessageId", "StatusId", "Data"))


def carcass_record(subjects: DataFrame, backtag: DataFrame, hot: DataFrame, epv: DataFrame,
                   kill_groups: DataFrame, lots: DataFrame, raw: DataFrame,
                   service: str = MESSAGE_SERVICE, mode: str = "substring") -> DataFrame:
    """One wide row per subject: all fields of the six sources, and the number of raw messages.

    All sources keyed by subject share one partitioning; only the chained kill
    group and lot are shuffled on their own keys.  The messages themselves are rows of :func:`raw_messages`; a subject may have
    any number of them.
    """
    subjects = subjects.select("CarcassId").distinct()
    copies = _service_messages(raw, service).groupBy("_message").agg(F.count("*").alias("n"))
    counts = (probe(message_pairs(subjects, raw, service, mode), copies, "_message")
              .groupBy("CarcassId").agg(F.sum("n").alias("n_messages")))
    wide = epv_record(hot_record(latest_backtag(subjects, backtag), hot), epv)
    wide = (probe(wide, counts, "CarcassId", "left", unique=True)
            .withColumn("n_messages", F.coalesce("n_messages", F.lit(0))))
    return lot_details(kill_group(wide, kill_groups), lots)


def carcass_statuses(record: DataFrame) -> DataFrame:
    """Status per subject and source.

    A missing back-tag record is an ``error`` and skips the chained lookups; a
    kill group without a schedule group skips the lot; the rest are independent.
    """
    def found(flag: Column) -> Column:
        return F.when(flag, "ok").otherwise("issues_found")

    gate = F.col("bt_found")
    has_schedule = F.col("kg_found") & (F.coalesce("ScheduleGroup", F.lit("")) != "")
    statuses = {
        "latest_backtag": F.when(gate, "ok").otherwise("error"),
        "kill_group": F.when(~gate, "skipped").otherwise(found(F.col("kg_found"))),
        "lot_details": F.when(~gate | ~has_schedule, "skipped").otherwise(found(F.col("lot_found"))),
        "hot_record": found(F.col("hot_found")),
        "epv_record": found(F.col("epv_found")),
        "raw_messages": found(F.col("n_messages") > 0),
    }
    counts = {
        "latest_backtag": F.col("bt_found"), "kill_group": F.col("kg_found"),
        "lot_details": F.col("lot_found"), "hot_record": F.col("hot_found"), "epv_record": F.col("epv_found"),
        "raw_messages": F.col("n_messages"),
    }
    rows = F.array(*[
        F.struct(F.lit(check).alias("check"), status.alias("status"),
                 counts[check].cast("bigint").alias("n_findings"))
        for check, status in statuses.items()
    ])
    return record.select(F.col("CarcassId").alias("subject"), F.inline(rows))
