import re

import pytest
from pyspark.sql import functions as F

from opscheck.operators import carcass
from opscheck.operators.containment import texts_with_substring
from opscheck.plans import scenarios
from tests.fixtures import at, keys, make, rows


@pytest.fixture
def sources(spark):
    d1, d2 = at("2024-01-01T00:00:00"), at("2024-01-02T00:00:00")
    return dict(
        backtag=make(spark, "backtag", ("full", d1, "OLD", "p", "s", "e"), ("full", d2, "K1", "p", "s", "e2"),
                     ("full", d2, "K1", "p", "s", "e1"), ("nullgroup", None, None, "p", "s", "e"),
                     ("nullgroup", d1, None, "p", "s", "e"), ("nosched", d1, "K2", "p", "s", "e"),
                     ("nolot", d1, "K3", "p", "s", "e"), ("nokg", d1, "K9", "p", "s", "e"),
                     ("blank", d1, "K4", "p", "s", "e")),
        hot=make(spark, "hot", ("full", "L", None, d1, "x", d1), ("full", "R", d1, d1, "x", d1)),
        epv=make(spark, "epv", ("full", "B", "q", "x", d1, "y"), ("full", "A", "q", "x", d1, "y")),
        kill_groups=make(spark, "kill_groups", ("K1", "S1", "p", 5), ("K1", "S1", "p", 4), ("K2", None, "p", 1),
                         ("K3", "S3", "p", 1), ("K4", "", "p", 1)),
        lots=make(spark, "lot_details", ("S1", 10, 9)),
        raw=make(spark, "raw_interface", (1, 0, "EPVService", "id=xfully"), (2, 0, "Other", "full"),
                 (3, 0, "EPVService", "full and full"), (4, 0, "EPVService", None)))


@pytest.fixture
def subjects(spark):
    return keys(spark, "CarcassId", "full", "nullgroup", "nosched", "nolot", "nokg", "blank", "absent", "full")


def test_latest_records(subjects, sources):
    newest = carcass.latest_backtag(subjects.distinct(), sources["backtag"])
    assert rows(newest.filter("CarcassId IN ('full', 'nullgroup')"), "CarcassId", "bt_KillDate", "bt_Eid") == [
        ("full", at("2024-01-02T00:00:00"), "e1"), ("nullgroup", at("2024-01-01T00:00:00"), "e")]
    assert rows(carcass.hot_record(subjects.distinct(), sources["hot"]).filter("hot_found"), "hot_Side") == [("R",)]
    assert rows(carcass.epv_record(subjects.distinct(), sources["epv"]).filter("epv_found"), "epv_Grade") == [("A",)]


def test_statuses_gate_and_skip(subjects, sources):
    statuses = scenarios.carcass_lookup(subjects, **sources).statuses
    table = {(r["subject"], r["check"]): r["status"] for r in statuses.collect()}
    chain = ("latest_backtag", "kill_group", "lot_details")
    assert {s: tuple(table[s, c] for c in chain) for s in {k[0] for k in table}} == {
        "full": ("ok", "ok", "ok"),
        "nullgroup": ("ok", "issues_found", "skipped"),
        "nosched": ("ok", "ok", "skipped"),
        "blank": ("ok", "ok", "skipped"),
        "nolot": ("ok", "ok", "issues_found"),
        "nokg": ("ok", "issues_found", "skipped"),
        "absent": ("error", "skipped", "skipped"),
    }
    independent = ("hot_record", "epv_record", "raw_messages")
    assert tuple(table["full", c] for c in independent) == ("ok",) * 3
    assert tuple(table["absent", c] for c in independent) == ("issues_found",) * 3
    assert len(table) == 7 * 6


def test_summary_and_wide_record(subjects, sources):
    result = scenarios.carcass_lookup(subjects, **sources, reuse=True)
    columns = ("subject", "ran", "clean", "issues", "errors", "skipped", "overall", "gate_failed")
    summary = {r[0]: r[1:] for r in rows(result.summary, *columns)}
    assert summary["full"] == (6, 6, 0, 0, 0, "ok", False)
    assert summary["absent"] == (4, 0, 3, 1, 2, "error", True)
    record = result.findings.filter("CarcassId = 'full'").first()
    assert (record["KillGroupId"], record["kg_HeadCount"], record["lot_ReceivedHeadCount"], record["n_messages"]) == (
        "K1", 4, 9, 2)


def test_raw_messages_modes(spark):
    raw = make(spark, "raw_interface", (1, 0, "EPVService", "a12b"), (2, 0, "EPVService", "x 12 y"),
               (3, 0, "EPVService", "1_2"), (4, 0, "EPVService", "1x2"), (5, 0, "Other", "12"))
    subjects = keys(spark, "CarcassId", "12", "1_2", "", None)
    found = lambda *a, **k: rows(carcass.raw_messages(*a, **k), "CarcassId", "MessageId")
    assert found(subjects, raw) == [("12", 1), ("12", 2), ("1_2", 3)]
    assert found(subjects, raw, mode="token") == [("12", 2)]
    assert found("1_2", raw) == [("1_2", 3)]
    assert found(subjects, raw, mode="like") == [("12", 1), ("12", 2), ("1_2", 3), ("1_2", 4)]
    with pytest.raises(ValueError, match="glob"):
        carcass.raw_messages(subjects, raw, mode="glob")
    assert found("1_2", raw, mode="like") == [("1_2", 3), ("1_2", 4)]


def test_substring_match_equals_brute_force(spark, monkeypatch):
    from opscheck.operators import containment

    monkeypatch.setattr(containment, "_PIECE", 7)
    texts = [(i, ("ab" * i + "é𝄞\n" + "x" * (i % 5) + "abc.*" * (i % 3))) for i in range(30)] + [(99, "")]
    ids = ["a", "ab", "é𝄞", "xxxx", ".*", "c.*a", "bab", "\n", "𝄞\nx", "zz"]
    found = texts_with_substring(keys(spark, "id", *ids), spark.createDataFrame(texts, "n INT, text STRING"),
                                 "id", "text", "n")
    assert rows(found, "id", "n") == sorted(((i, n) for i in ids for n, t in texts if i in t), key=repr)


def test_messages_with_one_id_stay_apart(spark):
    raw = make(spark, "raw_interface", (1, 0, "EPVService", "has ab"), (1, 0, "EPVService", "none"), (2, 0, "EPVService", "ab"),
               (2, 0, "EPVService", "ab"))
    every = rows(carcass.raw_messages(keys(spark, "CarcassId", "ab"), raw), "CarcassId", "MessageId", "Data")
    assert every == rows(carcass.raw_messages("ab", raw), "CarcassId", "MessageId", "Data") and len(every) == 3


def as_regex(pattern):
    return re.compile("(?s)" + "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in pattern))


def test_wildcards_equal_brute_force(spark, monkeypatch):
    from opscheck.operators import containment

    monkeypatch.setattr(containment, "_PIECE", 9)
    texts = [(i, "a\\b%" * (i % 3) + "lot-" + "xy" * (i % 7) + f"{i}é𝄞" * (i % 4)) for i in range(40)] + [(99, ""), (3, "lot-3")]
    ids = ["lot", "l_t%7", "%xyxy%é", "_1é", "a\\b%", "x_x_", "\\", "%", "__", "", "l%t%-%1", "%zz%"]
    found = containment.texts_like(keys(spark, "id", *ids, "lot"), spark.createDataFrame(texts, "n INT, text STRING"), "id", "text", "n")
    literal = [i for i in ids if i.strip("%_")]
    first = {n: t for n, t in reversed(sorted(texts, key=lambda x: x[1]))}
    assert rows(found, "id", "n") == sorted(((i, n) for i in literal for n, t in first.items() if as_regex(i).search(t)), key=repr)


def test_a_text_gives_one_row_per_position(spark):
    """Not one per position and id length: the windows come from one expression, and heads drop most of them."""
    from opscheck.operators import containment

    text = "".join(chr(97 + (i * i) % 26) for i in range(500))
    ids = keys(spark, "id", *["zq" + "x" * n for n in range(1, 30)])
    texts = spark.createDataFrame([(1, text)], "n INT, text STRING")
    found = containment.texts_with_substring(ids, texts, "id", "text", "n")
    assert found.collect() == []
    graph = found._jdf.queryExecution().executedPlan().toString()
    assert graph.count("regexp_extract_all") >= 1
    counts = spark.createDataFrame([(text,)], "t STRING").select(
        F.size(containment._windows(F.col("t"), F.lit(3), F.lit(31)))).first()[0]
    assert counts == 498
