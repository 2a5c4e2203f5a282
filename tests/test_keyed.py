"""The join and pick helpers against plain Spark joins."""

import pytest
from pyspark.sql import functions as F

from opscheck.operators.keyed import first_per_key, probe, repeated
from opscheck.roles import under_collation
from tests.fixtures import rows

TYPES = [("BIGINT", "BIGINT"), ("INT", "BIGINT"), ("STRING", "STRING"), ("DECIMAL(18,0)", "DECIMAL(18,0)"),
         ("DOUBLE", "DOUBLE"), ("INT", "DOUBLE"), ("STRING COLLATE UTF8_LCASE", "STRING COLLATE UTF8_LCASE")]


@pytest.mark.parametrize("left_type, right_type", TYPES)
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_probe_equals_a_plain_join(spark, left_type, right_type, how):
    left = spark.sql(f"SELECT CAST(CAST(nullif(id % 5, 3) AS STRING) AS {left_type}) AS k, id AS v FROM range(12)")
    right = spark.sql(f"SELECT CAST(CAST(nullif(id, 3) AS STRING) AS {right_type}) AS k, id * 10 AS w FROM range(1, 5)")
    assert rows(probe(left, right, "k", how)) == rows(left.join(right, "k", how))
    assert rows(probe(left, right, "k", how, unique=True)) == rows(left.join(right, "k", how))


def test_collated_keys_match_regardless_of_case(spark):
    left = spark.sql("SELECT 'AB' COLLATE UTF8_LCASE AS k")
    right = spark.sql("SELECT 'ab' COLLATE UTF8_LCASE AS k, 1 AS w")
    assert probe(left, right, "k").count() == 1


def test_texts_that_are_equal_under_the_case_rule_are_routed_alike(spark):
    """Over all characters: whatever the collation takes as equal must meet in one task."""
    points = spark.createDataFrame(
        [(chr(c),) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000] + [("ΑΣ",), ("ας",), ("ασ",), ("İx",), ("i̇x",)], "t STRING")
    keyed_rows = points.select(F.collate("t", "UTF8_LCASE").alias("k"), F.monotonically_increasing_id().alias("v"))
    firsts = keyed_rows.groupBy("k").agg(F.count("*").alias("n"))
    assert probe(keyed_rows, firsts, "k").count() == points.count()
    assert firsts.count() < points.count()


@pytest.mark.parametrize("collation, n", [("UTF8_LCASE", 2), ("UTF8_LCASE_RTRIM", 3)])
def test_case_rule_for_all_texts_of_a_table(spark, collation, n):
    left = under_collation(spark.createDataFrame([("AB", 1), ("ab ", 2), ("aB", 3), ("c", 4)], "k STRING, v INT"), collation=collation)
    right = under_collation(spark.createDataFrame([("ab", 1)], "k STRING, w INT"), "k", collation=collation)
    assert probe(left, right, "k", "left_semi").count() == n


def test_null_safe_probe_matches_nulls(spark):
    left = spark.sql("SELECT nullif(id, 1) AS k, 'x' AS j, id AS v FROM range(3)")
    right = spark.sql("SELECT nullif(id, 1) AS k, 'x' AS j, id AS w FROM range(2)")
    assert rows(probe(left, right, ["k", "j"], null_safe=True), "v", "w") == [(0, 0), (1, 1)]
    assert rows(probe(left, right, ["k", "j"]), "v", "w") == [(0, 0)]


def test_incomplete_keys_never_match(spark):
    left = spark.sql("SELECT CAST(NULL AS INT) AS k, 1 AS j")
    right = spark.sql("SELECT CAST(NULL AS INT) AS k, 1 AS j, 9 AS w")
    assert rows(probe(left, right, ["k", "j"], "left"), "w") == [(None,)]
    assert probe(left, right, ["k", "j"], "left_anti").count() == 1


def test_first_per_key_breaks_ties_by_all_columns(spark):
    df = spark.createDataFrame([("a", 1, "z"), ("a", 2, "y"), ("a", 2, None), ("b", None, "q"), (None, 5, "q")],
                               "k STRING, n INT, t STRING")
    assert rows(first_per_key(df, "k", [F.desc_nulls_last("n")])) == [("a", 2, None), ("b", None, "q")]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_repeated(spark, block):
    df = spark.createDataFrame([("a", 7), ("b", 1)], "k STRING, n INT")
    assert rows(repeated(df, "n", block=block)) == [("a",)] * 7 + [("b",)]
    assert rows(repeated(df, "n", keep=True, block=block), "k", "copy") == [("a", i) for i in range(1, 8)] + [("b", 1)]
