"""Positions from range partitions against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from opscheck.operators.ranking import numbered, numbered_within
from opscheck.session import checkpoint_folder


def rows(n=2000):
    r = random.Random(4)
    return [(r.choice(["a", "a", "a", "b", None, ""]), r.choice([None, *range(300)]), k) for k in range(n)]


def test_global_positions_follow_the_order(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, v int, k int")
    got = numbered(df, [F.asc_nulls_first("v"), F.desc("k")]).orderBy("position").collect()
    assert [x.position for x in got] == list(range(len(data)))
    assert [x.k for x in got] == [x[2] for x in sorted(data, key=lambda x: (x[1] is not None, x[1] or 0, -x[2]))]


def test_positions_within_groups(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, v int, k int")
    got = numbered_within(df, ["g"], [F.asc_nulls_first("v"), F.asc("k")], size="n").collect()
    for group in {x[0] for x in data}:
        mine = sorted((x for x in data if x[0] == group), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        found = sorted((x for x in got if x.g == group), key=lambda x: x.position)
        assert [(x.v, x.k, x.position, x.n) for x in found] == [(x[1], x[2], i, len(mine)) for i, x in enumerate(mine)]


def test_empty_and_equal_rows(spark):
    empty = spark.createDataFrame([], "g string, v int")
    assert numbered(empty, [F.col("v")]).count() == 0
    equal = spark.createDataFrame([("a", 1)] * 50, "g string, v int")
    assert sorted(x.position for x in numbered(equal, [F.col("v")]).collect()) == list(range(50))


def test_equal_rows_spread_over_ranges(spark):
    equal = spark.range(20_000, numPartitions=3).select(F.lit(1).alias("v"))
    placed = numbered(equal, [F.col("v")], spread=True)
    files = placed.groupBy(F.input_file_name()).count().collect()
    assert len(files) == 4 and max(r["count"] for r in files) < 10_000
    assert placed.agg(F.countDistinct("position"), F.max("position")).first()[:] == (20_000, 19_999)


def test_no_task_sorts_the_whole_order(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    plan = numbered_within(df, ["g"], [F.col("v")])._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in plan and "rangepartitioning" not in plan  # the sorted rows are read from the store


def test_folder_of_a_cluster_must_be_set():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        checkpoint_folder(Session())
