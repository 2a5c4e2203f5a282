"""Kept results."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from opscheck.llm.common import durable
from opscheck.session import stored


def shuffle_files(spark) -> set[Path]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {file for folder in folders for file in Path(str(folder)).rglob("shuffle_*.data")}


@pytest.mark.parametrize("keep", [durable, stored])
def test_kept_results_leave_no_shuffle_files(spark, keep):
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_before = shuffle_files(spark), spark.conf.get(cleanup)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    kept = keep(rows)
    end = time.time() + 10
    while shuffle_files(spark) - before and time.time() < end:  # they are removed in the background
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(cleanup) == set_before
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
