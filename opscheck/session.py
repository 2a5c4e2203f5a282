"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LARGEST = "spark.sql.codegen.hugeMethodLimit"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder set before.

    A local session without one gets a temporary folder; on a cluster that is an error, since executors
    could not read what others write to a machine's own folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run within remove their shuffle files at their end; the session's setting is put back.

    For results that are kept elsewhere: nothing reads those files again, and otherwise they fill the disk until the
    driver happens to collect its garbage.
    """
    with _set(spark, _CLEANUP, "true"):
        yield


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Queries that are run within have no generated method above 8000 bytes, which Java would interpret for ever; the session's setting is put back.

    Spark runs a stage with such a method by its operators instead, whose long expressions are in small methods.
    """
    with _set(spark, _LARGEST, "8000"):
        yield


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read from there, so that its lineage ends.

    Unlike a checkpoint the columns are compressed, and later reads take only the columns they need.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(df: DataFrame) -> DataFrame:
    """A result that several outputs read, computed once where a checkpoint folder is configured.

    The folder is the cluster's shared one (``spark.checkpoint.dir``), so the
    result outlives lost executors.  Without a folder nothing could be shared, which is an error.
    """
    spark = df.sparkSession
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise ValueError("set spark.checkpoint.dir to reuse an intermediate result")
    return df.checkpoint()
