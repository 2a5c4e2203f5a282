"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opscheck.session import checkpoint_folder, shuffles_dropped

TOKENIZERS = "/opt/tokenizers"


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` (NULL: empty) only, so that further columns can't clash with an operator's own."""
    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def row_key() -> Column:
    """A 128-bit key of a row's ``doc_id`` and ``text``; repeated rows share it, and with it every result."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("null")), "text")))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's shared checkpoint folder, which outlives lost executors.

    A folder of its own is set only in a local session that has none, as in tests.
    """
    checkpoint_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # a query of its own, made within


def few(df: DataFrame, most: int) -> DataFrame:
    """``df`` as :func:`durable` keeps it, marked to be sent to all tasks if it has at most ``most`` rows."""
    kept = durable(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(rows: DataFrame, function, schema: str) -> DataFrame:
    """``mapInPandas`` that passes ``doc_id`` as text, since pandas turns a number with NULLs into a float."""
    mapped = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        function, schema.replace("doc_id bigint", "doc_id string"))
    return mapped.withColumn("doc_id", F.col("doc_id").cast("bigint"))
