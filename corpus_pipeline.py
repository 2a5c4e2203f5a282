"""A corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, SentencePiece ids.

Every stage takes what its predecessor kept, written as Parquet and read again. The stages but
the last return the columns of ``documents``. A row is dropped only by a decision of a stage: a toxic text, a
near-duplicate beside the one of its class that stays, a text that contains a benchmark item.

Defined results: a NULL text counts as empty and stays NULL until line dedup, which makes it the empty text; a NULL doc_id is
kept like any other; rows that are equal in doc_id and text share every decision, and near-dedup keeps one of them; texts of any
length go through whole; an empty table gives an empty result; further columns are carried along under their own
names, whatever they are called, up to the last stage, which returns columns of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opscheck.llm.common import fresh, row_key, table
from opscheck.llm.decontamination import contaminated
from opscheck.llm.line_dedup import dedup_lines
from opscheck.llm.near_duplicates import near_duplicates
from opscheck.llm.pieces import encoded
from opscheck.llm.toxicity import toxicity_scores
from opscheck.session import checkpoint_folder


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the key of each row in a column of that name; a NULL text is kept as it is."""
    keyed = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))
    return docs.withColumn(key, F.unhex(keyed))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not among ``rejected``."""
    key = fresh(docs, "_key")
    gone = rejected.select(F.col("key").alias(key)).distinct()
    return _keyed(docs, key).join(gone, key, "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic."""
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scores.filter("predicted = 1").select(row_key().alias("key")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the lines that stay; ``n_chars`` follows the text."""
    left = dedup_lines(docs).select(*docs.columns)
    return left.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the one with the smallest doc_id, of several texts with that id the first by key."""
    classes = near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    key = fresh(docs, "_key")
    first = classes.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.key").alias(key))
    return _keyed(docs, key).join(first, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``n_tokens`` of every row, and ``exact``: decoding gave the text again."""
    return encoded(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near-duplicates", near_dedup),
          ("decontamination", decontamination), ("sentence pieces", sentence_pieces)]
#: The stages learn models and compare texts, which SQL cannot say; tests/llm compares them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is kept in the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
