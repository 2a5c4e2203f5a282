"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opscheck.llm.collocations import collocations
from opscheck.llm.common import table
from opscheck.llm.decontamination import contaminated
from opscheck.llm.licenses import licensed_files
from opscheck.llm.line_dedup import line_decisions
from opscheck.llm.merkle import manifest, tampered
from opscheck.llm.near_duplicates import near_duplicates
from opscheck.llm.oracles import ORACLES as _ORACLES
from opscheck.llm.pieces import encoded
from opscheck.llm.repeats import repeated_spans
from opscheck.llm.secrets import secret_spans
from opscheck.llm.token_files import token_checksums, write_token_files
from opscheck.llm.toxicity import toxicity_scores
from opscheck.llm.url_filter import judged_urls
from opscheck.llm.vector_search import nearest
from opscheck.session import checkpoint_folder


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and the benchmark item it contains, re-parameterised or not."""
    hits = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "item_id", F.round("share", 6).alias("share"), "n_slots", "reparameterised")


def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_in_class")


def exact_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings that an earlier document has."""
    return repeated_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"),
                        "spans", "n_random")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return judged_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text again."""
    return encoded(table(spark, sf_dir, "documents"))


def fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that go from every document."""
    return line_decisions(table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license of every document, taken as a file of its source, language and hundred.

    The documents have no paths; the first id of a hundred is read as its folder's licence file, and
    the first of a thousand as that of the language.
    """
    name = F.expr("""CASE WHEN doc_id % 1000 = 0 THEN 'LICENSE' WHEN doc_id % 100 = 0 THEN concat(doc_id div 100, '/LICENSE')
                     ELSE concat(doc_id div 100, '/', doc_id, '.txt') END""")
    files = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", name).alias("path"), "text")
    found = licensed_files(files)
    return found.select(F.col("file_id").cast("bigint").alias("doc_id"), "path", "own", F.round("score", 6).alias("score"),
                        "license", "origin")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, number and checksum of every document's ids, read back from the files that were written."""
    path = f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_checksums(spark, path)


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of every language by the score of their loosest cut."""
    return collocations(table(spark, sf_dir, "documents"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, and whether it still holds for the tampered ones."""
    found = manifest(table(spark, sf_dir, "documents"), tampered(), siblings=False)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_decontamination": decontamination,
    "op2_near_duplicates": near_duplicate_classes,
    "op3_exact_repeats": exact_repeats,
    "op4_secrets": secrets,
    "op5_nearest_vectors": nearest_vectors,
    "op6_url_verdicts": url_verdicts,
    "op7_sentence_pieces": sentence_pieces,
    "op8_fuzzy_lines": fuzzy_lines,
    "op9_licenses": license_scan,
    "op10_toxicity": toxicity,
    "op11_token_files": token_files,
    "op12_collocations": phrase_collocations,
    "op13_merkle_manifest": merkle_manifest,
}
ORACLES: dict[str, str] = dict(_ORACLES)
