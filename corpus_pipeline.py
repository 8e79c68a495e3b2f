"""From raw documents to training tokens: five stages, each one operator of ``hazardgrid.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents that it keeps, with the columns of ``documents``;
the last one returns tokens.  Nulls, repeated rows and empty tables follow the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardgrid.llm import decontam, personal, pieces, simhash, toxicity
from hazardgrid.llm.common import read_table
from hazardgrid.session import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model learns from all labelled documents."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group at a similarity of 0.8 or more on five-word shingles."""
    return simhash.keep_first(docs, shingle=5, similarity=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark text or a paraphrase of one."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers replaced by their kind and ``n_chars`` brought up to date."""
    masked = personal.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` with the end id, checked against the library."""
    import public_tokenizers
    found = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("sentencepiece", encode),
]

#: SQL can express none of the first three stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
