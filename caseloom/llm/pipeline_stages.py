"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame; all but the last give the columns of documents.

Rows keep their columns and, but for the text that line dedup shortens, their values. Null and empty texts are clean and
pass. Rows that are equal in all columns stand or fall together, except that near copies keep one row a class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import jaccard, line_dedup, mixing, packing, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least one half go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filtered(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which nothing else is left."""
    return line_dedup.applied(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of smallest doc_id."""
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.applied(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, byte_bpe())
