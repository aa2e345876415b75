"""Inputs of the registered queries, derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources import tables as tb


def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits corpus: every embedding, with its document's text and metadata
    where there is one."""
    emb = tb.table(spark, sf_dir, "embeddings")
    docs = tb.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), "lang", "source")
    return (emb.join(docs, "vec_id", "left")
            .select(F.col("vec_id").alias("chunk_id"), "embedding", "content", "lang",
                    "source", "label",
                    F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("title")))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: the vectors whose id is divisible by 50, asked against
    all vectors ("more like this")."""
    return tb.table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 50 == 0).select(
        F.col("vec_id").alias("query_id"), "embedding")


def vector_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and title by chunk, for the payload of hits (no vectors)."""
    return tb.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, without texts."""
    return tb.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding")
