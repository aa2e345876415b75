"""Corpus pipeline: quality rules, near-duplicate join, substring removal,
benchmark decontamination, mix.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and works on all documents that its predecessor kept. The first four return
the columns of documents: the rules and the decontamination drop documents,
the join keeps one document of each group, the removal cuts repeated passages
out of texts. The last returns the documents of which the mix takes words,
with their size, target and taken words.

Defined results: rows without id are never near duplicates of others and stay
to the end of the join stage; repeated rows (same id, same text) stay once
from there on; extra columns are passed through; empty input gives empty
output of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.decontam import clean_documents
from sluice.llm.mixing import mixed_documents
from sluice.llm.ngram_join import one_per_group
from sluice.llm.oracle import PIPELINE as ORACLE_SQL
from sluice.llm.quality_rules import quality
from sluice.llm.store import materialise
from sluice.llm.substring_dedup import without_repeats
from sluice.session import apply_sql_conf


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near their language."""
    apply_sql_conf(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = quality(docs.select(row, F.col("text"), F.col("lang")), keep=["row"])
    return judged.filter("kept").select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each linked group."""
    apply_sql_conf(spark)
    return one_per_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a text that is all repeats goes."""
    apply_sql_conf(spark)
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark n-gram."""
    apply_sql_conf(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the remaining documents."""
    apply_sql_conf(spark)
    mixed = mixed_documents(docs)
    return mixed.withColumn("target", F.round("target", 6))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
