"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column,
                    per_class: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most ``per_class`` documents of each class 0 and 1.

    ``train`` selects label rows. Documents are taken in the order of a hash
    of their id, so reruns agree. The picked ids (bounded by ``per_class``)
    are broadcast to the documents, which are read once and not shuffled; a
    repeated id gives one row, its smallest text.
    """
    known = (labels.filter(train & F.col(label).isin(0, 1))
             .select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).distinct())
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    picked = reduce(DataFrame.unionByName,
                    [known.filter(F.col("y") == c).orderBy(*order).limit(per_class) for c in (0, 1)])
    body = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (body.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
            .select("id", "text", "y"))


def class_sizes(labels: DataFrame, label: str, train: Column) -> tuple[int, int]:
    """Training rows of class 0 and 1."""
    n = {r[0]: r[1] for r in labels.filter(train & F.col(label).isin(0, 1))
         .groupBy(F.col(label).cast("int")).count().collect()}
    return n.get(0, 0), n.get(1, 0)
