"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.store import materialise


def large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of each node to its smallest one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.filter(F.col("b") > F.col("a")).join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def small_star(edges: DataFrame) -> DataFrame:
    """Connect the smaller neighbours of each node, and the node, to the
    smallest of them. Edges point from the larger to the smaller node."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"),
                                                                       F.col("m").alias("b"))
    return rest.union(low.select("a", F.col("m").alias("b"))).distinct()


def state(edges: DataFrame) -> tuple:
    """Order-free fingerprint of the edge set, to see that nothing changed."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                    F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b), label the smallest node
    of its component. Self-edges and nulls are dropped; the rounds grow with
    the logarithm of the largest component, each from a written table."""
    e = materialise(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(e)
    while before[0]:
        e = materialise(small_star(large_star(e)), "edges")
        now = state(e)
        if now == before:
            break
        before = now
    # every node but the labels points at its label
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
