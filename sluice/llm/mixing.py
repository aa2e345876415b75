"""Mixing sources to target weights with hash-threshold histograms.

DataFrame operations only. Each document gets a fixed hash of its id; a source
takes its documents below a hash threshold, so membership needs no sort and a
rerun takes the same documents. The two budgets of a source are nested: first
copies up to min(target, source size), second copies beyond it. At most one of
them ends inside the source. Its threshold is found with histograms: sizes are
summed by (source, top hash bits), the bucket in which the budget ends is
found, and only that bucket is refined by the next bits, until the hash is
exhausted. The text is read once; the later passes read (source, hash, size).

A source of any share of the rows is one partial sum per task and histogram
bucket. Only per-source rows go through one task (targets), and at most
2**BITS buckets of a source through one window.

Defined results: null text has size 0; a null source is one source, last in
the order; a null id hashes as the empty string; rows that share an id are
taken together; sources without words have target 0; an empty table gives an
empty mix. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.store import materialise

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
BITS = 12
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2


def id_hash(col: str, seed: str = "mix") -> Column:
    """60-bit hash of an id (first 15 hex digits of an MD5)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source: source_size and target.

    ``share`` of all sizes is dealt by weight (the weights repeat over the
    sources in code point order, null last). A target stops at ``max_copies``
    times its source's size and the excess is dealt again by weight: with the
    sources ordered by stop / weight, those that stop are a prefix, and the
    rest get weight * level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    per = (per.withColumn("place", place).withColumn("weight", w)
           .withColumn("stop", F.col("source_size").cast("double") * max_copies)
           .withColumn("ratio", F.col("stop") / F.col("weight")))
    every = Window.orderBy("ratio", "place")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    after = every.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding,
                                                         Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole).cast("double") * share
    level = ((budget - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    per = per.withColumn("level", level)
    final = F.min(F.when(F.col("ratio") > F.col("level"),
                         F.struct("ratio", "place", "level"))).over(whole)["level"]
    target = F.when(final.isNull() | (F.col("ratio") <= final), F.col("stop")) \
        .otherwise(F.col("weight") * final)
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ``copies`` every document gets and the ``cutoff`` hash up to
    which documents get one more (-1: none)."""
    size = F.col("source_size").cast("double")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / size)).otherwise(0)
    state = (targets.withColumn("copies", copies.cast("bigint"))
             .withColumn("budget", F.col("target") - F.col("copies") * size)
             .withColumn("prefix", F.lit(0).cast("bigint"))
             .withColumn("below", F.lit(0).cast("bigint"))
             .withColumn("bucket_size", F.lit(0).cast("bigint")))
    keep = ["source", "source_size", "target", "copies", "budget"]
    for level in range(1, HASH_BITS // BITS + 1):
        shift = HASH_BITS - BITS * level
        rows = sizes.alias("d").join(state.alias("s"),
                                     F.col("d.source").eqNullSafe(F.col("s.source")))
        if level > 1:       # only the boundary bucket is refined
            rows = rows.filter(F.shiftright("d.hash", shift + BITS) == F.col("s.prefix"))
        hist = (rows.filter(F.col("budget") > 0)
                .groupBy(*[F.col(f"s.{c}").alias(c) for c in keep], F.col("s.below").alias("below"),
                         F.shiftright("d.hash", shift).alias("bucket"))
                .agg(F.sum("size").alias("n")))
        order = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.col("below") + F.sum("n").over(order))
        state = (hist.filter(F.col("upto") > F.col("budget"))
                 .groupBy(*keep)
                 .agg(F.min(F.struct("bucket", "upto", "n")).alias("b"))
                 .select(*keep, F.col("b.bucket").alias("prefix"),
                         (F.col("b.upto") - F.col("b.n")).alias("below"),
                         F.col("b.n").alias("bucket_size")))
    # the hash on which the budget ends is taken if that comes nearer
    over = F.col("below") + F.col("bucket_size") - F.col("budget")
    nearer = over < F.col("budget") - F.col("below")
    cutoff = F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1)
    return state.select("source", cutoff.alias("cutoff"))


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix_plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
             max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source: source_size, target, copies and cutoff, from rows (source,
    size, hash)."""
    targets = materialise(source_targets(sizes, weights, share, max_copies), "mix-targets")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    return materialise(targets.alias("t").join(
        thresholds(sizes, targets).alias("c"),
        F.col("t.source").eqNullSafe(F.col("c.source")), "left").select(
            F.col("t.source").alias("source"), "source_size", "target",
            copies.otherwise(0).cast("bigint").alias("copies"),
            F.coalesce("cutoff", F.lit(-1)).alias("cutoff")), "mix-plan")


def apply_plan(rows: DataFrame, plan: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` of ``rows`` (with source, size and hash; alias d), then
    source_size, target, copies and taken."""
    copies = F.col("p.copies") + (F.col("d.hash") <= F.col("p.cutoff")).cast("bigint")
    return (rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
            .select(*keep, "p.source_size", "p.target", copies.alias("copies"),
                    (copies * F.col("d.size")).alias("taken")))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str,
          *more: Column) -> DataFrame:
    """(id, source, size, hash) of every document, and ``more``."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       word_count(text_col).alias("size"), id_hash(id_col, seed).alias("hash"), *more)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=WEIGHTS, share: float = SHARE,
        max_copies: int = MAX_COPIES, seed: str = "mix") -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies
    and taken (copies * size)."""
    sizes = materialise(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    plan = mix_plan(sizes, weights, share, max_copies)
    return apply_plan(sizes, plan, [F.col("d.id"), F.col("d.size"), F.col("d.source")])


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", seed: str = "mix", **kw) -> DataFrame:
    """The documents of which the mix takes words: their columns, then size,
    source_size, target, copies and taken. The texts are not shuffled.
    Columns of ``docs`` with one of these five names are replaced."""
    new = ["size", "source_size", "target", "copies", "taken"]
    cols = [c for c in docs.columns if c not in new]
    sizes = materialise(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    plan = mix_plan(sizes, **kw)
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    rows = sized(docs, id_col, text_col, source_col, seed, row)
    out = apply_plan(rows, plan, [F.col("d.row"), F.col("d.size")])
    return out.filter(F.col("taken") > 0).select("row.*", *new)
