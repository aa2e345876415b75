"""Per-key orders without one task per key.

A hot key may hold a third of all rows. The helpers cut its rows into slots
(ranges of time or of an order number) and treat (key, slot) as the unit of
work; what a slot needs from the slots before it comes from a table with one
row per (key, slot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_previous_slot(df: DataFrame, slot: Column) -> DataFrame:
    """Every row in its own slot (``_own``) and again in the next one, where
    it stands for what came just before. Adds ``_slot`` and ``_own``."""
    return (df.withColumn("_s", slot.cast("long"))
            .withColumn("_slot", F.explode(F.array(F.col("_s"), F.col("_s") + 1)))
            .withColumn("_own", F.col("_slot") == F.col("_s")).drop("_s"))


def carried(df: DataFrame, keys: list[str], last: Column) -> DataFrame:
    """Per (key, slot) the newest non-null ``last`` of the slots before it:
    (keys, _slot, carry). ``last`` is an aggregate over a slot's rows."""
    per_slot = df.groupBy(*keys, "_slot").agg(last.alias("_last"))
    before = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    return per_slot.withColumn("carry", F.last("_last", ignorenulls=True).over(before)).drop("_last")


def join_slots(df: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of its (key, slot) row; null keys meet."""
    cond = F.col("d._slot") == F.col("s._slot")
    for k in keys:
        cond = cond & F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}"))
    extra = [c for c in slots.columns if c not in (*keys, "_slot")]
    return df.alias("d").join(slots.alias("s"), cond, "left").select("d.*", *[f"s.{c}" for c in extra])


def segments(df: DataFrame, key: str, us: str, id_col: str, gap: Column) -> DataFrame:
    """Adds ``_seg``: the time of the first row of the row's segment. A segment
    starts where the row before is at least ``gap`` microseconds older (or
    there is none); a state that such a gap resets is independent between
    segments. ``gap`` is constant per key. Rows without a time are left out.

    Slots are as wide as the gap, so only the first row of a slot can start a
    segment: the starts come from one row per (key, slot)."""
    width = F.greatest(gap, F.lit(1))
    rows = df.filter(F.col(us).isNotNull()).withColumn("_slot", F.floor(F.col(us) / width).cast("long"))
    slots = rows.groupBy(key, "_slot").agg(F.min(us).alias("_first"), F.max(us).alias("_end"), F.max(gap).alias("_gap"))
    order = W.partitionBy(key).orderBy("_slot")
    near = F.lag("_slot").over(order) == F.col("_slot") - 1
    started = F.coalesce(~near, F.lit(True)) | (F.col("_first") - F.lag("_end").over(order) >= F.col("_gap"))
    slots = slots.withColumn("_start", F.when(started, F.col("_first")))
    seg = F.last("_start", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return join_slots(rows, slots.select(key, "_slot", seg.alias("_seg")), [key]).drop("_slot")


def running_counts(df: DataFrame, key: str, order: list[str], slot: Column,
                   counts: dict[str, Column]) -> DataFrame:
    """Adds running sums (this row included) of the integer columns
    ``counts`` per key in ``order``: running sums inside each slot plus the
    totals of the slots before. ``slot`` must not fall along ``order``."""
    rows = df.withColumn("_slot", slot.cast("long"))
    for i, c in enumerate(counts.values()):
        rows = rows.withColumn(f"_v{i}", c.cast("long"))
    before = W.partitionBy(key).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    n = range(len(counts))
    totals = rows.groupBy(key, "_slot").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in n])
    totals = totals.select(key, "_slot", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}")
                                           for i in n])
    inside = W.partitionBy(key, "_slot").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    for i in n:
        rows = rows.withColumn(f"_v{i}", F.sum(f"_v{i}").over(inside))
    out = join_slots(rows, totals, [key])
    for i, name in enumerate(counts):
        out = out.withColumn(name, F.col(f"_v{i}") + F.col(f"_o{i}"))
    return out.drop("_slot", *[f"_v{i}" for i in n], *[f"_o{i}" for i in n])
