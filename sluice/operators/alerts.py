"""Alerts: F32 alert_compare, J13 alert_match, W12 alert_cooldown, A6
alert_stats.

W12 is sequential (a match fires only if the rule's last *fired* alert is
at least ``cooldown`` old), but a match that follows the one before it by the
cooldown fires in any case: segments between such gaps are independent and are
folded apart. A segment of more than ``FOLD_ROWS`` matches is not folded by one
task: every match points to the one that would fire next if it fired (the first
at least a cooldown later), and the matches that the segment's first one reaches
are found by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.timeline import segments
from sluice.session import write_table

US = 1_000_000
FOLD_ROWS = 200_000     # matches of a segment that one task folds
OPERATORS = (">=", "<=", "==", "!=", ">", "<")   # parsed longest first


def parse_operator(condition: str) -> str:
    c = condition.strip()
    for op in OPERATORS:
        if c.startswith(op):
            return op
    raise ValueError(f"no comparison operator in {condition!r}")


def alert_compare(value: Column, op: Column, threshold: Column) -> Column:
    """F32: value <op> threshold for > < >= <= == !=."""
    return (F.when(op == ">", value > threshold).when(op == "<", value < threshold)
            .when(op == ">=", value >= threshold).when(op == "<=", value <= threshold)
            .when(op == "==", value == threshold).when(op == "!=", value != threshold)
            .otherwise(F.lit(False)))


RULE_SCHEMA = ("name string, metric string, op string, threshold double, severity string, "
               "cooldown_s long, enabled boolean")


def rules_df(spark, rules: list[dict]) -> DataFrame:
    rows = [(r["name"], r["metric"], parse_operator(r["condition"]) if "condition" in r else r["op"],
             float(r["threshold"]), r.get("severity", "medium"), int(r.get("cooldown_s", 300)),
             bool(r.get("enabled", True))) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def alert_match(samples: DataFrame, rules: DataFrame, metric: str = "metric",
                value: str = "value") -> DataFrame:
    """Enabled rules x samples of their metric, operator applied. The
    rule table is configuration (bounded) and broadcast; the join is an
    equi-join on the metric name."""
    r = F.broadcast(rules.filter("enabled").withColumnRenamed("metric", "_m"))
    j = samples.join(r, samples[metric] == r["_m"]).drop("_m")
    return j.filter(alert_compare(F.col(value), F.col("op"), F.col("threshold")))


def _cooldown_fold(batches):
    segment, last = None, None
    for pdf in batches:
        fired = []
        for name, seg, t, cd in zip(pdf["name"].to_numpy(), pdf["_seg"].to_numpy(),
                                    pdf["_us"].to_numpy(), pdf["cooldown_s"].to_numpy()):
            fired.append((name, seg) != segment or t - last >= int(cd) * US)
            if fired[-1]:
                segment, last = (name, seg), t
        yield pdf.drop(columns=["_us", "_seg"]).assign(fired=fired)


def alert_cooldown(matches: DataFrame, ts: str = "ts", id_col: str = "event_id",
                   fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Keep the matches that fire under the rule's cooldown."""
    d = segments(matches.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))), "name", "_us",
                 id_col, F.col("cooldown_s") * US)
    d = d.select(*matches.columns, "_us", "_seg")
    long = d.groupBy("name", "_seg").count().filter(F.col("count") > fold_rows).drop("count")
    long = write_table(long, "cooldown-long")
    if long.isEmpty():
        return folded(d, matches, id_col)
    short = d.alias("d").join(long.alias("x"), same_segment("d", "x"), "left_anti")
    hot = write_table(d.alias("d").join(long.alias("x"), same_segment("d", "x"), "left_semi")
                      .withColumn("_node", F.monotonically_increasing_id()), "cooldown-hot")
    fired = reached(hot, next_firing(hot, id_col), id_col)
    return (folded(short, matches, id_col)
            .unionByName(hot.join(fired, "_node", "left_semi").select(*matches.columns)))


def same_segment(a: str, b: str) -> Column:
    return F.col(f"{a}.name").eqNullSafe(F.col(f"{b}.name")) & (F.col(f"{a}._seg") == F.col(f"{b}._seg"))


def folded(d: DataFrame, matches: DataFrame, id_col: str) -> DataFrame:
    """The fired matches, each segment folded in order."""
    part = d.repartition("name", "_seg").sortWithinPartitions("name", "_seg", "_us", id_col)
    schema = T.StructType([*matches.schema.fields, T.StructField("fired", T.BooleanType())])
    return part.mapInPandas(_cooldown_fold, schema).filter("fired").drop("fired")


def next_firing(rows: DataFrame, id_col: str) -> DataFrame:
    """(_node, next): the first match of the segment at least a cooldown later.

    Time is cut into slots of one cooldown, so the moment "a cooldown later"
    lies in the next slot: matches and such moments of a slot are read backwards
    together. Where a slot has no match behind the moment, the first match of
    the slots after it counts (one row per slot)."""
    wide = F.greatest(F.col("cooldown_s") * US, F.lit(1))
    slot = F.floor(F.col("_us") / wide)
    me = F.struct(F.col("_us").alias("us"), F.col(id_col).alias("id"), F.col("_node").alias("node"))
    real = rows.select("name", "_seg", slot.alias("_slot"), F.col("_us").alias("at"), F.lit(1).alias("real"),
                       F.col(id_col).alias("id"), F.col("_node").alias("node"), me.alias("me"))
    asks = rows.select("name", "_seg", (slot + 1).alias("_slot"), (F.col("_us") + wide).alias("at"),
                       F.lit(0).alias("real"), F.col(id_col).alias("id"), F.col("_node").alias("node"),
                       F.lit(None).cast(real.schema["me"].dataType).alias("me"))
    back = W.partitionBy("name", "_seg", "_slot").orderBy(F.desc("at"), F.desc("real"), F.desc("id"), F.desc("node"))
    here = (real.unionByName(asks)
            .withColumn("next", F.last("me", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0)))
            .filter("real = 0").select("name", "_seg", "_slot", "node", "next"))
    heads = real.groupBy("name", "_seg", "_slot").agg(F.min("me").alias("head"))
    # moments may lie in slots without a match: they take the head behind, too
    slots = heads.unionByName(here.select("name", "_seg", "_slot").distinct()
                              .withColumn("head", F.lit(None).cast(real.schema["me"].dataType)))
    slots = slots.groupBy("name", "_seg", "_slot").agg(F.min("head").alias("head"))
    behind = W.partitionBy("name", "_seg").orderBy(F.desc("_slot")).rowsBetween(W.unboundedPreceding, -1)
    slots = slots.withColumn("after", F.last("head", ignorenulls=True).over(behind))
    return (here.alias("h").join(slots.alias("s"), same_segment("h", "s") & F.expr("h._slot = s._slot"))
            .select(F.col("h.node").alias("_node"), F.coalesce("h.next", "s.after")["node"].alias("next")))


def reached(rows: DataFrame, pointers: DataFrame, id_col: str) -> DataFrame:
    """(_node) of the matches that the first match of each segment reaches.
    Each round doubles the pointers' length, so a chain of n alerts takes
    log2(n) rounds, each from written tables."""
    jump = write_table(pointers.filter(F.col("next").isNotNull()), "cooldown-jump")
    first = rows.groupBy("name", "_seg").agg(F.min(F.struct("_us", id_col, "_node")).alias("m"))
    found = write_table(first.select(F.col("m._node").alias("_node")), "cooldown-found")
    while not jump.isEmpty():
        # what is 2**k .. 2**(k+1) - 1 steps away: chains do not branch, so nothing comes twice
        found = write_table(found.unionByName(found.join(jump, "_node").select(F.col("next").alias("_node"))),
                            "cooldown-found")
        far = jump.select(F.col("_node").alias("next"), F.col("next").alias("far"))
        jump = write_table(jump.join(far, "next").select("_node", F.col("far").alias("next")), "cooldown-jump")
    return found


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Active (unresolved), total, per severity (ROLLUP; severity null =
    all)."""
    return alerts.rollup("severity").agg(
        F.count("*").alias("total"), F.count_if(~F.col("resolved")).alias("active"))
