"""Tracing: J14 span_pairs, J15 trace_roots, A7 trace_stats, PF15
trace_sample.

J15 follows parent links by pointer doubling: log2(depth) joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import write_table

US = 1_000_000


def span_pairs(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Start x finish by span_id. duration_ms = end - start; a finish
    without a start is dropped; a start without a finish is active; tags are
    merged with the finish winning; logs are appended."""
    s = starts.select("span_id", "trace_id", "parent_span_id", "operation", "start_ts",
                      F.col("tags").alias("s_tags"), F.col("logs").alias("s_logs"))
    f = finishes.select("span_id", "end_ts", "status", F.col("tags").alias("f_tags"),
                        F.col("logs").alias("f_logs"))
    j = s.join(f, "span_id", "left")
    dur = (F.unix_micros(F.col("end_ts").cast("timestamp"))
           - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1000.0
    empty_map = F.create_map().cast("map<string,string>")
    return j.select(
        "span_id", "trace_id", "parent_span_id", "operation", "start_ts", "end_ts",
        F.when(F.col("end_ts").isNotNull(), dur).alias("duration_ms"),
        F.col("end_ts").isNull().alias("active"),
        F.coalesce("status", F.lit("active")).alias("status"),
        # start tags that the finish repeats give way before the maps are joined
        F.map_concat(F.map_filter(F.coalesce("s_tags", empty_map), lambda k, v: ~F.map_contains_key(
            F.coalesce("f_tags", empty_map), k)), F.coalesce("f_tags", empty_map)).alias("tags"),
        F.concat(F.coalesce("s_logs", F.array().cast("array<string>")),
                 F.coalesce("f_logs", F.array().cast("array<string>"))).alias("logs"))


def trace_roots(spans: DataFrame) -> DataFrame:
    """Root span and depth of every span through parent_span_id, as
    (span_id, trace_id, depth, orphan). A span whose parent is not in the
    table is the root of what hangs below it (``orphan``: that root has lost
    its parent). Spans on a cycle have a null root and depth.

    Pointer doubling: each round looks at the ancestor's ancestor, so a chain
    of depth d takes log2(d) joins, each from a written table; there is no
    limit on rows or depth. Only spans that still have an ancestor to look at
    are joined: the others share the null key, which would be one task's.
    """
    child = write_table(spans.select("span_id", "parent_span_id"), "trace-spans")     # read three times
    known = child.select(F.col("span_id").alias("parent_span_id"), F.lit(True).alias("there")).distinct()
    roots = child.filter(F.col("parent_span_id").isNull()).withColumn("there", F.lit(None).cast("boolean"))
    first = (child.filter(F.col("parent_span_id").isNotNull()).join(known, "parent_span_id", "left")
             .select("span_id", "parent_span_id", "there").unionByName(roots)
             .select("span_id", F.when(F.col("there"), F.col("parent_span_id")).alias("up"),
                     F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"),
                     (F.col("parent_span_id").isNotNull() & F.col("there").isNull()).alias("orphan")))
    # up: ancestor 2**round steps above, null once the root is passed;
    # top: the highest span reached so far
    state = write_table(first.withColumn("top", F.coalesce("up", "span_id")), "trace-up")
    left, rounds = state.filter(F.col("up").isNotNull()).count(), 0
    limit = state.count()
    while left and 2 ** rounds <= limit:
        above = state.select(F.col("span_id").alias("up"), F.col("up").alias("up2"),
                             F.col("depth").alias("depth2"), F.col("top").alias("top2"),
                             F.col("orphan").alias("orphan2"))
        climbed = (state.filter(F.col("up").isNotNull()).join(above, "up", "left").select(
            "span_id", F.col("up2").alias("up"),
            (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            F.coalesce("top2", "top").alias("top"),
            F.coalesce("orphan2", "orphan").alias("orphan")))
        state = write_table(state.filter(F.col("up").isNull()).select(*climbed.columns).unionByName(climbed),
                            "trace-up")
        left, rounds = state.filter(F.col("up").isNotNull()).count(), rounds + 1
    done = F.col("up").isNull()
    return state.select("span_id", F.when(done, F.col("top")).alias("trace_id"),
                        F.when(done, F.col("depth")).alias("depth"),
                        F.when(done, F.col("orphan")).otherwise(False).alias("orphan"))


def trace_stats(pairs: DataFrame) -> DataFrame:
    """Active, completed, mean duration = sum of non-null durations /
    completed count (0 when none)."""
    done = ~F.col("active")
    return pairs.agg(F.count_if(F.col("active")).alias("active_spans"),
                     F.count_if(done).alias("completed_spans"),
                     F.coalesce(F.sum(F.when(done, F.col("duration_ms"))), F.lit(0.0)).alias("_s")) \
        .select("active_spans", "completed_spans",
                F.when(F.col("completed_spans") > 0, F.col("_s") / F.col("completed_spans"))
                .otherwise(F.lit(0.0)).alias("avg_duration_ms"))


def trace_sample(spans: DataFrame, share: float = 0.1, trace_col: str = "trace_id") -> DataFrame:
    """PF15: keep a share of traces with all their spans: the first 32 bits
    of md5(trace id) modulo 1000 below share * 1000."""
    h = F.conv(F.substring(F.md5(F.col(trace_col).cast("string")), 1, 8), 16, 10).cast("long")
    return spans.filter(h % 1000 < int(round(share * 1000)))
