"""Rate limits and attempt tracking: W1 rate_breach, W2 hourly_count, W3
rate_limit_admit, W11 flag_attempts, W13 repeat_requests, A20
failed_attempts, J10 blocked_requests.

No operator puts all rows of a key into one task. W1/W2 are RANGE frames over
(key, time slot), each slot with the one before it copied in. W3 is
sequential, but a gap of the window's length empties the log: segments between
such gaps are independent and are folded apart (a bucket without any gap stays
sequential by definition; it streams with at most ``limit`` times in memory).
W11 adds up counts per slot.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.timeline import running_counts, segments, with_previous_slot

US = 1_000_000


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def window_count(df: DataFrame, key: str, ts: str = "ts", id_col: str = "event_id",
                 seconds: int = 60, name: str = "window_count") -> DataFrame:
    """Requests of the same key within ``age < seconds`` up to and including
    this one (W1 frame; W2 with 3600), in (ts, id) order."""
    width = seconds * US
    d = with_previous_slot(df.withColumn("_us", _micros(ts)), F.floor(F.col("_us") / width))
    w_range = W.partitionBy(key, "_slot").orderBy("_us").rangeBetween(-(width - 1), 0)
    w_peer = W.partitionBy(key, "_slot", "_us")
    later_peers = F.count("*").over(w_peer) - F.row_number().over(w_peer.orderBy(id_col))
    return (d.withColumn(name, F.count("*").over(w_range) - later_peers)
            .filter("_own").drop("_us", "_slot", "_own"))


def rate_breach(df: DataFrame, key: str = "user_id", ts: str = "ts", id_col: str = "event_id",
                limit: int = 100, seconds: int = 60) -> DataFrame:
    """Breach when the count in the last minute exceeds ``limit``
    (event RATE_LIMIT_EXCEEDED / medium / blocked)."""
    out = window_count(df, key, ts, id_col, seconds, "requests_in_window")
    return out.withColumn("breach", F.col("requests_in_window") > limit)


def hourly_count(df: DataFrame, key: str = "user_id", ts: str = "ts",
                 id_col: str = "event_id") -> DataFrame:
    """The same frame over 3600 s."""
    return window_count(df, key, ts, id_col, 3600, "requests_last_hour")


def _admit_fold(limit: int, window_us: int, key: str):
    """Rows of one segment follow each other in time order, over batches. Only
    admitted rows are visited: while the log is full every row is rejected, so
    the next row to look at is the first one that the log's oldest entry has
    left."""
    def run(batches):
        segment, log = None, deque()
        for pdf in batches:
            n = len(pdf)
            us, keys, segs = pdf["_us"].to_numpy(), pdf[key].to_numpy(), pdf["_seg"].to_numpy()
            admitted = np.zeros(n, dtype=bool)
            current = np.full(n, max(0, limit), dtype=np.int64)
            times = us.tolist()
            turns = np.flatnonzero(segs[1:] != segs[:-1]) + 1
            names = pd.factorize(keys, use_na_sentinel=False)[0]
            turns = np.union1d(turns, np.flatnonzero(names[1:] != names[:-1]) + 1)
            bounds = [0, *turns.tolist(), n]
            for begin, end in zip(bounds[:-1], bounds[1:]):
                if begin == end:
                    continue
                here = (None if pd.isna(keys[begin]) else keys[begin], segs[begin])
                if here != segment:
                    segment, log = here, deque()
                i = begin
                while i < end and limit > 0:
                    t = times[i]
                    while log and log[0] <= t - window_us:
                        log.popleft()
                    if len(log) < limit:
                        admitted[i], current[i] = True, len(log)
                        log.append(t)
                        i += 1
                    else:
                        i = bisect_left(times, log[0] + window_us, i + 1, end)
            remaining = np.where(admitted, limit - current - 1, 0)
            yield pdf.drop(columns=["_us", "_seg"]).assign(
                admitted=admitted, in_window=pd.array(current, dtype="int64"),
                remaining=pd.array(remaining, dtype="int64"))
    return run


def rate_limit_admit(df: DataFrame, key: str, ts: str = "ts", id_col: str = "request_id",
                     limit: int = 60, seconds: int = 60) -> DataFrame:
    """W3 sliding-log limiter per bucket key (api_key:ip): a request is
    rejected when ``limit`` admitted requests have ts > now - window;
    rejected requests are not recorded; remaining = max(0, limit - admitted).

    Returns the input rows plus admitted, in_window, remaining."""
    d = segments(df.withColumn("_us", _micros(ts)), key, "_us", id_col, F.lit(seconds * US))
    d = d.select(*df.columns, "_us", "_seg")
    part = d.repartition(key, "_seg").sortWithinPartitions(key, "_seg", "_us", id_col)
    schema = T.StructType([*df.schema.fields, T.StructField("admitted", T.BooleanType()),
                           T.StructField("in_window", T.LongType()),
                           T.StructField("remaining", T.LongType())])
    return part.mapInPandas(_admit_fold(limit, seconds * US, key), schema)


def failed_attempts(failures: DataFrame, key: str = "identifier") -> DataFrame:
    """Failures per identifier."""
    return failures.groupBy(key).agg(F.count("*").alias("failures"))


def flag_attempts(failures: DataFrame, key: str = "identifier", ts: str = "ts",
                  id_col: str = "event_id") -> DataFrame:
    """Running failures per identifier; suspicious from the 6th (> 5),
    blocked when suspicious or > 10."""
    day = F.floor(_micros(ts) / (86400 * US))
    return (running_counts(failures, key, [ts, id_col], day, {"failures_so_far": F.lit(1)})
            .withColumn("suspicious", F.col("failures_so_far") > 5)
            .withColumn("blocked", F.col("suspicious") | (F.col("failures_so_far") > 10)))


def blocked_requests(requests: DataFrame, failures: DataFrame, key: str = "identifier",
                     suspicious_after: int = 5, block_after: int = 10) -> DataFrame:
    """Requests whose identifier is suspicious (> 5 failures) or has
    more than 10 failures (left semi join on the aggregated failures)."""
    bad = (failed_attempts(failures, key)
           .filter((F.col("failures") > suspicious_after) | (F.col("failures") > block_after))
           .select(key))
    return requests.join(bad, key, "left_semi")


def repeat_requests(df: DataFrame, key: str, content: str, limit: int = 10) -> DataFrame:
    """Identical content (md5) of one key seen more than ``limit`` times:
    counts summed before the shuffle, joined back."""
    d = df.withColumn("_h", F.md5(F.col(content)))
    n = d.groupBy(F.col(key).alias("_k"), F.col("_h").alias("_g")).agg(F.count("*").alias("repeats"))
    return (d.join(n, F.col(key).eqNullSafe(F.col("_k")) & F.col("_h").eqNullSafe(F.col("_g")))
            .withColumn("repeated", F.col("repeats") > limit).drop("_h", "_k", "_g"))
