"""Windowed and sequential operators: strict 60 s bounds, ties, the
sliding-log limiter, eviction plans, hot keys, cache stats, traces."""

import datetime as dt

from pyspark.sql import functions as F

from sluice.operators import alerts as al
from sluice.operators import cache as ca
from sluice.operators import limits as lm
from sluice.operators import traces as tr

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _ev(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(microseconds=us), u) for i, us, u in rows],
        "event_id long, ts timestamp, user_id long")


def test_rate_breach_strict_bounds(spark):
    us = 1_000_000
    rows = [(1, 0, 7), (2, 60 * us - 1, 7), (3, 60 * us, 7), (4, 120 * us + 1, 7)]
    out = {r.event_id: r.requests_in_window for r in lm.rate_breach(_ev(spark, rows), limit=1).collect()}
    # 59.999999 s after -> counted; exactly 60 s -> not (age < 60)
    assert out == {1: 1, 2: 2, 3: 2, 4: 1}


def test_rate_breach_ties(spark):
    rows = [(1, 0, 7), (2, 0, 7), (3, 0, 7)]
    out = {r.event_id: r.requests_in_window for r in lm.rate_breach(_ev(spark, rows)).collect()}
    assert out == {1: 1, 2: 2, 3: 3}


def test_rate_limit_admit(spark):
    us = 1_000_000
    rows = [(1, 0, 1), (2, 1 * us, 1), (3, 2 * us, 1), (4, 60 * us, 1), (5, 61 * us, 1)]
    df = _ev(spark, rows).withColumnRenamed("event_id", "request_id")
    out = {r.request_id: (r.admitted, r.remaining)
           for r in lm.rate_limit_admit(df, "user_id", limit=2, seconds=60).collect()}
    # 3 rejected (2 admitted in window), not recorded; at 60 s request 1 left
    assert out == {1: (True, 1), 2: (True, 0), 3: (False, 0), 4: (True, 0), 5: (True, 0)}


def test_limiter_off_admits_all(spark):
    df = _ev(spark, [(1, 0, 1), (2, 1, 1), (3, 2, 1)]).withColumnRenamed("event_id", "request_id")
    assert lm.rate_limit_admit(df, "user_id", limit=1000).filter("admitted").count() == 3


def test_flag_attempts(spark):
    rows = [(i, i, 5) for i in range(12)]
    out = lm.flag_attempts(_ev(spark, rows).withColumnRenamed("user_id", "identifier")).collect()
    flags = {r.failures_so_far: (r.suspicious, r.blocked) for r in out}
    assert flags[5] == (False, False) and flags[6] == (True, True) and flags[11] == (True, True)


def _entries(spark, rows):
    return spark.createDataFrame(
        [(k, T0, T0 + dt.timedelta(seconds=s), 1, 3600, size, 1.0) for k, s, size in rows],
        "key string, created_at timestamp, last_accessed timestamp, access_count long, "
        "ttl_s long, size_bytes long, value double")


def test_lru_evict_large_entry(spark):
    now = F.lit(T0 + dt.timedelta(seconds=100)).cast("timestamp")
    e = _entries(spark, [("a", 10, 1), ("b", 20, 100), ("c", 30, 1)])
    plan = {r.key: r.kept for r in ca.lru_evict(e, now, max_entries=10, max_bytes=50).collect()}
    # newest first: c kept, b too large -> evicted, and everything older too
    assert plan == {"c": True, "b": False, "a": False}


def test_lru_evict_count_and_expired(spark):
    now = F.lit(T0 + dt.timedelta(seconds=4000)).cast("timestamp")   # all expired (ttl 3600)
    e = _entries(spark, [("a", 10, 1), ("b", 20, 1)])
    reasons = {r.key: r.reason for r in ca.lru_evict(e, now, max_entries=1).collect()}
    assert reasons == {"a": "expired", "b": "expired"}
    now = F.lit(T0 + dt.timedelta(seconds=100)).cast("timestamp")
    plan = {r.key: r.kept for r in ca.lru_evict(e, now, max_entries=1).collect()}
    assert plan == {"b": True, "a": False}


def test_hot_keys_bounds(spark):
    now = T0 + dt.timedelta(days=2)
    rows = [(1, now - dt.timedelta(hours=1), "exact1h"), (2, now - dt.timedelta(hours=24), "exact24h"),
            (3, now - dt.timedelta(minutes=30), "recent")]
    df = spark.createDataFrame(rows, "op_id long, ts timestamp, key string")
    out = {r.key: r.freq for r in ca.hot_keys(df, F.lit(now).cast("timestamp")).collect()}
    assert "exact24h" not in out                  # t > now - 24 h is strict
    assert out["exact1h"] == 0 and out["recent"] == 1


def test_cache_stats_no_reads(spark):
    df = spark.createDataFrame([("set",)], "status string")
    r = ca.cache_stats(df).collect()[0]
    assert r.hit_ratio == 0.0 and r.sets == 1


def test_replay_expired_is_miss_and_eviction(spark):
    rows = [(1, T0, "k", "set", 10, 60), (2, T0 + dt.timedelta(seconds=30), "k", "get", 0, None),
            (3, T0 + dt.timedelta(seconds=61), "k", "get", 0, None)]
    ops = spark.createDataFrame(rows, "op_id long, ts timestamp, key string, op string, "
                                      "size_bytes long, ttl_s long")
    st = {r.op_id: r.status for r in ca.replay(ops).collect()}
    assert st == {1: "set", 2: "hit", 3: "expired"}
    s = ca.cache_stats(ca.replay(ops)).collect()[0]
    assert (s.hits, s.misses, s.evictions) == (1, 1, 1)


def test_trace_stats_edge(spark):
    rows = [(1, True, None), (2, True, None)]
    pairs = spark.createDataFrame(rows, "span_id long, active boolean, duration_ms double")
    r = tr.trace_stats(pairs).collect()[0]
    assert (r.active_spans, r.completed_spans, r.avg_duration_ms) == (2, 0, 0.0)


def test_alert_operator_parsing():
    assert al.parse_operator(">= 5") == ">="
    assert al.parse_operator("<= 5") == "<="
    assert al.parse_operator("> 5") == ">"


def test_alert_cooldown(spark):
    rows = [("r", i, T0 + dt.timedelta(seconds=s), 300) for i, s in enumerate([0, 100, 300, 350, 700])]
    m = spark.createDataFrame(rows, "name string, event_id long, ts timestamp, cooldown_s long")
    fired = sorted(r.event_id for r in al.alert_cooldown(m).collect())
    assert fired == [0, 2, 4]
