"""Per-key orders against plain folds, with one key that holds most rows;
traces with lost parents, long chains and cycles."""

import random
from collections import deque

from pyspark.sql import functions as F

from sluice.operators import alerts, cache, limits, routing, traces, usage
from sluice.operators.timeline import segments

BASE = 1_700_000_000


def _rows(seed=1, n=400, gap=400):
    """(id, key, second): key 'hot' holds nine tenths of the rows, in bursts."""
    r, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += r.choice([0, 1, 5, 20, 59, 60, 61, gap])
        out.append((i, "hot" if r.random() < .9 else f"k{r.randrange(4)}", BASE + t))
    return out


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, k string, s long")
    return df.withColumn("ts", F.timestamp_seconds("s")).repartition(5)


def test_window_count_of_a_hot_key(spark):
    rows = _rows()
    got = {r.id: r.n for r in limits.window_count(_frame(spark, rows), "k", "ts", "id", 60, "n").collect()}
    for i, k, s in rows:
        assert got[i] == sum(1 for j, k2, s2 in rows if k2 == k and s - 60 < s2 <= s and (s2, j) <= (s, i))


def test_rate_limit_segments(spark):
    rows = _rows(2)
    got = {r.id: (r.admitted, r.in_window, r.remaining)
           for r in limits.rate_limit_admit(_frame(spark, rows), "k", "ts", "id", 3, 60).collect()}
    logs = {}
    for i, k, s in sorted(rows, key=lambda x: (x[2], x[0])):
        log = logs.setdefault(k, deque())
        while log and log[0] <= s - 60:
            log.popleft()
        n, ok = len(log), len(log) < 3
        if ok:
            log.append(s)
        assert got[i] == (ok, n, max(0, 3 - len(log)))


def test_hot_key_is_spread(spark):
    d = _frame(spark, _rows(3)).withColumn("us", F.col("s") * 1_000_000)
    seg = segments(d, "k", "us", "id", F.lit(60_000_000)).filter("k = 'hot'")
    assert seg.select("_seg").distinct().count() > 20
    parts = seg.repartition(8, "k", "_seg").withColumn("p", F.spark_partition_id()).select("p").distinct().count()
    assert parts > 3


def test_segments_copy_no_rows(spark):
    """One pass over the rows: no row is copied into the next slot or sorted."""
    d = _frame(spark, _rows(3)).withColumn("us", F.col("s") * 1_000_000)
    d = d.unionByName(spark.createDataFrame([(-1, None, BASE), (-2, None, BASE + 30), (-3, "hot", None)],
                                            "id long, k string, s long")
                      .withColumn("ts", F.timestamp_seconds("s")).withColumn("us", F.col("s") * 1_000_000))
    seg = segments(d, "k", "us", "id", F.lit(60_000_000))
    assert "Generate" not in seg._jdf.queryExecution().optimizedPlan().toString()
    got, want, last, start = {r.id: r._seg for r in seg.collect()}, {}, {}, {}
    for r in sorted(d.filter("us IS NOT NULL").collect(), key=lambda r: (r.us, r.id)):
        if r.k not in last or r.us - last[r.k] >= 60_000_000:
            start[r.k] = r.us
        last[r.k], want[r.id] = r.us, start[r.k]
    assert got == want


def test_limiter_of_a_full_bucket_visits_admitted_rows():
    import pandas as pd
    from sluice.operators.limits import _admit_fold
    r = random.Random(7)
    for limit in (0, 1, 3):
        us = sorted(r.randrange(5000) for _ in range(900))
        keys, log, want = [None] * 300 + ["a"] * 300 + ["b"] * 300, deque(), []
        us = sorted(us[:300]) + sorted(us[300:600]) + sorted(us[600:])
        for i, t in enumerate(us):
            log = deque() if i % 300 == 0 else log
            while log and log[0] <= t - 100:
                log.popleft()
            n, ok = len(log), len(log) < limit
            if ok:
                log.append(t)
            want.append((ok, n, max(0, limit - len(log))))
        rows = pd.DataFrame({"k": keys, "_us": us, "_seg": [1] * 900})
        got = pd.concat(_admit_fold(limit, 100, "k")([rows[i:i + 70] for i in range(0, 900, 70)]))
        assert list(zip(got.admitted, got.in_window, got.remaining)) == want
    n = 400_000                     # a bucket that is always full: rejected rows are stepped over
    rows = pd.DataFrame({"k": ["a"] * n, "_us": range(n), "_seg": [1] * n})
    got = pd.concat(_admit_fold(2, n, "k")([rows]))
    assert got.admitted.sum() == 2 and got.in_window.iloc[-1] == 2


def test_cooldown_segments(spark):
    rows = _rows(4)
    m = _frame(spark, rows).withColumnRenamed("k", "name").withColumn("cooldown_s", F.lit(60))
    got = {r.id for r in alerts.alert_cooldown(m, "ts", "id").collect()}
    last, want = {}, set()
    for i, k, s in sorted(rows, key=lambda x: (x[2], x[0])):
        if k not in last or s - last[k] >= 60:
            last[k] = s
            want.add(i)
    assert got == want


def test_replay_across_days(spark):
    r = random.Random(5)
    rows = [(i, "hot" if r.random() < .8 else "cold", BASE + r.randrange(5 * 86400),
             r.choice(["get", "get", "set", "delete"]), r.choice([None, 600, 90000])) for i in range(300)]
    ops = spark.createDataFrame(rows, "op_id long, key string, s long, op string, ttl_s long") \
        .withColumn("ts", F.timestamp_seconds("s")).withColumn("size_bytes", F.lit(1)).repartition(4)
    got = {x.op_id: x.status for x in cache.replay(ops).collect()}
    live = {}
    for i, k, s, op, ttl in sorted(rows, key=lambda x: (x[2], x[0])):
        if op == "get":
            e = live.get(k)
            assert got[i] == ("miss" if e is None else "expired" if s > e else "hit")
        else:
            assert got[i] == op
            live[k] = s + (ttl or 3600) if op == "set" else None


def test_running_counts(spark):
    rows = [(i, "p1" if i % 10 else "p2", "success" if i % 3 else "error") for i in range(200)]
    df = spark.createDataFrame(rows, "request_id long, provider string, status string").repartition(4)
    got = {x.request_id: (x.requests_so_far, x.failures_so_far)
           for x in routing.lb_counts(df, "request_id", slot_size=7).collect()}
    for i, p, _ in rows:
        before = [x for x in rows if x[1] == p and x[0] <= i]
        assert got[i] == (len(before), sum(x[2] == "error" for x in before))


def test_lookup_of_a_cached_null(spark):
    e = spark.createDataFrame([("a", None, BASE, 100), ("b", 1.0, BASE, 1)],
                              "key string, value double, s long, ttl_s long").withColumn(
        "created_at", F.timestamp_seconds("s"))
    now = F.timestamp_seconds(F.lit(BASE + 50))
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = {r.key: r.hit_level for r in cache.cache_lookup(req, e, e.limit(0), now).collect()}
    assert got == {"a": "L1", "b": None, "c": None}
    miss = {r.key: r.source for r in cache.missing_keys(req, e.limit(0), e, now).collect()}
    assert miss == {"a": "L2", "b": "warm", "c": "warm"}


def test_trace_roots_join_no_null_keys(spark, monkeypatch):
    """Finished spans share the null key: they must not meet in one task."""
    plans, write = [], traces.write_table

    def record(df, name):
        if name == "trace-up":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)
    monkeypatch.setattr(traces, "write_table", record)
    rows = [(i, i - 1 if i % 5 else None) for i in range(20)] + [(90, 91), (None, 3)]
    got = traces.trace_roots(spark.createDataFrame(rows, "span_id long, parent_span_id long")).collect()
    want = [(i, i - i % 5, i % 5, False) for i in range(20)] + [(90, 90, 0, True), (None, 0, 4, False)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len(plans) > 2
    for plan in plans[1:]:
        assert "isnotnull(up#" in plan and "Join LeftOuter" in plan
    assert "isnotnull(parent_span_id#" in plans[0]


def test_trace_roots_without_limits(spark):
    chain = [(i, i - 1 if i else None) for i in range(150)]
    extra = [(1000, 999), (1001, 1000), (2000, 2001), (2001, 2000), (3000, None)]
    spans = spark.createDataFrame(chain + extra, "span_id long, parent_span_id long")
    got = {r.span_id: (r.trace_id, r.depth, r.orphan) for r in traces.trace_roots(spans).collect()}
    assert all(got[i] == (0, i, False) for i in range(150))
    assert got[1000] == (1000, 0, True) and got[1001] == (1000, 1, True)
    assert got[2000] == got[2001] == (None, None, False)
    assert got[3000] == (3000, 0, False) and len(got) == 155
    assert traces.trace_roots(spans.limit(0)).count() == 0


def test_exact_quantiles(spark):
    import numpy as np
    r = random.Random(6)
    rows = [("a", float(r.choice([1, 1, 1, 2, 50, r.random() * 100]))) for _ in range(500)]
    rows += [("b", 3.0), ("c", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {x.k: x for x in usage.summary(df, "v", ["k"], slots=7).collect()}
    values = [v for k, v in rows if k == "a"]
    for q in (50, 90, 95, 99):
        assert abs(got["a"][f"q{q}"] - np.percentile(values, q)) < 1e-9
    assert got["b"].q50 == 3.0 and got["c"].q50 is None and got[None].q50 == 1.5
    assert got["c"]["count"] == 1
    assert usage.summary(df, "v").count() == 1


def cooldown_fold(rows):
    """(id, key, second, cooldown) -> ids that fire."""
    last, fired = {}, set()
    for i, k, s, cd in sorted(rows, key=lambda x: (x[2], x[0])):
        if k not in last or s - last[k] >= cd:
            last[k] = s
            fired.add(i)
    return fired


def test_cooldown_pointers_equal_the_fold(spark):
    r = random.Random(8)
    for step, cd in ((3, 60), (40, 60), (0, 5)):
        t, rows = 0, []
        for i in range(600):
            t += r.randrange(0, step + 1)
            rows.append((i, r.choice(["hot", "hot", "cold", None]), BASE + t + (500 if i == 300 else 0), cd))
        df = spark.createDataFrame(rows, "event_id long, name string, s long, cooldown_s long")
        df = df.withColumn("ts", F.timestamp_seconds("s")).repartition(4)
        for bound in (0, 40):       # all segments by pointers, some
            got = [x.event_id for x in alerts.alert_cooldown(df, fold_rows=bound).collect()]
            assert len(got) == len(set(got)) and set(got) == cooldown_fold(rows), (step, cd, bound)


def test_a_million_matches_without_a_gap(spark):
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("event_id"), F.lit("rule").alias("name"),
                               (F.lit(BASE) + F.floor(F.col("id") / 40)).alias("s"), F.lit(60).cast("long").alias("cooldown_s"))
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(x.event_id for x in alerts.alert_cooldown(df).select("event_id").collect())
    assert got == [40 * 60 * k for k in range(-(-n // 2400))]
