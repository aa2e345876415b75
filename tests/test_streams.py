"""Streams against their batch forms, over one and several files, and a
restart that resumes."""

import uuid

from pyspark.sql import functions as F

from sluice.operators import limits
from sluice.sources import tables as tb
from sluice.streaming import core as st

SF = "/root/testdata/sf0.001"


def test_dedup_does_not_depend_on_files(spark):
    out = []
    for files in (1, 6):
        ev = st.event_stream(spark, SF, files=files).withColumn(
            "cache_key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
        rows = st.run_available(st.stream_dedup(ev, "cache_key", ttl_s=6 * 3600), "append", "t-dedup")
        out.append(sorted(r.event_id for r in rows.collect()))
    assert out[0] == out[1] and len(out[0]) < tb.table(spark, SF, "events").count()


def test_threats_equal_batch(spark):
    batch = {r.event_id: r.requests_in_window
             for r in limits.rate_breach(tb.table(spark, SF, "events"), seconds=3600, limit=1).collect()}
    out = st.run_available(st.stream_threats(st.event_stream(spark, SF, files=4), limit=1, seconds=3600),
                           "append", "t-threats")
    assert {r.event_id: r.requests_in_window for r in out.collect()} == batch


def test_restart_resumes(spark):
    ev = tb.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = st.split_by_time(ev.filter("event_id % 2 = 0"), "t-resume", files=2)
    run = "r" + uuid.uuid4().hex[:8]

    def counts():
        s = st.file_stream(spark, path, ev.schema)
        return st.run_latest(st.stream_counters(s, watermark="60 days"), ["w", "event_type"], "t-counts", run)
    assert counts().agg(F.sum("requests")).first()[0] == ev.filter("event_id % 2 = 0").count()
    ev.filter("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(path)
    # only the new file is read; windows of both runs add up
    assert counts().agg(F.sum("requests")).first()[0] == ev.count()


def test_business_distinct_users(spark):
    # many users: the sketch's error; one row per event on the stream
    rows = spark.range(60_000).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 2).alias("ts"),
                                      (F.col("id") * 7919 % 20_011).alias("user_id"), F.lit("k").alias("kind"))
    s = st.file_stream(spark, st.split_by_time(rows, "t-business", files=2), rows.schema)
    hours = st.run_latest(st.stream_business(s), ["w", "kind"], "t-business")
    assert hours.agg(F.sum("events")).first()[0] == 60_000
    days = {r.window_start: r for r in st.business_days(hours).collect()}
    start = F.explode(F.expr("sequence(date_trunc('HOUR', ts) - INTERVAL 23 HOURS, date_trunc('HOUR', ts), INTERVAL 1 HOUR)"))
    exact = rows.select(start.alias("s"), "user_id").groupBy("s").agg(F.count("*").alias("n"),
                                                                      F.count_distinct("user_id").alias("u"))
    for r in exact.collect():
        assert days[r.s].events == r.n and abs(days[r.s].unique_users - r.u) <= 0.07 * r.u


def test_parts_are_written_and_read_by_many_tasks(spark):
    # nearly all rows in the last part, half of them at one time
    df = spark.range(60_000).withColumn("ts", F.timestamp_micros(F.when(F.col("id") < 10, F.col("id")).otherwise(
        F.when(F.col("id") % 2 == 0, 10**9).otherwise(10**9 - F.col("id")))))
    path = st.split_by_time(df, "t-parts", files=3)
    written = spark.read.parquet(path)
    sizes = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
    assert len(written.inputFiles()) == 3 * 6 and sum(sizes) == 60_000 and max(sizes) < 30_000
    seen = {}

    def look(batch, epoch, base):
        seen[epoch] = batch.agg(F.count("*"), F.min("ts"), F.max("ts")).first()
        st.write_epoch(batch, epoch, base)
    out = st.run_available(st.file_stream(spark, path, df.schema), "append", "t-parts", look)
    assert out.select("id").distinct().count() == out.count() == 60_000
    # a trigger takes a whole part, the parts come in time order
    assert [seen[k][0] for k in sorted(seen)] == [10, 0, 59_990]


def states(spark, base, name):
    from sluice.streaming.epochs import version
    out, epoch = [], 0
    while (v := version(spark, f"{base}/state/{name}", epoch)) is not None:
        out.append(v.collect())
        epoch += 1
    return out


def hot_events(spark, n=3000):
    """A user with most rows, in time order; every third a failure."""
    return spark.range(n).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id") % 5 + 2).cast("long").alias("user_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 3) * 7).alias("ts"),
        (F.col("id") % 3 == 0).alias("bad"), F.lit("r").alias("name"), F.lit(60).cast("long").alias("cooldown_s"))


def test_epoch_streams_equal_batch_and_resume(spark):
    """A hot user and a rule without gaps: in one run, and in two runs of one
    id, the answers of the batch operators; state behind the watermark goes."""
    from sluice.operators import alerts
    ev = hot_events(spark)
    half = ev.filter("event_id < 1500")
    batch = {r.event_id: (r.requests_in_window, r.breach) for r in limits.rate_breach(ev, seconds=600, limit=50).collect()}
    fails = {}
    for r in sorted(ev.collect(), key=lambda r: r.event_id):
        fails[r.event_id] = fails.get(("u", r.user_id), 0) + r.bad
        fails[("u", r.user_id)] = fails[r.event_id]
    fired = sorted(r.event_id for r in alerts.alert_cooldown(ev).collect())
    admitted = {r.event_id: (r.admitted, r.in_window) for r in limits.rate_limit_admit(ev, "user_id", "ts", "event_id", 5, 60).collect()}
    path, run = st.split_by_time(half, "t-epochs", files=2), "r" + uuid.uuid4().hex[:8]
    make = {"threats": lambda s: st.stream_threats(s, limit=50, seconds=600, failed=F.col("bad"), watermark="1 second"),
            "alerts": lambda s: st.stream_alerts(s, watermark="1 second"),
            "admit": lambda s: st.stream_rate_limit(s, "user_id", "event_id", 5, 60, "1 second")}

    def go(kind):
        return st.run_available(make[kind](st.file_stream(spark, path, ev.schema, 100)), "append", f"t-{kind}", run_id=run)
    for kind in make:
        assert go(kind).count() <= 1500
    ev.filter("event_id >= 1500").repartition(3).write.mode("append").parquet(path)
    got = {r.event_id: r for r in go("threats").collect()}
    assert {i: (r.requests_in_window, r.breach) for i, r in got.items()} == batch
    assert all(r.failures_so_far == fails[i] and r.suspicious == (fails[i] > 5) for i, r in got.items())
    assert sorted(r.event_id for r in go("alerts").collect()) == fired
    assert {r.event_id: (r.admitted, r.in_window) for r in go("admit").collect()} == admitted
    from sluice.session import scratch_path
    kept = states(spark, scratch_path(spark, f"t-threats-{run}"), "rows")
    assert len(kept) >= 2 and all(0 < len(rows) < 300 for rows in kept)      # a window, not all rows
    last = states(spark, scratch_path(spark, f"t-alerts-{run}"), "rows")
    assert all(len(rows) <= 1 for rows in last)


def test_late_rows_are_counted_and_state_expires(spark):
    ev = hot_events(spark, 300)
    path = st.split_by_time(ev, "t-late", files=1)
    run = "r" + uuid.uuid4().hex[:8]

    def go():
        s = st.file_stream(spark, path, ev.schema, 1)
        return st.run_available(st.stream_alerts(s, watermark="1 minute"), "append", "t-late", run_id=run)
    before = go().count()
    late = ev.filter("event_id < 10").withColumn("event_id", F.col("event_id") + 9000)
    late.coalesce(1).write.mode("append").parquet(path)
    assert go().count() == before                           # all of them are behind the watermark
    far = ev.limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 DAYS")).withColumn("name", F.lit("other"))
    far.coalesce(1).write.mode("append").parquet(path)
    assert go().count() == before + 1
    from sluice.session import scratch_path
    base = scratch_path(spark, f"t-late-{run}")
    meta = {r.epoch: (r.rows, r.late) for r in spark.read.parquet(f"{base}/meta").collect()}
    assert sorted(meta.values())[-2:] == [(10, 10), (300, 0)] or (10, 10) in meta.values()
    assert [r.name for r in states(spark, base, "rows")[-1]] == ["other"]       # rule "r" has left the state


def test_cache_entries_expire_by_timer(spark):
    """Entries whose time has come leave the state and come out as expired."""
    base = 1_700_000_000
    ops = [(1, "a", "set", 0), (2, "b", "set", 10), (3, "a", "get", 50), (4, "c", "set", 60), (5, "c", "delete", 70),
           (6, "a", "get", 101), (7, "a", "get", 102), (8, "d", "set", 4000), (9, "d", "get", 4050), (10, "z", "get", 90_000)]
    df = spark.createDataFrame([(i, k, o, base + t, 100) for i, k, o, t in ops], "op_id long, key string, op string, s long, ttl_s long")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    path = st.split_by_time(df.filter("op_id < 8"), "t-ttl", files=1)
    for part in ("op_id in (8, 9)", "op_id = 10"):
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    s = st.stream_cache_ttl(st.file_stream(spark, path, df.schema, 1), watermark="1 second")
    sizes = []
    spark_base = st.scratch_path(spark, f"t-ttl-{uuid.uuid4().hex[:8]}")
    q = (s.writeStream.option("checkpointLocation", f"{spark_base}/_c").trigger(availableNow=True)
         .format("parquet").option("path", f"{spark_base}/data").start())
    q.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    rows = spark.read.parquet(f"{spark_base}/data").collect()
    got = {r.op_id: r.status for r in rows if r.op_id is not None}
    assert got == {1: "set", 2: "set", 3: "hit", 4: "set", 5: "delete", 6: "miss", 7: "miss", 8: "set", 9: "hit", 10: "miss"}
    gone = sorted((r.key, r.until_us // 1_000_000 - base) for r in rows if r.status == "expired")
    assert gone == [("a", 100), ("b", 110), ("d", 4100)]
    assert max(sizes) >= 1 and sizes[-1] == 0, sizes         # nothing is kept for good


def test_flushes_hold_a_hundred_items_or_five_seconds(spark):
    n = 1000
    w = spark.range(n).select(F.col("id").alias("op_id"), F.concat(F.lit("k"), F.col("id") % 7).alias("key"),
                              F.col("id").cast("double").alias("value"),
                              F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id") * 20).alias("ts"))
    s = st.file_stream(spark, st.split_by_time(w, "t-flush", files=3), w.schema)
    got = {r.key: r for r in st.write_behind(s, name="t-flush", watermark="1 second").collect()}
    for k in range(7):
        last = max(i for i in range(n) if i % 7 == k)
        at = (1_700_000_000_000 + last * 20) // 5000 * 5000
        first = min(i for i in range(n) if (1_700_000_000_000 + i * 20) // 5000 * 5000 == at)
        r = got[f"k{k}"]
        assert (r.value, r.last_seq, r.flush_at, r.flush_no) == (last, last, at * 1000, (last - first) // 100)


def test_spans_without_finish_come_out_as_active(spark):
    from sluice.plans.catalog import QUERIES
    out = {r.span_id: r for r in QUERIES["stream_spans"](spark, SF).collect()}
    events = {r.event_id: r for r in tb.table(spark, SF, "events").collect()}
    assert set(out) == set(events)
    assert all(out[i].active == (e.event_type == "error") for i, e in events.items() if e.event_type == "error" or out[i].active is False)
