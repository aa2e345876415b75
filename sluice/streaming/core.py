"""Structured Streaming versions of the batch operators (ST1-ST13).

Sources are Parquet file streams, a few files or a part per trigger; event time is
``ts`` cast to TIMESTAMP with a watermark (default 10 minutes: later rows are
dropped and counted by Spark as ``numRowsDroppedByWatermark``). Sinks write to
the shared checkpoint folder of the cluster (``spark.checkpoint.dir``), with a
checkpoint location next to them. A run with a caller-given ``run_id`` uses
the same folder each time, so a restarted query resumes where it stopped;
without one every run starts anew.

Two kinds of results: append (a row is final when it comes out) and latest
(``run_latest``: update mode, each epoch's rows are written as a version and
the newest version of a key counts, so windows that are still open at the end
are in the result too).

Per-key orders (ST2, ST3, ST5, ST6, ST13) are ``EpochStream``s: an epoch is a
batch job over its rows and a versioned state table (``epochs``), so that a hot
key is spread like in the batch operators. Rows of an epoch are taken in event
time; a row within the watermark's delay that comes in a later epoch is placed
among the state rows, and answers that are out already stay as they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import scratch_path, write_table
from sluice.streaming.epochs import EpochStream, micros, run_epochs

WATERMARK = "10 minutes"
US = 1_000_000
ROWS_PER_FILE = 10_000      # of the largest part of a stream's input
STATE_TABLES = ["rows", "totals"]


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                max_files: int | None = None) -> DataFrame:
    """Parquet file stream (a directory or a glob of files). A trigger takes
    ``max_files`` files; without it a part of ``split_by_time``, else one file."""
    if max_files is None:
        part = re.search(r"-by([0-9]+)$", path)
        max_files = int(part.group(1)) if part else 1
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(path))


def split_by_time(df: DataFrame, name: str, ts: str = "ts", files: int = 6) -> str:
    """Write ``df`` under the shared folder as ``files`` parts in time order,
    one write after the other, and return the path: the input of a stream of
    several micro-batches.

    Each part is dealt by time to the same number of files (``-byN`` in the
    path), so that many tasks write and read it; a part that fills fewer gets
    empty ones. Rows of one time may go to several files of their part."""
    spark = df.sparkSession
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    lo, hi = df.agg(F.min(us), F.max(us)).first()
    width = ((hi or 0) - (lo or 0)) // files + 1
    part = F.coalesce(F.floor((us - (lo or 0)) / width), F.lit(0))
    most = df.groupBy(part.alias("part")).count().agg(F.max("count")).first()[0] or 0
    n = min(max(-(-most // ROWS_PER_FILE), 1), int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}-by{n}")
    hashed = [F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]

    def write(rows: DataFrame) -> None:
        rows.write.option("maxRecordsPerFile", 0).mode("append").parquet(path)
    for i in range(files):
        write(df.filter(part == i).repartitionByRange(n, us, F.xxhash64(*hashed)).coalesce(n))
        for _ in range((i + 1) * n - len(spark.read.schema(df.schema).parquet(path).inputFiles())):
            write(df.limit(0))
    return path


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None, files: int = 6) -> DataFrame:
    """The events table as a stream of ``files`` parts in time order, ``ts``
    as an event-time TIMESTAMP."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = file_stream(spark, split_by_time(events, "events-in", files=files), events.schema, max_files)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(df: DataFrame, mode: str = "append", name: str = "stream",
                  foreach_batch=None, run_id: str | None = None) -> DataFrame:
    """Run a streaming query over everything available (``availableNow``)
    into a parquet table in the shared folder and return that table."""
    if isinstance(df, EpochStream):
        base = scratch_path(df.rows.sparkSession, f"{name}-{run_id or uuid.uuid4().hex[:12]}")
        return run_epochs(df, base, STATE_TABLES)
    spark = df.sparkSession
    base = scratch_path(spark, f"{name}-{run_id or uuid.uuid4().hex[:12]}")
    w = (df.writeStream.option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True))
    if foreach_batch is not None:
        q = w.outputMode(mode).foreachBatch(lambda b, i: foreach_batch(b, i, f"{base}/data")).start()
    else:
        q = w.outputMode(mode).format("parquet").option("path", f"{base}/data").start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/data")


def write_epoch(batch: DataFrame, epoch: int, base: str) -> None:
    """foreachBatch body: the rows of an epoch as one version directory. A
    retried epoch rewrites its own directory."""
    batch.write.mode("overwrite").parquet(f"{base}/epoch={epoch}")


def latest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of each key."""
    rest = [c for c in versions.columns if c not in (*keys, "epoch")]
    return (versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r"))
            .select(*keys, "r.*"))


def run_latest(df: DataFrame, keys: list[str], name: str, run_id: str | None = None) -> DataFrame:
    """Run in update mode and return the newest row of each key."""
    return latest(run_available(df, "update", name, write_epoch, run_id), keys)


# ----------------------------------------------------------------- ST1 ---
def stream_counters(events: DataFrame, window: str = "1 hour", labels=("event_type",),
                    watermark: str = WATERMARK) -> DataFrame:
    """ST1: counts (and value sums) per tumbling window and label set;
    append mode emits a window once the watermark passes its end."""
    return (events.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), *labels)
            .agg(F.count("*").alias("requests"), F.sum("value").alias("value_sum")))


def mine_and(state: DataFrame | None, rows: DataFrame) -> DataFrame:
    """The epoch's rows (``_mine``) and the state's rows of the same columns."""
    rows = rows.withColumn("_mine", F.lit(True))
    return rows if state is None else rows.unionByName(state.withColumn("_mine", F.lit(False)))


# ----------------------------------------------------------------- ST2 ---
def stream_rate_limit(requests: DataFrame, key: str, id_col: str = "request_id",
                      limit: int = 60, seconds: int = 60, watermark: str = WATERMARK) -> EpochStream:
    """ST2: W3 on a stream. The state is the admitted requests of the last
    window (at most ``limit`` per bucket and window); an epoch is W3 over them
    and its own rows."""
    from sluice.operators.limits import rate_limit_admit

    def step(batch, state, mark):
        out = rate_limit_admit(mine_and(state.get("rows"), batch.select(id_col, key, "ts")), key, "ts", id_col,
                               limit, seconds)
        log = out.filter(F.col("admitted") & (micros("ts") > mark - seconds * US)).select(id_col, key, "ts")
        return out.filter("_mine").select(id_col, key, "admitted", "in_window", "remaining"), {"rows": log}
    return EpochStream(requests.select(id_col, key, "ts"), step, watermark)


# ----------------------------------------------------------------- ST8 ---
def stream_chunks_sanitize(chunks: DataFrame, text_col: str = "chunk") -> DataFrame:
    """ST8: each answer chunk anonymised on its own (stateless; PII split
    across a chunk border is missed -- ST9 assembles first)."""
    from sluice.functions.safety import pii_anonymize
    return chunks.withColumn(text_col, pii_anonymize(text_col))


# ----------------------------------------------------------------- ST9 ---
def assemble_answers(chunks: DataFrame) -> DataFrame:
    """ST9 (batch and stream): chunks of one request joined in seq order; a done
    row closes the answer; an error row ('Error: ...') closes it as failed."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "chunk", "is_error")))
    g = chunks.groupBy("request_id").agg(ordered.alias("xs"),
                                         F.bool_or("done").alias("done"),
                                         F.bool_or("is_error").alias("failed"))
    return g.select(
        "request_id",
        F.array_join(F.transform(F.filter("xs", lambda x: ~x["is_error"]), lambda x: x["chunk"]),
                     "").alias("content"),
        F.when(F.col("failed"), "error_stream").when(F.col("done"), "success_stream")
         .otherwise("open").alias("status"))


# ---------------------------------------------------------------- ST11 ---
SKETCH_LG = 12      # the distinct sketch has 2**12 registers: about 1.6 % error


def stream_business(business: DataFrame, watermark: str = WATERMARK, lg: int = SKETCH_LG) -> DataFrame:
    """ST11 on the stream: per hour and kind the number of events and a sketch
    of the users, so that an event is one row and not one for each of the 24
    windows it lies in; ``business_days`` unites the hours."""
    return (business.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 hour").alias("w"), "kind")
            .agg(F.count("*").alias("events"), F.hll_sketch_agg("user_id", F.lit(lg)).alias("users")))


def business_days(hours: DataFrame) -> DataFrame:
    """ST11: activity over sliding 24 h windows every hour, from the hours'
    counts and sketches; distinct users approximate."""
    start = F.explode(F.expr("sequence(w.start - INTERVAL 23 HOURS, w.start, INTERVAL 1 HOUR)"))
    return (hours.select(start.alias("window_start"), "kind", "events", "users")
            .groupBy("window_start", "kind")
            .agg(F.sum("events").alias("events"),
                 F.hll_sketch_estimate(F.hll_union_agg("users")).alias("unique_users")))


# ---------------------------------------------------------------- ST13 ---
def stream_dedup(requests: DataFrame, key_col: str = "cache_key", id_col: str = "event_id",
                 ttl_s: int = 3600, watermark: str = WATERMARK) -> EpochStream:
    """ST13: an equal request within the ttl of the last answer is not
    answered again. The state is the last answer of each key; a key leaves it
    when the watermark has passed the ttl."""
    rows = requests.select(F.col(key_col).alias("name"), F.lit(ttl_s).cast("long").alias("cooldown_s"), id_col, "ts")
    return EpochStream(rows, cooldown_step(id_col, key_col), watermark)


def cooldown_step(id_col: str, key_col: str):
    """W12 over the last fired row of each key and the epoch's rows."""
    from sluice.operators.alerts import alert_cooldown

    def step(batch, state, mark):
        rows = batch.select("name", "cooldown_s", id_col, "ts")
        fired = write_table(alert_cooldown(mine_and(state.get("rows"), rows), "ts", id_col), "cooldown-fired")
        last = (fired.groupBy("name").agg(F.max_by(F.struct("cooldown_s", id_col, "ts"), F.struct("ts", id_col)).alias("r"))
                .select("name", "r.*").filter(micros("ts") + F.col("cooldown_s") * US > mark))
        return fired.filter("_mine").select(F.col("name").alias(key_col), id_col), {"rows": last}
    return step


# ----------------------------------------------------------------- ST4 ---
STATE_ENTRY = T.StructType([T.StructField("until_us", T.LongType())])


def _cache_state(id_col: str):
    def fn(k, pdfs: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:                   # the watermark passed the expiry time
            until = state.get[0]
            state.remove()
            yield pd.DataFrame({id_col: pd.array([None], dtype="Int64"), "key": [k[0]], "status": ["expired"],
                                "until_us": [until]})
            return
        until = state.get[0] if state.exists else None
        for rows in sorted_batches(pdfs, id_col):
            ids, status, at = [], [], []
            for i, t, o, ttl in zip(rows[id_col], rows["_us"].to_numpy(), rows["op"], rows["ttl_s"]):
                if until is not None and t > until:
                    ids.append(None)
                    status.append("expired")
                    at.append(until)
                    until = None
                ids.append(int(i))
                at.append(None)
                if o == "get":
                    status.append("miss" if until is None else "hit")
                    continue
                status.append(o)
                until = int(t) + int(ttl if ttl == ttl and ttl else 3600) * US if o == "set" else None
            yield pd.DataFrame({id_col: pd.array(ids, dtype="Int64"), "key": [k[0]] * len(ids), "status": status,
                                "until_us": pd.array(at, dtype="Int64")})
        if until is None:
            if state.exists:
                state.remove()
        else:
            state.update((until,))
            # the timer must lie after the watermark; an entry that it has passed already goes next
            state.setTimeoutTimestamp(max(-(-until // 1000), state.getCurrentWatermarkMs() + 1))
    return fn


def sorted_batches(pdfs: Iterator[pd.DataFrame], id_col: str) -> Iterator[pd.DataFrame]:
    """One key's rows of a micro-batch in (ts, id) order."""
    rows = pd.concat(list(pdfs), ignore_index=True)
    yield rows.assign(_us=rows["ts"].astype("int64") // 1000).sort_values(["_us", id_col])


def stream_cache_ttl(ops: DataFrame, id_col: str = "op_id", watermark: str = WATERMARK) -> DataFrame:
    """ST4: cache operations on a stream. The state holds live entries only:
    when the watermark passes an entry's expiry time (or an operation of its
    key comes after it) the entry leaves the state and comes out as a row of
    its own: no id, status ``expired``, ``until_us``. A get is a hit while the
    entry lives, else a miss."""
    out = f"{id_col} {ops.schema[id_col].dataType.simpleString()}, key string, status string, until_us long"
    return (ops.withWatermark("ts", watermark).groupBy("key")
            .applyInPandasWithState(_cache_state(id_col), out, STATE_ENTRY, "append", "EventTimeTimeout"))


# ----------------------------------------------------------------- ST5 ---
FLUSH_ITEMS, FLUSH_SECONDS = 100, 5


def write_behind(writes: DataFrame, key: str = "key", seq: str = "op_id", name: str = "write-behind",
                 run_id: str | None = None, items: int = FLUSH_ITEMS, seconds: int = FLUSH_SECONDS,
                 watermark: str = WATERMARK) -> DataFrame:
    """ST5: a flush is at most ``items`` writes of one stretch of ``seconds`` of
    event time, in (ts, seq) order; it writes the last value per key (W14).
    Returns key, value, last_seq and the flush that wrote them (``flush_at``,
    the start of the stretch, and ``flush_no`` in it): the upsert of all flushes
    in their order. Stretches that the watermark has not closed wait in the
    state table; what is left at the end is flushed then."""
    width = seconds * US
    stretch = F.floor(micros("ts") / width) * width

    def flushed(rows: DataFrame) -> DataFrame:
        order = W.partitionBy("_at").orderBy(micros("ts"), seq)
        no = F.floor((F.row_number().over(order) - 1) / items)
        return (rows.withColumn("_at", stretch).withColumn("_no", no.cast("int")).groupBy("_at", "_no", key)
                .agg(F.max_by("value", F.struct("ts", seq)).alias("value"),
                     F.max_by(seq, F.struct("ts", seq)).alias("last_seq"))
                .select(key, "value", "last_seq", F.col("_at").alias("flush_at"), F.col("_no").alias("flush_no")))

    def step(batch, state, mark):
        rows = batch if "rows" not in state else batch.unionByName(state["rows"])
        closed = F.coalesce(stretch + width <= mark, F.lit(True))
        return flushed(rows.filter(closed)), {"rows": rows.filter(~closed)}
    source = EpochStream(writes.select(key, "value", seq, "ts"), step, watermark,
                         finish=lambda state: flushed(state["rows"]))
    out = run_available(source, "append", name, run_id=run_id)
    newest = F.struct("flush_at", "flush_no", "last_seq")
    return (out.groupBy(key).agg(F.max_by(F.struct("value", "last_seq", "flush_at", "flush_no"), newest).alias("r"))
            .select(key, "r.*"))


# ----------------------------------------------------------------- ST7 ---
def stream_spans(starts: DataFrame, finishes: DataFrame, max_span: str = "1 hour",
                 watermark: str = WATERMARK) -> DataFrame:
    """ST7: start x finish by span id within a time bound (left outer: a
    start without finish in time is reported as active)."""
    s = starts.withWatermark("start_ts", watermark).alias("s")
    f = finishes.withWatermark("end_ts", watermark).alias("f")
    cond = F.expr(f"s.span_id = f.fspan_id AND f.end_ts >= s.start_ts "
                  f"AND f.end_ts <= s.start_ts + INTERVAL {max_span}")
    j = s.join(f, cond, "leftOuter")
    return j.select(F.col("s.span_id").alias("span_id"),
                    ((F.unix_micros("f.end_ts") - F.unix_micros("s.start_ts")) / 1000.0)
                    .alias("duration_ms"),
                    F.col("f.end_ts").isNull().alias("active"))


def close_stream(spark: SparkSession, path: str, schema: T.StructType, values: dict) -> None:
    """A last file with one row of these values (the others null): with an event
    time far ahead it moves the watermark past everything before. Its join key
    must not be null: such rows are filtered before the watermark sees them."""
    row = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(path)


# ---------------------------------------------------------------- ST12 ---
def document_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    return file_stream(spark, f"{sf_dir.rstrip('/')}/documents*.parquet", schema, max_files)


def stream_ingest(documents: DataFrame, strategy: str = "sliding_window") -> DataFrame:
    """ST12: new documents -> chunks with ids (stateless per micro-batch;
    the sink appends to the collection)."""
    from sluice.operators.chunking import chunk, with_chunk_id
    d = documents.select("doc_id", "text",
                         F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"))
    return with_chunk_id(chunk(d, strategy, keep=["title"]))


# ---------------------------------------------------------------- ST10 ---
def stream_gauges(samples: DataFrame, labels=("user_id",), every: str = "60 seconds",
                  watermark: str = WATERMARK) -> DataFrame:
    """ST10: sampled gauges, last value per label set and sampling interval
    (``max_by`` on (ts, id)), emitted once the watermark closes the interval."""
    return (samples.withWatermark("ts", watermark)
            .groupBy(F.window("ts", every).alias("w"), *labels)
            .agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")))


# ----------------------------------------------------------------- ST6 ---
def stream_alerts(matches: DataFrame, id_col: str = "event_id", watermark: str = WATERMARK) -> EpochStream:
    """ST6: matched samples (J13 on the stream) fire under the rule's cooldown.
    The state is the last fired match of each rule; it goes when the watermark
    has passed the cooldown."""
    rows = matches.select("name", F.col("cooldown_s").cast("long").alias("cooldown_s"), id_col, "ts")
    return EpochStream(rows, cooldown_step(id_col, "name"), watermark)


# ----------------------------------------------------------------- ST3 ---
def stream_threats(requests: DataFrame, id_col: str = "event_id", limit: int = 100, seconds: int = 60,
                   text_col: str | None = None, failed: Column | None = None,
                   suspicious_after: int = 5, watermark: str = WATERMARK) -> EpochStream:
    """ST3: threat rules on a stream: requests of a user in the last window
    (W1: every request counts; breach when the count exceeds the limit),
    failures so far (W11: suspicious from the sixth) and short probes (F20). The
    state is the rows of the last window, and one row of failures per user who
    had any."""
    from sluice.functions.safety import short_probe
    from sluice.operators.limits import window_count
    from sluice.operators.timeline import running_counts
    rows = requests.select(
        id_col, "user_id", "ts", F.coalesce(failed if failed is not None else F.lit(False), F.lit(False)).alias("failed"),
        F.coalesce(short_probe(text_col) if text_col else F.lit(False), F.lit(False)).alias("probe"))

    def step(batch, state, mark):
        every = mine_and(state.get("rows"), batch)
        mine = window_count(every, "user_id", "ts", id_col, seconds, "requests_in_window").filter("_mine").drop("_mine")
        day = F.floor(micros("ts") / (86400 * US))
        run = running_counts(mine, "user_id", ["ts", id_col], day, {"failures_so_far": F.col("failed").cast("int")})
        totals = batch.filter("failed").groupBy("user_id").agg(F.count("*").alias("failures"))
        if "totals" in state:
            old = state["totals"].select(F.col("user_id").alias("_user"), F.col("failures").alias("_before"))
            run = (run.join(old, F.col("user_id").eqNullSafe(F.col("_user")), "left")
                   .withColumn("failures_so_far", F.col("failures_so_far") + F.coalesce("_before", F.lit(0))))
            totals = totals.unionByName(state["totals"]).groupBy("user_id").agg(F.sum("failures").alias("failures"))
        out = run.select(id_col, "user_id", "requests_in_window",
                         (F.col("requests_in_window") > limit).alias("breach"), "failures_so_far",
                         (F.col("failures_so_far") > suspicious_after).alias("suspicious"), "probe")
        recent = every.filter(micros("ts") > mark - seconds * US).drop("_mine")
        return out, {"rows": recent, "totals": totals}
    return EpochStream(rows, step, watermark)
