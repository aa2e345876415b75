"""Cache analytics: replay of cache operations (A8, A9), lookups over two
levels (J7), presence (J12), missing keys and warm plans (J11, S4, S5),
LRU eviction plan (W9), hot keys (W10, T5), write coalescing (W14), cache
keys (F24, F25) and expiry (F26).

The replay is an as-of computation: each operation sees the last set or delete
of its key before it. Operations are ordered inside (key, day); the last write
of the days before comes from a table with one row per (key, day), so a hot
key is not one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.operators.timeline import carried, join_slots
from sluice.session import write_table

DEFAULT_TTL_S = 3600
MAX_ENTRIES = 10000
MAX_BYTES = 100 * 1024 * 1024
US = 1_000_000


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


# ------------------------------------------------------------------ F26 ---
def is_expired(created: Column, ttl_s: Column, now: Column) -> Column:
    """now > created + ttl; a null ttl never expires."""
    return F.when(ttl_s.isNull(), F.lit(False)).otherwise(
        F.unix_micros(now) > F.unix_micros(created) + ttl_s * US)


def effective_ttl(ttl_s: Column, default: int = DEFAULT_TTL_S) -> Column:
    """ttl 0 or null on write -> default."""
    return F.when(ttl_s.isNull() | (ttl_s == 0), F.lit(default)).otherwise(ttl_s)


# ------------------------------------------------------------ F24, F25 ---
def cache_key(*parts: Column) -> Column:
    """parts joined by ':'; nested parts (struct/map/array) become the
    first 8 hex digits of md5 of their JSON."""
    return F.concat_ws(":", *parts)


def nested_part(c: Column) -> Column:
    return F.substring(F.md5(F.to_json(c)), 1, 8)


def llm_cache_key(fields: dict[str, Column], prefix: str = "llm:") -> Column:
    """prefix + md5 of the JSON of the request fields in sorted order."""
    s = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.concat(F.lit(prefix), F.md5(F.to_json(s)))


# -------------------------------------------------------------- replay ---
def replay(ops: DataFrame, key: str = "key", ts: str = "ts", id_col: str = "op_id") -> DataFrame:
    """Status of every operation against the cache state just before it.

    get -> hit | miss | expired (expired counts as miss and eviction);
    set -> set; delete -> delete. Adds created_at/ttl of the entry seen."""
    is_write = F.col("op").isin("set", "delete")
    write = F.when(is_write, F.struct(
        F.col("op").alias("op"), F.col(ts).cast("timestamp").alias("at"),
        effective_ttl(F.col("ttl_s")).alias("ttl_s"), F.col("size_bytes").alias("size")))
    d = (ops.withColumn("_slot", F.floor(_us(ts) / (86400 * US)).cast("long"))
         .withColumn("_w", write).withColumn("_o", F.struct(_us(ts).alias("u"), F.col(id_col).alias("i"))))
    w = W.partitionBy(key, "_slot").orderBy("_o").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_here", F.last("_w", ignorenulls=True).over(w))
    d = join_slots(d, carried(d, [key], F.max_by("_w", F.when(is_write, F.col("_o")))), [key])
    d = (d.withColumn("_lw", F.coalesce("_here", "carry"))
         .drop("_slot", "_w", "_o", "_here", "carry"))
    present = F.col("_lw").isNotNull() & (F.col("_lw.op") == "set")
    expired = present & is_expired(F.col("_lw.at"), F.col("_lw.ttl_s"), F.col(ts).cast("timestamp"))
    status = (F.when(F.col("op") != "get", F.col("op"))
              .when(expired, "expired").when(present, "hit").otherwise("miss"))
    return (d.withColumn("status", status)
            .withColumn("entry_created_at", F.col("_lw.at")).drop("_lw"))


def cache_stats(replayed: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Hits, misses (expired included), sets, deletes, evictions
    (expired reads), hit ratio = hits / (hits + misses) or 0."""
    st = F.col("status")
    out = replayed.groupBy(*group).agg(
        F.count_if(st == "hit").alias("hits"),
        F.count_if(st.isin("miss", "expired")).alias("misses"),
        F.count_if(st == "set").alias("sets"),
        F.count_if(st == "delete").alias("deletes"),
        F.count_if(st == "expired").alias("evictions"),
        F.count_if(st == "error").alias("errors"))
    tot = F.col("hits") + F.col("misses")
    return out.withColumn("hit_ratio", F.when(tot > 0, F.col("hits") / tot).otherwise(F.lit(0.0)))


def cache_size(entries: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """A8, second half: entries and bytes held."""
    return entries.groupBy(*group).agg(F.count("*").alias("entries"),
                                       F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def cache_stats_combined(per_level: DataFrame) -> DataFrame:
    """Both levels together; ratio over max(1, total)."""
    out = per_level.agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    return out.withColumn("hit_ratio", F.col("hits") /
                          F.greatest(F.lit(1), F.col("hits") + F.col("misses")))


# ------------------------------------------------------------- entries ---
def entries_as_of(ops: DataFrame, as_of: Column, key: str = "key", ts: str = "ts",
                  id_col: str = "op_id") -> DataFrame:
    """cache_entries: per key the state before ``as_of``: value and size of
    the last set (unless deleted later), created_at, last access, access
    count (gets after the set), ttl."""
    is_write = F.col("op").isin("set", "delete")
    before = (ops.filter(F.col(ts).cast("timestamp") < as_of)
              .withColumn("_o", F.struct(_us(ts).alias("u"), F.col(id_col).alias("i"))))
    # last write per key (a partial aggregate), then its accesses
    last = before.filter(is_write).groupBy(key).agg(
        F.max("_o").alias("_lw"),
        F.max_by(F.struct(F.col("op"), F.col(ts).cast("timestamp").alias("at"),
                          F.col("size_bytes"), effective_ttl(F.col("ttl_s")).alias("ttl_s"),
                          F.col("value")), "_o").alias("w"))
    uses = before.join(last.select(key, "_lw"), key).groupBy(key).agg(
        F.max(F.col(ts).cast("timestamp")).alias("last_accessed"),
        F.count_if((F.col("op") == "get") & (F.col("_o") > F.col("_lw"))).alias("access_count"))
    g = last.join(uses, key)
    live = g.filter(F.col("w.op") == "set")
    return live.select(
        key, F.col("w.value").alias("value"), F.col("w.at").alias("created_at"),
        "last_accessed", "access_count",
        F.col("w.ttl_s").alias("ttl_s"), F.col("w.size_bytes").alias("size_bytes"))


# ------------------------------------------------------------------- J7 ---
def cache_lookup(requests: DataFrame, l1: DataFrame, l2: DataFrame, now: Column,
                 key: str = "key") -> DataFrame:
    """L1 first, else L2; expired entries are misses. L2 hits are
    promotions. Two left joins on the key, then ``coalesce``."""
    def live(t, tag):
        return (t.filter(~is_expired(F.col("created_at"), F.col("ttl_s"), now))
                .select(key, F.col("value").alias(f"{tag}_value"), F.lit(True).alias(f"{tag}_there")))
    out = (requests.join(live(l1, "l1"), key, "left").join(live(l2, "l2"), key, "left"))
    # presence, not the value, decides: a cached null is a hit
    level = F.when(F.col("l1_there"), "L1").when(F.col("l2_there"), "L2")
    return (out.withColumn("hit_level", level)
            .withColumn("value", F.when(F.col("hit_level") == "L1", F.col("l1_value"))
                        .when(F.col("hit_level") == "L2", F.col("l2_value")))
            .withColumn("promoted", F.col("hit_level") == "L2")
            .drop("l1_value", "l2_value", "l1_there", "l2_there"))


def key_exists(keys: DataFrame, l1: DataFrame, l2: DataFrame, now: Column,
               key: str = "key") -> DataFrame:
    """Keys present and not expired in either level (left semi)."""
    live = (l1.select(key, "created_at", "ttl_s").unionByName(l2.select(key, "created_at", "ttl_s"))
            .filter(~is_expired(F.col("created_at"), F.col("ttl_s"), now)).select(key))
    return keys.join(live, key, "left_semi")


def missing_keys(wanted: DataFrame, l1: DataFrame, l2: DataFrame, now: Column,
                 key: str = "key") -> DataFrame:
    """Keys wanted but absent from L1; of those, the ones
    found in L2 are overlaid (level 'L2'), the rest are to warm. An expired
    entry does not exist."""
    def live(t):
        return t.filter(~is_expired(F.col("created_at"), F.col("ttl_s"), now)).select(key).distinct()
    second = live(l2).withColumn("_l2", F.lit(True))
    return (wanted.join(live(l1), key, "left_anti").join(second, key, "left")
            .withColumn("source", F.when(F.col("_l2"), "L2").otherwise("warm")).drop("_l2"))


# ------------------------------------------------------------------- W9 ---
def global_running(df: DataFrame, order: Sequence[Column], key: str, size_col: str,
                   n_parts: int | None = None) -> DataFrame:
    """Rank and running sum of ``size_col`` over a total order, distributed:
    order, key and size are range-partitioned and written once; running values
    inside each partition and the totals of the partitions before (one row per
    partition) both come from that table, so they agree. No step puts all rows
    into one task; the other columns are joined back by key."""
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [F.col(key), F.col(size_col).cast("long").alias("_size"),
             *[c.alias(f"_k{i}") for i, (c, _) in enumerate(order)]]
    by = [F.col(f"_k{i}").desc() if down else F.col(f"_k{i}").asc() for i, (_, down) in enumerate(order)]
    rows = write_table(df.select(*named).repartitionByRange(n_parts, *by, key)
                       .withColumn("_pid", F.spark_partition_id()), "running")
    inside = W.partitionBy("_pid").orderBy(*by, key).rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy("_pid").agg(F.count("*").alias("_pn"), F.sum("_size").alias("_pb"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_on"),
                            F.coalesce(F.sum("_pb").over(before), F.lit(0)).alias("_ob"))
    ranked = (rows.withColumn("_rn", F.row_number().over(inside)).withColumn("_cum", F.sum("_size").over(inside))
              .join(F.broadcast(offsets), "_pid")
              .select(key, (F.col("_rn") + F.col("_on")).alias("rank"),
                      (F.col("_cum") + F.col("_ob")).alias("running_bytes")))
    return df.join(ranked, key)


def lru_evict(entries: DataFrame, now: Column, max_entries: int = MAX_ENTRIES,
              max_bytes: int = MAX_BYTES, order: str = "lru", key: str = "key") -> DataFrame:
    """W9 eviction plan: expired entries go first; the rest are kept from
    the most recently used down while entries <= max and bytes <= max.
    ``order``: lru (last access), lfu (access count), ttl (expiry time).
    Returns every entry with kept (bool) and reason."""
    exp = is_expired(F.col("created_at"), F.col("ttl_s"), now)
    d = entries.withColumn("_expired", exp)
    if order == "lfu":
        keys = [(F.col("access_count"), True), (F.col("last_accessed"), True)]
    elif order == "ttl":
        keys = [(F.unix_micros("created_at") + F.col("ttl_s") * US, True)]
    else:
        keys = [(F.col("last_accessed"), True)]
    live = global_running(d.filter(~F.col("_expired")), keys, key, "size_bytes")
    kept = (F.col("rank") <= max_entries) & (F.col("running_bytes") <= max_bytes)
    live = (live.withColumn("kept", kept)
            .withColumn("reason", F.when(kept, F.lit(None)).otherwise(F.lit("size_limit"))))
    dead = (d.filter(F.col("_expired")).withColumn("rank", F.lit(None).cast("long"))
            .withColumn("running_bytes", F.lit(None).cast("long"))
            .withColumn("kept", F.lit(False)).withColumn("reason", F.lit("expired")))
    return live.unionByName(dead).drop("_expired")


# ------------------------------------------------------------------ W10 ---
def hot_keys(accesses: DataFrame, now: Column, limit: int = 100, key: str = "key",
             ts: str = "ts") -> DataFrame:
    """Accesses of the last 24 h (now - 24 h < t <= now); score = accesses
    in the last hour / (seconds since the last access + 1); top ``limit`` by
    score, ties by first access (a global top-k, partial per partition)."""
    now_us = F.unix_micros(now)
    t = _us(ts)
    recent = accesses.filter((t > now_us - 24 * 3600 * US) & (t <= now_us))
    g = recent.groupBy(key).agg(
        F.count_if(t > now_us - 3600 * US).alias("freq"),
        F.max(t).alias("_last"), F.min(t).alias("_first"))
    g = g.withColumn("score", F.col("freq") / ((now_us - F.col("_last")) / US + 1.0))
    return (g.orderBy(F.col("score").desc(), F.col("_first"), F.col(key)).limit(limit)
            .select(key, "freq", "score"))


# ------------------------------------------------------------------ W14 ---
def coalesce_writes(writes: DataFrame, batch: Column, key: str = "key",
                    seq: str = "op_id") -> DataFrame:
    """Per flush batch, the last value per key wins; the ttl is the
    first non-null ttl of the whole batch (one aggregate per batch, joined
    back to the per-key rows of that batch)."""
    b = writes.withColumn("_batch", batch)
    per_key = b.groupBy("_batch", key).agg(F.max_by("value", seq).alias("value"),
                                          F.max(seq).alias("last_seq"))
    ttl = (b.filter(F.col("ttl_s").isNotNull()).groupBy("_batch")
           .agg(F.min_by("ttl_s", seq).alias("ttl_s")))
    return per_key.join(ttl, "_batch", "left").withColumnRenamed("_batch", "batch")
