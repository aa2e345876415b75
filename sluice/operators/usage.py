"""Usage analytics: counters (A10, A18), histograms (A11), summaries (A12),
LLM usage (A13), provider stats (A14), gauges (A15), business statistics
(A2-A4), error rate (A21), health roll-up (A19), token and cost estimates
(F10, F11), durations (F31) and retention (PF14).

All are hash aggregates (partial aggregation before the shuffle) or
projections; multi-level results use ROLLUP / grouping sets in one pass
instead of joining separate aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: default histogram buckets (seconds).
DEFAULT_BUCKETS = [0.1, 0.5, 1.0, 2.5, 5.0, 10.0]
DEFAULT_QUANTILES = [0.5, 0.9, 0.95, 0.99]
TOKENS_PER_WORD = 1.3


def counter(df: DataFrame, labels: Sequence[str], amount: str | Column | None = None,
            name: str = "value") -> DataFrame:
    """A18 generic counter: rows (or ``amount``) summed per label set."""
    agg = F.count("*") if amount is None else F.sum(amount)
    return df.groupBy(*labels).agg(agg.alias(name))


def operation_counters(sources: dict[str, tuple[DataFrame, str | Column]]) -> DataFrame:
    """(component, label, value) of several sources: component -> (rows,
    label). Each is summed before the union, so only label sets meet."""
    parts = [counter(df.select((F.col(label) if isinstance(label, str) else label).cast("string").alias("label")),
                     ["label"]).select(F.lit(name).alias("component"), "label", "value")
             for name, (df, label) in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fmt_le(b: float) -> str:
    return repr(float(b))


def histogram(df: DataFrame, value: str, labels: Sequence[str] = (),
              buckets: Sequence[float] = DEFAULT_BUCKETS) -> DataFrame:
    """A11 cumulative histogram: per label set one row per bucket bound
    (``le``, with "+Inf") holding count(v <= le), plus sum and count.

    One aggregation with a conditional count per bucket (all partial
    map-side), then the bucket columns are unpivoted."""
    v = F.col(value)
    aggs = [F.count_if(v <= F.lit(float(b))).alias(f"b{i}") for i, b in enumerate(buckets)]
    aggs += [F.count("*").alias("count"), F.sum(v).alias("sum")]
    wide = df.groupBy(*labels).agg(*aggs)
    pairs = [F.struct(F.lit(_fmt_le(b)).alias("le"), F.col(f"b{i}").alias("bucket_count"))
             for i, b in enumerate(buckets)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
    return (wide.select(*labels, "count", "sum", F.explode(F.array(*pairs)).alias("p"))
            .select(*labels, "p.le", "p.bucket_count", "count", "sum"))


def summary(df: DataFrame, value: str, labels: Sequence[str] = (),
            quantiles: Sequence[float] = DEFAULT_QUANTILES, exact: bool = True,
            slots: int = 64) -> DataFrame:
    """Count, sum and quantiles per label set. ``exact`` interpolates
    linearly between the neighbouring values; otherwise ``percentile_approx``.

    The exact way counts equal values first, cuts each label set at
    approximate quantiles into ``slots`` ranges, and finds the values at the
    wanted ranks from running counts per range: no task holds the values of a
    whole label set."""
    from sluice.operators.timeline import join_slots, running_counts
    v = F.col(value)
    names = {q: f"q{int(q * 100)}" for q in quantiles}
    if not exact:
        qs = [F.percentile_approx(v, float(q), 10000).alias(n) for q, n in names.items()]
        return df.groupBy(*labels).agg(F.count("*").alias("count"), F.sum(v).alias("sum"), *qs)
    rows = df.select(F.struct(*[F.col(c) for c in labels], F.lit(0).alias("_")).alias("_key"), v.alias("_v"))
    whole = rows.groupBy("_key").agg(
        F.count("*").alias("count"), F.sum("_v").alias("sum"), F.count("_v").alias("_n"),
        F.percentile_approx("_v", [i / slots for i in range(1, slots)], 1000).alias("_cuts"))
    counts = rows.filter(F.col("_v").isNotNull()).groupBy("_key", "_v").agg(F.count("*").alias("_c"))
    placed = join_slots(counts.withColumn("_slot", F.lit(0)), whole.withColumn("_slot", F.lit(0)), ["_key"])
    slot = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    ranked = running_counts(placed.withColumn("_s", slot).drop("_slot"), "_key", ["_v"], F.col("_s"),
                            {"_upto": F.col("_c")})

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    aggs = []
    for q, n in names.items():
        low = F.floor(F.lit(float(q)) * (F.col("_n") - 1))
        aggs += [at_rank(low).alias(f"_a{n}"), at_rank(low + 1).alias(f"_b{n}")]
    found = ranked.groupBy("_key").agg(*aggs)
    out = whole.alias("w").join(found.alias("f"), F.col("w._key").eqNullSafe(F.col("f._key")), "left")
    result = []
    for q, n in names.items():
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        a, b = F.col(f"_a{n}"), F.coalesce(F.col(f"_b{n}"), F.col(f"_a{n}"))
        result.append((a + (pos - F.floor(pos)) * (b - a)).alias(n))
    return out.select(*[F.col(f"w._key.{c}").alias(c) for c in labels], "count", "sum", *result)


def token_estimate(text: Column | str) -> Column:
    """words * 1.3 (float)."""
    from sluice.operators.chunking import word_count
    return word_count(text) * TOKENS_PER_WORD


def cost_usd(input_tokens: Column, output_tokens: Column, cost_in_1k: Column,
             cost_out_1k: Column) -> Column:
    """in/1000*cin + out/1000*cout."""
    return input_tokens / 1000.0 * cost_in_1k + output_tokens / 1000.0 * cost_out_1k


def duration_ms(seconds: Column | str) -> Column:
    """round(s * 1000, 2)."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.round(s * 1000, 2)


def llm_usage(usage: DataFrame) -> DataFrame:
    """Per (provider, model, status, user; null user -> anonymous):
    requests; input/output tokens only where > 0; cost only where > 0;
    latency seconds."""
    def pos(c):
        return F.sum(F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(0.0)))
    return (usage.withColumn("user", F.coalesce(F.col("user_id").cast("string"), F.lit("anonymous")))
            .groupBy("provider", "model", "status", "user")
            .agg(F.count("*").alias("requests"), pos("input_tokens").alias("input_tokens"),
                 pos("output_tokens").alias("output_tokens"), pos("cost_usd").alias("cost_usd"),
                 F.sum("latency_s").alias("latency_s")))


def provider_stats(usage: DataFrame, providers: DataFrame) -> DataFrame:
    """Requests and failures per provider, with its configuration.

    ``providers`` is the (small, fixed) provider configuration; it is
    broadcast, the usage side is aggregated first."""
    per = usage.groupBy("provider").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") != "success").alias("failures"))
    return (F.broadcast(providers).join(per, "provider", "left")
            .select("provider", "priority", "enabled",
                    F.coalesce("requests", F.lit(0)).alias("requests"),
                    F.coalesce("failures", F.lit(0)).alias("failures")))


def provider_totals(stats: DataFrame) -> DataFrame:
    """A14 totals over the per-provider rows."""
    return stats.agg(F.count("*").alias("providers"), F.count_if("enabled").alias("enabled_providers"),
                     F.sum("requests").alias("requests"), F.sum("failures").alias("failures"))


def market_rollup(ticks: DataFrame, day: str, symbol: str, price: str) -> DataFrame:
    """Per day a map symbol -> (trades, average price). Per symbol
    first (partial aggregates), then the few symbols of a day."""
    per = ticks.groupBy(day, symbol).agg(F.count("*").alias("trades"), F.avg(price).alias("price"))
    return per.groupBy(day).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col(symbol), F.struct("trades", "price"))))).alias("symbols"))


def gauge_latest(samples: DataFrame, labels: Sequence[str], value: str = "value",
                 ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Last value per label set, ``max_by(value, (ts, tie))``."""
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    return samples.groupBy(*labels).agg(F.max_by(F.col(value), order).alias("value"),
                                        F.max(ts).alias("ts"))


def _recent(ts: str, as_of: Column, hours: float) -> Column:
    age = F.unix_micros(as_of) - F.unix_micros(F.col(ts).cast("timestamp"))
    return (age >= 0) & (age < int(hours * 3600 * 1_000_000))


def user_activity_stats(business: DataFrame, as_of: Column, hours: float = 24,
                        approx: bool = False) -> DataFrame:
    """A2: last ``hours`` (as_of - hours < ts <= as_of): per action and in total
    (action null) -> events and distinct users (one ROLLUP pass)."""
    ev = business.filter((F.col("kind") == "user_activity") & _recent("ts", as_of, hours))
    distinct = (F.approx_count_distinct("user_id") if approx else F.count_distinct("user_id"))
    return ev.rollup("action").agg(F.count("*").alias("events"), distinct.alias("unique_users"))


def revenue_stats(business: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    """A3: revenue events and amount per currency, and in total (currency null)."""
    ev = business.filter((F.col("kind") == "revenue") & _recent("ts", as_of, hours))
    return ev.rollup("currency").agg(F.count("*").alias("events"), F.sum("amount").alias("amount"))


def feature_stats(business: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    """A4: feature-usage events per feature and in total (feature null)."""
    ev = business.filter((F.col("kind") == "feature_usage") & _recent("ts", as_of, hours))
    return ev.rollup("feature").agg(F.count("*").alias("events"))


def error_rate(http_log: DataFrame, window: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Share of status >= 500 per tumbling window."""
    return (http_log.groupBy(F.window(F.col(ts).cast("timestamp"), window).alias("w"))
            .agg(F.count("*").alias("requests"),
                 F.avg((F.col("status_code") >= 500).cast("int")).alias("error_rate"))
            .select(F.col("w.start").alias("window_start"), "requests", "error_rate"))


def health_rollup(components: DataFrame, group: Sequence[str], healthy: str = "healthy") -> DataFrame:
    """Overall healthy = all components; any healthy (the LLM rule: one
    provider suffices); status healthy / degraded / unhealthy."""
    h = F.col(healthy)
    return (components.groupBy(*group)
            .agg(F.bool_and(h).alias("all_healthy"), F.bool_or(h).alias("any_healthy"),
                 F.count("*").alias("components"))
            .withColumn("status", F.when(F.col("all_healthy"), "healthy")
                        .when(F.col("any_healthy"), "degraded").otherwise("unhealthy")))


def retention(df: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """PF14: keep rows newer than as_of - days."""
    return df.filter(F.col(ts).cast("timestamp") > as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
