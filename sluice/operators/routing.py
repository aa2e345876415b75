"""Provider routing and pricing: J5 route_provider, J6 route_candidates,
J8 price_usage, W15 round_robin, W16 lb_counts, S2 provider_union_all.

The provider table is configuration (a handful of rows). Routing puts it
into the plan as a literal array and picks per row with higher-order
functions, so requests are never joined or shuffled for it; pricing
broadcasts the same table (its size is fixed by the configuration).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.timeline import running_counts

# Default provider configuration (type, models, USD per 1k
# input / output tokens, priority).
DEFAULT_PROVIDERS = [
    {"provider": "openai", "models": ["gpt-4", "gpt-3.5-turbo"],
     "cost_in_1k": 0.03, "cost_out_1k": 0.06, "priority": 1},
    {"provider": "anthropic", "models": ["claude-2", "claude-instant-1"],
     "cost_in_1k": 0.008, "cost_out_1k": 0.024, "priority": 2},
    {"provider": "ollama", "models": ["llama3", "codellama", "mistral"],
     "cost_in_1k": 0.0, "cost_out_1k": 0.0, "priority": 3},
]

PROVIDER_SCHEMA = ("provider string, models array<string>, cost_in_1k double, "
                   "cost_out_1k double, priority int, enabled boolean, healthy boolean, "
                   "rate_limit_rpm int")


def providers_df(spark: SparkSession, providers: list[dict] | None = None) -> DataFrame:
    """All providers of all types as one table (union of the configured
    lists)."""
    rows = [(p["provider"], p["models"], float(p["cost_in_1k"]), float(p["cost_out_1k"]),
             int(p["priority"]), bool(p.get("enabled", True)), bool(p.get("healthy", True)),
             int(p.get("rate_limit_rpm", 60)))
            for p in (providers or DEFAULT_PROVIDERS)]
    return spark.createDataFrame(rows, PROVIDER_SCHEMA)


def _provider_array(providers: list[dict]) -> Column:
    return F.array(*[F.struct(
        F.lit(p["provider"]).alias("provider"),
        F.array(*[F.lit(m) for m in p["models"]]).cast("array<string>").alias("models"),
        F.lit(int(p["priority"])).alias("priority"),
        F.lit(int(p.get("failures", 0))).alias("failures"),
        F.lit(int(p.get("requests", 0))).alias("requests"),
        F.lit(bool(p.get("enabled", True))).alias("enabled"),
        F.lit(bool(p.get("healthy", True))).alias("healthy")) for p in providers])


def route_candidates(provider: Column, model: Column,
                     providers: list[dict] | None = None) -> Column:
    """Ranked fallback list of provider names: same type when given;
    model listed (or the provider lists none); healthy and enabled; order by
    priority desc, failures, requests."""
    arr = _provider_array(providers or DEFAULT_PROVIDERS)
    ok = F.filter(arr, lambda p: (provider.isNull() | (p["provider"] == provider))
                  & (model.isNull() | (F.size(p["models"]) == 0)
                     | F.array_contains(p["models"], model))
                  & p["healthy"] & p["enabled"])
    ranked = F.array_sort(F.transform(ok, lambda p: F.struct(
        (-p["priority"]).alias("a"), p["failures"].alias("b"), p["requests"].alias("c"),
        p["provider"].alias("provider"))))
    return F.transform(ranked, lambda p: p["provider"])


def route_provider(requests: DataFrame, provider: str = "provider", model: str | None = None,
                   providers: list[dict] | None = None) -> DataFrame:
    """First candidate, or null with a reason."""
    m = F.col(model) if model else F.lit(None).cast("string")
    cands = route_candidates(F.col(provider), m, providers)
    return (requests.withColumn("candidates", cands)
            .withColumn("selected", F.element_at("candidates", 1))
            .withColumn("reason", F.when(F.size("candidates") == 0,
                                         F.lit("No available provider"))))


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage x price table (broadcast) -> cost_usd."""
    p = F.broadcast(prices.select("provider", "cost_in_1k", "cost_out_1k"))
    return (usage.join(p, "provider", "left")
            .withColumn("cost_usd",
                        F.coalesce(F.col("input_tokens") / 1000.0 * F.col("cost_in_1k")
                                   + F.col("output_tokens") / 1000.0 * F.col("cost_out_1k"),
                                   F.lit(0.0)))
            .drop("cost_in_1k", "cost_out_1k"))


def round_robin(requests: DataFrame, order: str, n_providers: int,
                names: list[str] | None = None) -> DataFrame:
    """With equal priority and no failures, the load order assigns
    providers cyclically: (rank - 1) % n over the request order (``order``
    identifies a request). The rank is computed distributed (range partitions
    + offsets), not in one task."""
    from sluice.operators.cache import global_running
    ranked = global_running(requests.withColumn("_one", F.lit(1)), [], order, "_one")
    out = ranked.withColumn("slot", ((F.col("rank") - 1) % n_providers).cast("int")).drop(
        "_one", "rank", "running_bytes")
    if names:
        out = out.withColumn("selected", F.element_at(F.array(*[F.lit(n) for n in names]),
                                                      F.col("slot") + 1))
    return out


def lb_counts(usage: DataFrame, order: str, slot_size: int = 100_000) -> DataFrame:
    """Running requests and failures per provider in the order of the
    request number, slot by slot of ``slot_size`` numbers."""
    return running_counts(usage, "provider", [order], F.floor(F.col(order) / slot_size), {
        "requests_so_far": F.lit(1), "failures_so_far": (F.col("status") != "success").cast("int")})
