"""Reading the input tables and deriving the gateway-shaped views from them.

Every derived view is a projection (or a narrow join) over a driver table,
so its size grows with the input. The same derivations are repeated in SQL
in ``sluice.plans.oracle`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events "
          "documents embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ts_col(c: str = "ts") -> Column:
    """Event time as a session-zone TIMESTAMP (inputs load as TIMESTAMP_NTZ)."""
    return F.col(c).cast("timestamp")


def ts_micros(c: str = "ts") -> Column:
    return F.unix_micros(ts_col(c))


# ---------------------------------------------------------------- events ---
# Fixed values of the derivation (see FIXTURES.md section 3).
EVENT_ENDPOINT = {
    "view": "/api/v1/search",
    "click": "/api/v1/chat/generate",
    "purchase": "/api/v1/documents/upload",
    "signup": "/api/v1/auth/keys",
    "error": "/api/v1/chat/generate",
}


def _endpoint(col: Column) -> Column:
    expr = None
    for k, v in EVENT_ENDPOINT.items():
        expr = (F.when(col == k, v) if expr is None else expr.when(col == k, v))
    return expr.otherwise("/api/v1/status")


def http_log(events: DataFrame) -> DataFrame:
    """events -> http_log rows (request_id, ts, method, endpoint, ...)."""
    et = F.col("event_type")
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts"),
        F.col("user_id"),
        F.when(et.isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        _endpoint(et).alias("endpoint"),
        F.when(et == "error", F.lit(500)).otherwise(F.lit(200)).cast("int").alias("status_code"),
        (F.col("value") / 1000.0).alias("duration_s"),
        F.format_string("10.0.%d.%d", F.col("user_id") % 4, F.col("user_id")).alias("client_ip"),
        F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string")).alias("api_key"),
        F.round(F.col("value") * 100000).cast("long").alias("content_length"),
    )


def props_k(c: str = "props") -> Column:
    return F.get_json_object(F.col(c), "$.k").cast("long")


def business_events(events: DataFrame) -> DataFrame:
    """events -> business_events: every event is user_activity; purchases are
    revenue (currency by user parity); clicks are feature_usage."""
    base = events.select("event_id", "ts", "user_id", "event_type", "value",
                         props_k().alias("k"))
    activity = base.select(
        "event_id", "ts", "user_id", F.lit("user_activity").alias("kind"),
        F.col("event_type").alias("action"), F.lit(None).cast("string").alias("feature"),
        F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("currency"))
    revenue = base.filter(F.col("event_type") == "purchase").select(
        "event_id", "ts", "user_id", F.lit("revenue").alias("kind"),
        F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("feature"),
        F.col("value").alias("amount"),
        F.when(F.col("user_id") % 2 == 0, "USD").otherwise("EUR").alias("currency"))
    feature = base.filter(F.col("event_type") == "click").select(
        "event_id", "ts", "user_id", F.lit("feature_usage").alias("kind"),
        F.lit(None).cast("string").alias("action"),
        F.concat(F.lit("f"), F.col("k").cast("string")).alias("feature"),
        F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("currency"))
    return activity.unionByName(revenue).unionByName(feature)


def spans(events: DataFrame) -> DataFrame:
    """events -> spans: per user and day ordered by ts, parent = previous
    event; start = ts, end = ts + value ms; error rows have no end."""
    from pyspark.sql import Window as W
    w = W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    start = ts_col()
    end = F.timestamp_micros(ts_micros() + F.round(F.col("value") * 1000).cast("long"))
    return events.select(
        F.col("event_id").alias("span_id"),
        F.lag("event_id").over(w).alias("parent_span_id"),
        F.col("event_type").alias("operation"),
        F.col("user_id"),
        start.alias("start_ts"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("timestamp")).otherwise(end).alias("end_ts"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
    )


def cache_ops(events: DataFrame) -> DataFrame:
    """events -> cache operations: get on view/click, set on signup/purchase,
    delete on error; key = props.k; size = value*100; ttl 3600 s."""
    et = F.col("event_type")
    return events.select(
        F.col("event_id").alias("op_id"), F.col("ts"), F.col("user_id"),
        F.concat(F.lit("key:"), props_k().cast("string")).alias("key"),
        F.when(et.isin("view", "click"), "get").when(et.isin("signup", "purchase"), "set")
         .otherwise("delete").alias("op"),
        F.round(F.col("value") * 100).cast("long").alias("size_bytes"),
        F.lit(3600).cast("long").alias("ttl_s"),
        F.col("value"),
    )


def chat_requests(conversations: DataFrame) -> DataFrame:
    """User turns of conversations as chat requests."""
    prov = (F.when(F.col("conv_id") % 4 == 1, "openai")
             .when(F.col("conv_id") % 4 == 2, "anthropic")
             .when(F.col("conv_id") % 4 == 3, "ollama"))
    return (conversations.filter(F.col("role") == "user")
            .select((F.col("conv_id") * 100 + F.col("turn")).alias("request_id"),
                    F.col("conv_id").alias("user_id"), "conv_id", "turn",
                    F.col("text").alias("message"),
                    prov.alias("provider"),
                    ((F.col("turn") % 5) * 0.6).alias("temperature"),
                    (F.lit(1) + F.col("turn") * 700).cast("int").alias("max_tokens")))


def documents_meta(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """documents with chunk metadata: title, collection, and quality labels."""
    out = documents.select(
        "doc_id", "text", "lang", "source",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("collection"))
    if labels is not None:
        out = out.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    return out


SPREAD_CONF = "sluice.text.partitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread rows over the number of partitions that the caller has set
    in ``sluice.text.partitions``; without the setting the scan's own splits
    stay and no shuffle is added (the normal case at scale)."""
    n = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(n), key) if n else df


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text-heavy table (see ``spread``)."""
    return spread(table(spark, sf_dir, name), TEXT_KEYS[name])
