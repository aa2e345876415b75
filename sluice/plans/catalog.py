"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query runs over whole driver tables (or views Spark derives from them)
and aliases every computed column to the name used by its oracle SQL in
``sluice.plans.oracle``. Doubles are rounded to 6 places for the check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import retrieval as rt
from sluice.operators import vector_index as vi
from sluice.plans import inputs as inp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# ----------------------------------------------------------- retrieval ---
SEARCH = dict(limit=5, offset=2, threshold=0.6)


@register("search_page")
def q_search_page(spark, sf_dir):
    page = rt.search_page(inp.vector_queries(spark, sf_dir), inp.vectors(spark, sf_dir),
                          texts=inp.vector_texts(spark, sf_dir), **SEARCH)
    return page.select("query_id", "chunk_id", "rank", "position", "total_results",
                       r6("similarity_score"), r6("vector_score"))


@register("knn_join")
def q_knn_join(spark, sf_dir):
    hits = rt.knn_join(inp.vector_queries(spark, sf_dir), inp.vectors(spark, sf_dir), 10)
    return hits.select("query_id", "chunk_id", "rank", r6("similarity_score"))


@register("metadata_filter")
def q_metadata_filter(spark, sf_dir):
    """PF1 inside J2: {lang: ["en", "de"], label: 3} (list of strings + number)."""
    hits = rt.knn_join(inp.vector_queries(spark, sf_dir), inp.vector_corpus(spark, sf_dir), 5,
                       filters={"lang": ["en", "de"], "label": 3})
    return hits.select("query_id", "chunk_id", "rank", r6("similarity_score"))


@register("similar_chunks")
def q_similar_chunks(spark, sf_dir):
    chunks = inp.vectors(spark, sf_dir)
    hits = rt.similar_chunks(chunks, 5, queries=chunks.filter(F.col("chunk_id") % 50 == 0))
    return hits.select("query_id", "chunk_id", "rank", r6("similarity_score"))


@register("rerank")
def q_rerank(spark, sf_dir):
    hits = rt.knn_join(inp.vector_queries(spark, sf_dir), inp.vectors(spark, sf_dir), 10,
                       payload=["content"], texts=inp.vector_texts(spark, sf_dir))
    return rt.rerank(hits).select("query_id", "chunk_id", "rank", r6("similarity_score"))


@register("top_sources")
def q_top_sources(spark, sf_dir):
    hits = rt.knn_join(inp.vector_queries(spark, sf_dir), inp.vectors(spark, sf_dir), 5,
                       payload=["content"], texts=inp.vector_texts(spark, sf_dir))
    return rt.top_sources(hits, 3).select("query_id", "chunk_id", "rank", "preview")


# ------------------------------------------------------------ chunking ---
from sluice.operators import chunking as ch  # noqa: E402
from sluice.sources import tables as tb  # noqa: E402

CHUNK_COLS = ["doc_id", "chunk_index", "chunk_id", "start_char", "end_char", "tokens_count",
              "content"]


def _docs(spark, sf_dir, paragraphs=False):
    d = tb.text_table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"))
    if paragraphs:   # the driver documents have no blank lines: lines become paragraphs
        d = d.withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    return d


def _chunk_query(strategy, paragraphs=False):
    def run(spark, sf_dir):
        c = ch.chunk(_docs(spark, sf_dir, paragraphs), strategy, keep=["title"])
        return ch.with_chunk_id(c).select(*CHUNK_COLS)
    return run


for _name, _strategy, _para in [("chunk_fixed", "fixed_size", False),
                                ("chunk_sentence", "sentence", False),
                                ("chunk_semantic", "semantic", False),
                                ("chunk_paragraph", "paragraph", True),
                                ("chunk_hybrid", "hybrid", True),
                                ("chunk_sliding", "sliding_window", False)]:
    register(_name)(_chunk_query(_strategy, _para))


# -------------------------------------------------------------- safety ---
from sluice.functions import safety as sfn  # noqa: E402
from sluice.operators import safety as sop  # noqa: E402


def _user_turns(spark, sf_dir):
    return tb.chat_requests(tb.text_table(spark, sf_dir, "conversations"))


@register("pii_detect")
def q_pii_detect(spark, sf_dir):
    return sop.pii_detect(tb.text_table(spark, sf_dir, "documents"), "doc_id")


@register("pii_mask")
def q_pii_mask(spark, sf_dir):
    return tb.text_table(spark, sf_dir, "documents").select(
        "doc_id", sfn.pii_mask("text").alias("masked"))


@register("pii_anonymize")
def q_pii_anonymize(spark, sf_dir):
    return tb.text_table(spark, sf_dir, "documents").select(
        "doc_id", sfn.pii_anonymize("text").alias("anonymized"))


@register("pii_stats")
def q_pii_stats(spark, sf_dir):
    f = sop.pii_detect(tb.text_table(spark, sf_dir, "documents"), "doc_id")
    return sop.pii_stats(f, "doc_id").select("entity_type", "detections", "documents",
                                             r6("best_score"))


@register("content_risk")
def q_content_risk(spark, sf_dir):
    d = tb.text_table(spark, sf_dir, "documents").withColumn("cr", sfn.content_risk("text"))
    return d.select("doc_id", F.col("cr.blocked").alias("blocked"),
                    F.round("cr.risk_score", 6).alias("risk_score"),
                    F.array_join("cr.reasons", "; ").alias("reasons"),
                    F.col("cr.filtered_content").isNull().alias("content_withheld"))


@register("injection_score")
def q_injection_score(spark, sf_dir):
    return tb.text_table(spark, sf_dir, "documents").select(
        "doc_id", F.round(sfn.injection_score("text"), 6).alias("injection_score"))


@register("suspicious_patterns")
def q_suspicious_patterns(spark, sf_dir):
    flags = sfn.suspicious_flags("html")
    return tb.text_table(spark, sf_dir, "pages").select(
        "page_id", F.concat(*[F.when(f, "1").otherwise("0") for f in flags]).alias("flags"))


@register("short_probe")
def q_short_probe(spark, sf_dir):
    return tb.text_table(spark, sf_dir, "documents").select(
        "doc_id", sfn.short_probe("text").alias("short_probe"),
        sfn.input_length_ok("text").alias("input_length_ok"))


@register("filter_stats")
def q_filter_stats(spark, sf_dir):
    docs = tb.text_table(spark, sf_dir, "documents").select("text")
    pages = tb.text_table(spark, sf_dir, "pages").select(F.col("html").alias("text"))
    return sop.filter_stats(docs.unionByName(pages))


@register("sanitize_input")
def q_sanitize_input(spark, sf_dir):
    s = sop.sanitize_input(_user_turns(spark, sf_dir), "message")
    return s.select("request_id", "blocked", r6("risk_score"), "sanitized")


@register("request_verdict")
def q_request_verdict(spark, sf_dir):
    v = sop.request_verdict(_user_turns(spark, sf_dir), "message")
    return v.select("request_id", "allowed", "pii_detected", r6("content_risk_score"),
                    "security_events")


@register("hash_sensitive")
def q_hash_sensitive(spark, sf_dir):
    return tb.text_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", sfn.hash_sensitive("text", "pepper-1").alias("hashed"))


# ------------------------------------------------------- usage & limits ---
from pyspark.sql import Window as W  # noqa: E402

from sluice.operators import alerts as al  # noqa: E402
from sluice.operators import cache as ca  # noqa: E402
from sluice.operators import limits as lm  # noqa: E402
from sluice.operators import routing as ro  # noqa: E402
from sluice.operators import traces as tr  # noqa: E402
from sluice.operators import usage as us  # noqa: E402

AS_OF_TEXT = "2024-01-30 00:00:00"


def _as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp")


def _events(spark, sf_dir):
    return tb.table(spark, sf_dir, "events")


def _http(spark, sf_dir):
    return tb.http_log(_events(spark, sf_dir))


@register("http_counters")
def q_http_counters(spark, sf_dir):
    return us.counter(_http(spark, sf_dir), ["method", "endpoint", "status_code"], name="requests")


@register("latency_histogram")
def q_latency_histogram(spark, sf_dir):
    h = us.histogram(_http(spark, sf_dir), "duration_s", ["method", "endpoint"])
    return h.select("method", "endpoint", "le", "bucket_count", "count", r6("sum"))


@register("summary_quantiles")
def q_summary_quantiles(spark, sf_dir):
    s = us.summary(_http(spark, sf_dir), "duration_s", ["endpoint"])
    return s.select("endpoint", "count", r6("sum"), r6("q50"), r6("q90"), r6("q95"), r6("q99"))


@register("error_rate")
def q_error_rate(spark, sf_dir):
    e = us.error_rate(_http(spark, sf_dir))
    return e.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "requests", r6("error_rate"))


@register("gauge_latest")
def q_gauge_latest(spark, sf_dir):
    g = us.gauge_latest(_events(spark, sf_dir), ["user_id"], tie="event_id")
    return g.select("user_id", r6("value"))


def _business(spark, sf_dir):
    return tb.business_events(_events(spark, sf_dir))


@register("user_activity_stats")
def q_user_activity_stats(spark, sf_dir):
    return us.user_activity_stats(_business(spark, sf_dir), _as_of())


@register("revenue_stats")
def q_revenue_stats(spark, sf_dir):
    r = us.revenue_stats(_business(spark, sf_dir), _as_of())
    return r.select("currency", "events", r6("amount"))


@register("feature_stats")
def q_feature_stats(spark, sf_dir):
    return us.feature_stats(_business(spark, sf_dir), _as_of())


@register("health_rollup")
def q_health_rollup(spark, sf_dir):
    comp = (_http(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "endpoint")
            .agg(F.avg((F.col("status_code") >= 500).cast("int")).alias("err"))
            .withColumn("healthy", F.col("err") <= 0.5))
    h = us.health_rollup(comp, ["day"])
    return h.select(F.col("day").cast("string").alias("day"), "all_healthy", "any_healthy",
                    "components", "status")


@register("rate_breach")
def q_rate_breach(spark, sf_dir):
    r = lm.rate_breach(_events(spark, sf_dir), limit=1)
    return r.select("event_id", "user_id", "requests_in_window", "breach")


@register("hourly_count")
def q_hourly_count(spark, sf_dir):
    return lm.hourly_count(_events(spark, sf_dir)).select("event_id", "requests_last_hour")


@register("rate_limit_admit")
def q_rate_limit_admit(spark, sf_dir):
    h = _http(spark, sf_dir).withColumn("bucket", F.concat_ws(":", "api_key", "client_ip"))
    r = lm.rate_limit_admit(h, "bucket", limit=3, seconds=6 * 3600)
    return r.select("request_id", "admitted", "in_window", "remaining")


def _failures(spark, sf_dir):
    return (_events(spark, sf_dir).filter(F.col("event_type") == "error")
            .withColumnRenamed("user_id", "identifier"))


@register("failed_attempts")
def q_failed_attempts(spark, sf_dir):
    return lm.failed_attempts(_failures(spark, sf_dir))


@register("flag_attempts")
def q_flag_attempts(spark, sf_dir):
    f = lm.flag_attempts(_failures(spark, sf_dir))
    return f.select("event_id", "identifier", "failures_so_far", "suspicious", "blocked")


@register("blocked_requests")
def q_blocked_requests(spark, sf_dir):
    req = _events(spark, sf_dir).withColumnRenamed("user_id", "identifier")
    return lm.blocked_requests(req, _failures(spark, sf_dir)).select("event_id", "identifier")


@register("repeat_requests")
def q_repeat_requests(spark, sf_dir):
    r = lm.repeat_requests(_events(spark, sf_dir), "user_id", "props", limit=10)
    return r.select("event_id", "repeats", "repeated")


# --------------------------------------------------------------- cache ---
def _ops(spark, sf_dir):
    return tb.cache_ops(_events(spark, sf_dir))


def _entries(spark, sf_dir):
    return ca.entries_as_of(_ops(spark, sf_dir), _as_of())


def _levels(spark, sf_dir):
    e = _entries(spark, sf_dir)
    k = F.substring_index("key", ":", -1).cast("long")
    return e.filter(k % 2 == 0), e.filter(k % 3 == 0)


@register("cache_stats")
def q_cache_stats(spark, sf_dir):
    s = ca.cache_stats(ca.replay(_ops(spark, sf_dir)))
    return s.select("hits", "misses", "sets", "deletes", "evictions", "errors", r6("hit_ratio"))


@register("cache_lookup")
def q_cache_lookup(spark, sf_dir):
    gets = _ops(spark, sf_dir).filter(F.col("op") == "get").select("op_id", "key")
    l1, l2 = _levels(spark, sf_dir)
    r = ca.cache_lookup(gets, l1, l2, _as_of())
    return r.select("op_id", "key", "hit_level", "promoted", r6("value"))


@register("key_exists")
def q_key_exists(spark, sf_dir):
    keys = _ops(spark, sf_dir).select("key").distinct()
    l1, l2 = _levels(spark, sf_dir)
    return ca.key_exists(keys, l1, l2, _as_of())


@register("hot_keys")
def q_hot_keys(spark, sf_dir):
    h = ca.hot_keys(_ops(spark, sf_dir), _as_of(), limit=50)
    return h.select("key", "freq", F.round("score", 9).alias("score"))


@register("missing_keys")
def q_missing_keys(spark, sf_dir):
    hot = ca.hot_keys(_ops(spark, sf_dir), _as_of(), limit=50).select("key")
    l1, l2 = _levels(spark, sf_dir)
    return ca.missing_keys(hot, l1, l2, _as_of())


@register("lru_evict")
def q_lru_evict(spark, sf_dir):
    plan = ca.lru_evict(_entries(spark, sf_dir), _as_of(), max_entries=50, max_bytes=1_000_000)
    return plan.select("key", "kept", "reason", "rank", "running_bytes")


@register("coalesce_writes")
def q_coalesce_writes(spark, sf_dir):
    sets = _ops(spark, sf_dir).filter(F.col("op") == "set").withColumn(
        "ttl_s", F.when(F.col("op_id") % 3 != 0, F.col("op_id") % 7 * 600))
    batch = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (5 * 1_000_000)).cast("long")
    c = ca.coalesce_writes(sets, batch)
    return c.select("batch", "key", r6("value"), "ttl_s")


# ---------------------------------------------------- routing and costs ---
def _usage(spark, sf_dir):
    conv = tb.text_table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    a = conv.withColumn("prompt", F.lag("text").over(w)).filter(F.col("role") == "assistant")
    requested = (F.when(F.col("conv_id") % 4 == 1, "openai")
                 .when(F.col("conv_id") % 4 == 2, "anthropic")
                 .when(F.col("conv_id") % 4 == 3, "ollama"))
    a = ro.route_provider(a.withColumn("requested", requested), "requested")
    model = F.element_at(
        F.create_map(*[x for p in ro.DEFAULT_PROVIDERS for x in (F.lit(p["provider"]),
                                                                  F.lit(p["models"][0]))]),
        F.col("selected"))
    u = a.select(
        (F.col("conv_id") * 100 + F.col("turn") - 1).alias("request_id"),
        F.when(F.col("conv_id") % 5 == 0, F.lit(None)).otherwise(F.col("conv_id") % 50)
         .cast("long").alias("user_id"),
        F.col("selected").alias("provider"), model.alias("model"),
        F.when(F.col("conv_id") % 10 == 0, "error").otherwise("success").alias("status"),
        us.token_estimate(F.coalesce("prompt", F.lit(""))).alias("input_tokens"),
        us.token_estimate("text").alias("output_tokens"))
    u = u.withColumn("latency_s", F.col("output_tokens") * 0.02)
    return ro.price_usage(u, ro.providers_df(spark))


@register("route_provider")
def q_route_provider(spark, sf_dir):
    r = ro.route_provider(_user_turns(spark, sf_dir), "provider")
    return r.select("request_id", "selected", F.array_join("candidates", ",").alias("candidates"))


@register("price_usage")
def q_price_usage(spark, sf_dir):
    u = _usage(spark, sf_dir)
    return u.select("request_id", "provider", "model", "status", r6("input_tokens"),
                    r6("output_tokens"), r6("cost_usd"))


@register("llm_usage")
def q_llm_usage(spark, sf_dir):
    u = us.llm_usage(_usage(spark, sf_dir))
    return u.select("provider", "model", "status", "user", "requests", r6("input_tokens"),
                    r6("output_tokens"), r6("cost_usd"), r6("latency_s"))


@register("provider_stats")
def q_provider_stats(spark, sf_dir):
    return us.provider_stats(_usage(spark, sf_dir), ro.providers_df(spark))


@register("lb_counts")
def q_lb_counts(spark, sf_dir):
    c = ro.lb_counts(_usage(spark, sf_dir), "request_id")
    return c.select("request_id", "provider", "requests_so_far", "failures_so_far")


# -------------------------------------------------------------- traces ---
def _spans(spark, sf_dir):
    s = tb.spans(_events(spark, sf_dir))
    w = W.partitionBy("user_id", F.to_date("start_ts")).orderBy("start_ts", "span_id")
    return s.withColumn("trace_id", F.first("span_id").over(w))


def _pairs(spark, sf_dir):
    s = _spans(spark, sf_dir).withColumn("tags", F.create_map(
        F.lit("op"), F.col("operation"), F.lit("state"), F.lit("open"))) \
        .withColumn("logs", F.array(F.concat(F.lit("start:"), F.col("span_id").cast("string"))))
    fin = s.filter(F.col("end_ts").isNotNull()).select(
        "span_id", "end_ts", "status",
        F.create_map(F.lit("state"), F.lit("closed"), F.lit("user"), F.col("user_id").cast("string")).alias("tags"),
        F.array(F.concat(F.lit("end:"), F.col("status"))).alias("logs"))
    return tr.span_pairs(s.drop("end_ts", "status"), fin)


@register("span_pairs")
def q_span_pairs(spark, sf_dir):
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]))), ",")
    return _pairs(spark, sf_dir).select("span_id", "trace_id", r6("duration_ms"), "active", "status",
                                        text("tags").alias("tags"), F.array_join("logs", ",").alias("logs"))


@register("trace_stats")
def q_trace_stats(spark, sf_dir):
    return tr.trace_stats(_pairs(spark, sf_dir)).select("active_spans", "completed_spans",
                                                        r6("avg_duration_ms"))


@register("trace_roots")
def q_trace_roots(spark, sf_dir):
    return tr.trace_roots(_spans(spark, sf_dir))


@register("trace_sample")
def q_trace_sample(spark, sf_dir):
    return tr.trace_sample(_spans(spark, sf_dir)).select("span_id", "trace_id")


# -------------------------------------------------------------- alerts ---
RULES = [
    {"name": "purchase_high", "metric": "purchase", "condition": "> 150", "threshold": 150,
     "severity": "high", "cooldown_s": 86400},
    {"name": "click_ge", "metric": "click", "condition": ">= 100", "threshold": 100.0,
     "severity": "medium", "cooldown_s": 3600},
    {"name": "view_le", "metric": "view", "condition": "<= 1", "threshold": 1.0,
     "severity": "low", "cooldown_s": 300},
]


def _matches(spark, sf_dir):
    samples = _events(spark, sf_dir).withColumnRenamed("event_type", "metric")
    return al.alert_match(samples, al.rules_df(spark, RULES))


@register("alert_match")
def q_alert_match(spark, sf_dir):
    return _matches(spark, sf_dir).select("name", "event_id", r6("value"))


@register("alert_cooldown")
def q_alert_cooldown(spark, sf_dir):
    return al.alert_cooldown(_matches(spark, sf_dir)).select("name", "event_id")


@register("alert_stats")
def q_alert_stats(spark, sf_dir):
    fired = al.alert_cooldown(_matches(spark, sf_dir)).withColumn("resolved", F.lit(False))
    return al.alert_stats(fired)


@register("token_estimate")
def q_token_estimate(spark, sf_dir):
    c = tb.text_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.round(us.token_estimate("text"), 6).alias("tokens"))


# ----------------------------------------------------------- streaming ---
from sluice.streaming import core as st  # noqa: E402


@register("stream_counters")
def q_stream_counters(spark, sf_dir):
    c = st.stream_counters(st.event_stream(spark, sf_dir))
    out = st.run_latest(c, ["w", "event_type"], "stream_counters")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "event_type", "requests", r6("value_sum"))


@register("stream_rate_limit")
def q_stream_rate_limit(spark, sf_dir):
    ev = st.event_stream(spark, sf_dir)
    h = tb.http_log(ev).withColumn("bucket", F.concat_ws(":", "api_key", "client_ip"))
    out = st.run_available(st.stream_rate_limit(h, "bucket", limit=3, seconds=6 * 3600,
                                                watermark="7 hours"),
                           "append", "stream_rate_limit")
    return out.select("request_id", "admitted", "in_window", "remaining")


# ------------------------------------------------- sources, html, rag ---
from sluice.functions import html as fh  # noqa: E402
from sluice.functions import markup as mk  # noqa: E402
from sluice.functions import requests as rq  # noqa: E402
from sluice.functions import vectors as vec  # noqa: E402
from sluice.operators import rag  # noqa: E402
from sluice.sources import files as fl  # noqa: E402
from sluice.sources import collections as cl  # noqa: E402
from sluice.sources import digests as dg  # noqa: E402
from sluice.sources import sinks as sk  # noqa: E402


@register("html_to_text")
def q_html_to_text(spark, sf_dir):
    return tb.text_table(spark, sf_dir, "pages").select("page_id", fh.html_to_text("html").alias("text"))


@register("page_scrape")
def q_page_scrape(spark, sf_dir):
    return rag.page_scrape(tb.text_table(spark, sf_dir, "pages")).select(
        "page_id", "url", "title", "content", "links")


@register("extract_links")
def q_extract_links(spark, sf_dir):
    return rag.extract_links(tb.text_table(spark, sf_dir, "pages"))


@register("title_from_url")
def q_title_from_url(spark, sf_dir):
    return tb.table(spark, sf_dir, "pages").select(
        "page_id", fl.title_from_url(F.col("url")).alias("title"))


@register("url_documents")
def q_url_documents(spark, sf_dir):
    return fl.url_documents(tb.text_table(spark, sf_dir, "pages")).select(
        "doc_id", "title", "source_url", "document_type", "file_size")


def _raw(spark, sf_dir):
    return fl.raw_documents(tb.text_table(spark, sf_dir, "documents"))


@register("doc_type_ext")
def q_doc_type_ext(spark, sf_dir):
    return _raw(spark, sf_dir).select("doc_id", fl.doc_type_ext(F.col("file_path")).alias("document_type"))


@register("upload_filter")
def q_upload_filter(spark, sf_dir):
    return fl.upload_filter(_raw(spark, sf_dir)).select("doc_id", "extension", "accepted", "reason")


@register("decode_text")
def q_decode_text(spark, sf_dir):
    """Every third file carries bytes that are not UTF-8; they are dropped."""
    bad = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("content"), F.unhex(F.lit("FFFE80"))))
    raw = _raw(spark, sf_dir).withColumn("content", F.coalesce(bad, F.col("content")))
    return raw.select("doc_id", fl.decode_text(F.col("content")).alias("text"),
                      F.octet_length("content").alias("file_size"))


@register("ingest_report")
def q_ingest_report(spark, sf_dir):
    raw = fl.upload_filter(_raw(spark, sf_dir))
    ok = raw.filter("accepted").select("doc_id", fl.decode_text(F.col("content")).alias("text"))
    chunks = ch.chunk(ok, "sliding_window")
    return sk.ingest_report(chunks, ok)


@register("collection_stats")
def q_collection_stats(spark, sf_dir):
    d = tb.documents_meta(tb.text_table(spark, sf_dir, "documents"))
    return rag.collection_stats(ch.chunk(d, "sliding_window", keep=["collection"]))


@register("embed")
def q_embed(spark, sf_dir):
    e = vec.embed_sparse(tb.text_table(spark, sf_dir, "documents"), "doc_id", "text")
    return e.select("doc_id", "dim_index", r6("weight"))


def _rag_hits(spark, sf_dir):
    return rt.knn_join(inp.vector_queries(spark, sf_dir), inp.vector_corpus(spark, sf_dir), 5,
                       payload=["content", "title"])


@register("rag_context")
def q_rag_context(spark, sf_dir):
    return rag.rag_context(_rag_hits(spark, sf_dir))


@register("rag_prompt")
def q_rag_prompt(spark, sf_dir):
    ctx = rag.rag_context(_rag_hits(spark, sf_dir))
    q = F.concat(F.lit("What is document "), F.col("query_id").cast("string"), F.lit(" about?"))
    return ctx.select("query_id", F.md5(rq.rag_prompt(q, F.col("context"))).alias("prompt_md5"))


@register("chat_messages")
def q_chat_messages(spark, sf_dir):
    m = rag.chat_messages(tb.text_table(spark, sf_dir, "conversations"))
    said = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("\n"), x["content"])), "\n")
    return m.select("conv_id", "turn", F.size("messages").alias("n_messages"),
                    F.sha2(said, 256).alias("messages_sha256"))


@register("last_n")
def q_last_n(spark, sf_dir):
    return rag.last_n(_events(spark, sf_dir), "user_id", "ts", 5, "event_id").select("user_id", "event_id")


@register("validate_chat")
def q_validate_chat(spark, sf_dir):
    r = _user_turns(spark, sf_dir).withColumn(
        "reasons", rq.validate_chat("message", "temperature", "max_tokens", "provider"))
    return r.select("request_id", (F.size("reasons") == 0).alias("valid"),
                    F.array_join("reasons", "; ").alias("reasons"))


def _headers(spark, sf_dir):
    h = _http(spark, sf_dir)
    u = F.col("user_id")
    return h.select(
        "request_id", "content_length",
        F.when(u % 3 == 0, F.concat(F.lit(" 172.16."), (u % 7).cast("string"), F.lit(".1 , "),
                                    F.col("client_ip"))).alias("x_forwarded_for"),
        F.when(u % 3 == 1, F.col("client_ip")).alias("x_real_ip"),
        F.when(u % 5 != 0, F.col("client_ip")).alias("peer"),
        F.when(u % 4 == 0, F.concat(F.lit("key-"), F.col("api_key"), F.lit("-long"))).alias("x_api_key"),
        F.when(u % 4 == 1, F.concat(F.lit("Bearer "), F.col("api_key"))).alias("authorization"),
        F.when(u % 10 == 0, F.lit("Googlebot/2.1 (+http://www.google.com/bot.html)"))
         .when(u % 10 == 1, F.lit("python-Scraper/1.0")).otherwise(F.lit("Mozilla/5.0")).alias("user_agent"),
        F.when(u % 6 == 0, F.lit("http")).otherwise(F.lit("https")).alias("scheme"))


@register("client_ip")
def q_client_ip(spark, sf_dir):
    return _headers(spark, sf_dir).select(
        "request_id", rq.client_ip("x_forwarded_for", "x_real_ip", "peer").alias("client_ip"))


@register("api_key_norm")
def q_api_key_norm(spark, sf_dir):
    return _headers(spark, sf_dir).select(
        "request_id", rq.api_key_norm("x_api_key", "authorization").alias("api_key"))


@register("key_prefix")
def q_key_prefix(spark, sf_dir):
    return _headers(spark, sf_dir).select(
        "request_id", rq.key_prefix(rq.api_key_norm("x_api_key", "authorization")).alias("key_prefix"))


@register("suspicious_ua")
def q_suspicious_ua(spark, sf_dir):
    return _headers(spark, sf_dir).select("request_id", rq.suspicious_ua("user_agent").alias("suspicious"))


@register("request_size_ok")
def q_request_size_ok(spark, sf_dir):
    return _headers(spark, sf_dir).select(
        "request_id", rq.request_size_ok("content_length", 20_000_000).alias("size_ok"))


@register("require_https")
def q_require_https(spark, sf_dir):
    return _headers(spark, sf_dir).select("request_id", rq.require_https("scheme").alias("allowed"))


KEYS_ROTATION = ["k0", "k1"]
KEY_SINGLE = "k1"


def _keys(spark):
    rot = spark.createDataFrame([(k,) for k in KEYS_ROTATION], "api_key string")
    return rot.union(spark.createDataFrame([(KEY_SINGLE,)], "api_key string")).distinct()


@register("key_union")
def q_key_union(spark, sf_dir):
    """Configured keys and the keys seen in the request log, each once."""
    seen = _http(spark, sf_dir).select("api_key")
    return _keys(spark).union(seen).distinct()


@register("valid_keys")
def q_valid_keys(spark, sf_dir):
    keys = F.broadcast(_keys(spark).withColumn("valid", F.lit(True)))      # configuration
    return (_http(spark, sf_dir).select("request_id", "api_key").join(keys, "api_key", "left")
            .withColumn("valid", F.coalesce("valid", F.lit(False))))


# Exception class -> (error_code, HTTP status).
ERROR_CATALOG = [
    ("ValidationError", "VALIDATION_ERROR", 422), ("AuthenticationError", "AUTHENTICATION_ERROR", 401),
    ("AuthorizationError", "AUTHORIZATION_ERROR", 403), ("RateLimitExceededError", "RATE_LIMIT_EXCEEDED", 429),
    ("LLMProviderError", "LLM_PROVIDER_ERROR", 502), ("VectorDatabaseError", "VECTOR_DATABASE_ERROR", 502),
    ("CacheError", "CACHE_ERROR", 500), ("PluginError", "PLUGIN_ERROR", 500),
    ("PluginExecutionError", "PLUGIN_EXECUTION_ERROR", 500), ("PluginTimeoutError", "PLUGIN_TIMEOUT_ERROR", 408),
    ("SecurityError", "SECURITY_ERROR", 403), ("PIIDetectionError", "PII_DETECTION_ERROR", 500),
    ("FileProcessingError", "FILE_PROCESSING_ERROR", 422), ("ConfigurationError", "CONFIGURATION_ERROR", 500),
    ("ServiceUnavailableError", "SERVICE_UNAVAILABLE", 503), ("ContentTooLargeError", "CONTENT_TOO_LARGE", 413),
    ("NotFoundError", "NOT_FOUND", 404), ("DatabaseError", "DATABASE_ERROR", 500),
]


@register("error_catalog")
def q_error_catalog(spark, sf_dir):
    cat = spark.createDataFrame(ERROR_CATALOG, "exception string, error_code string, status_code int")
    names = F.array(*[F.lit(e[0]) for e in ERROR_CATALOG])
    errs = (_events(spark, sf_dir).filter(F.col("event_type") == "error")
            .select("event_id", F.element_at(names, (F.col("user_id") % len(ERROR_CATALOG) + 1)
                                             .cast("int")).alias("exception")))
    return errs.join(F.broadcast(cat), "exception", "left").select(
        "event_id", "exception", "error_code", "status_code")


REPUTATION = [("blog.tionsh.example.net", False, "spam", 0.9),
              ("thther.example.org", True, "news", 0.1),
              ("blog.tionsh.example.com", False, "malware", 0.95)]


@register("domain_reputation")
def q_domain_reputation(spark, sf_dir):
    rep = spark.createDataFrame(REPUTATION, "host string, safe boolean, category string, risk_score double")
    p = tb.table(spark, sf_dir, "pages").select("page_id", rq.url_host("url").alias("host"))
    return (p.join(F.broadcast(rep), "host", "left")
            .select("page_id", "host", F.coalesce("safe", F.lit(True)).alias("safe"),
                    F.coalesce("category", F.lit("unknown")).alias("category"),
                    F.coalesce("risk_score", F.lit(0.0)).alias("risk_score")))


@register("domain_allowed")
def q_domain_allowed(spark, sf_dir):
    allowed = [r[0] for r in REPUTATION if r[1]] + ["blog.ththan.example.net"]
    return tb.table(spark, sf_dir, "pages").select(
        "page_id", rq.domain_allowed("url", allowed).alias("allowed"))


@register("retention")
def q_retention(spark, sf_dir):
    return us.retention(_events(spark, sf_dir), _as_of(), 7).select("event_id")


@register("prom_text")
def q_prom_text(spark, sf_dir):
    c = us.counter(_http(spark, sf_dir), ["method", "endpoint", "status_code"], name="value")
    m = c.select(F.lit("http_requests_total").alias("metric"),
                 F.create_map(F.lit("method"), "method", F.lit("endpoint"), "endpoint",
                              F.lit("status"), F.col("status_code").cast("string")).alias("labels"),
                 "value")
    return m.select(sk.prom_text(m).alias("line"))


@register("parse_request_log")
def q_parse_request_log(spark, sf_dir):
    h = _http(spark, sf_dir).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    lines = h.select(F.to_json(F.struct("request_id", "ts", "method", "endpoint", "status_code",
                                        "duration_s", "client_ip", "api_key", "content_length"))
                     .alias("value"))
    p = fl.parse_request_log(lines)
    return p.select("request_id", "ts", "method", "endpoint", "status_code", r6("duration_s"),
                    "client_ip", "api_key", "content_length")


@register("duration_ms")
def q_duration_ms(spark, sf_dir):
    return _http(spark, sf_dir).select("request_id", us.duration_ms("duration_s").alias("duration_ms"))


@register("cache_key")
def q_cache_key(spark, sf_dir):
    r = _user_turns(spark, sf_dir)
    k = ca.cache_key(F.lit("chat"), F.coalesce("provider", F.lit("any")),
                     F.col("max_tokens").cast("string"),
                     ca.nested_part(F.struct(F.col("message").alias("message"))))
    return r.select("request_id", k.alias("cache_key"))


@register("round_robin")
def q_round_robin(spark, sf_dir):
    names = [p["provider"] for p in ro.DEFAULT_PROVIDERS]
    rr = ro.round_robin(_user_turns(spark, sf_dir), "request_id", len(names), names)
    return rr.select("request_id", "selected")


@register("cache_stats_combined")
def q_cache_stats_combined(spark, sf_dir):
    rp = ca.replay(_ops(spark, sf_dir)).withColumn(
        "level", F.when(F.substring_index("key", ":", -1).cast("long") % 2 == 0, "L1").otherwise("L2"))
    s = ca.cache_stats_combined(ca.cache_stats(rp, ["level"]))
    return s.select("hits", "misses", r6("hit_ratio"))


@register("latest_quote")
def q_latest_quote(spark, sf_dir):
    """Per symbol (event type) last price, change to the previous tick,
    percent and volume."""
    ev = _events(spark, sf_dir).withColumnRenamed("event_type", "symbol").select(
        "symbol", "ts", "event_id", "value")
    # the two newest ticks per symbol: a group limit runs before the shuffle
    newest = W.partitionBy("symbol").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    last = (ev.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= 2)
            .groupBy("symbol").agg(F.max(F.when(F.col("_rn") == 1, F.col("value"))).alias("price"),
                                   F.max(F.when(F.col("_rn") == 2, F.col("value"))).alias("prev")))
    q = last.join(ev.groupBy("symbol").agg(F.count("*").alias("volume")), "symbol")
    return q.select("symbol", F.round("price", 6).alias("price"),
                    F.round(F.col("price") - F.col("prev"), 6).alias("change"),
                    F.round((F.col("price") - F.col("prev")) / F.col("prev") * 100, 6).alias("percent"),
                    "volume")


@register("knn_recall")
def q_knn_recall(spark, sf_dir):
    """Recall of J3 against J2 at 10 over the whole query set, and the share of
    all pairs that J3 scores."""
    q, c = inp.vector_queries(spark, sf_dir), inp.vectors(spark, sf_dir)
    index = vi.build(c)
    found, pairs = vi.search(index, q, 10)
    r = rt.recall_at_k(found, rt.knn_join(q, c, 10))
    share = vi.touched_share(index, q.count(), pairs)
    return r.select(r6("recall"), (F.col("recall") >= 0.9).alias("enough"),
                    F.round(F.lit(share), 6).alias("touched_share"), F.lit(len(index.centres)).alias("cells"),
                    F.lit(index.probes).alias("probes"))


@register("knn_approx")
def q_knn_approx(spark, sf_dir):
    a = vi.knn_approx(inp.vector_queries(spark, sf_dir), inp.vectors(spark, sf_dir), 10)
    return a.select("query_id", "chunk_id", "rank", r6("similarity_score"))


# ------------------------------------------------------------- plug-ins ---
from sluice.functions import plugins as pl  # noqa: E402

PRICING_SQL = """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM {lineitem} WHERE l_shipdate <= DATE '1998-09-02'
GROUP BY l_returnflag, l_linestatus"""


@register("sql_query")
def q_sql_query(spark, sf_dir):
    tb.table(spark, sf_dir, "lineitem").createOrReplaceTempView("sluice_lineitem")
    df = pl.sql_query(spark, PRICING_SQL.format(lineitem="sluice_lineitem"))
    return df.select("l_returnflag", "l_linestatus", F.col("sum_qty").cast("double").alias("sum_qty"),
                     F.col("revenue").cast("double").alias("revenue"), F.col("n").cast("long").alias("n"))


@register("links_udtf")
def q_links_udtf(spark, sf_dir):
    spark.udtf.register("sluice_links", pl.links_udtf())
    tb.text_table(spark, sf_dir, "pages").createOrReplaceTempView("sluice_pages")
    return spark.sql("SELECT p.page_id, l.pos, l.text, l.href "
                     "FROM sluice_pages p, LATERAL sluice_links(p.html) l")


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    out = st.run_available(st.stream_ingest(st.document_stream(spark, sf_dir)), "append",
                           "stream_ingest")
    return out.select(*CHUNK_COLS)


@register("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    ev = st.event_stream(spark, sf_dir).withColumn(
        "cache_key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return st.run_available(st.stream_dedup(ev, "cache_key"), "append", "stream_dedup")


@register("stream_gauges")
def q_stream_gauges(spark, sf_dir):
    out = st.run_latest(st.stream_gauges(st.event_stream(spark, sf_dir)), ["w", "user_id"], "stream_gauges")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "user_id", r6("value"))


@register("stream_cache_ttl")
def q_stream_cache_ttl(spark, sf_dir):
    ops = tb.cache_ops(st.event_stream(spark, sf_dir))
    out = st.run_available(st.stream_cache_ttl(ops), "append", "stream_cache_ttl")
    return out.select("op_id", "key", "status", "until_us")


@register("stream_write_behind")
def q_stream_write_behind(spark, sf_dir):
    sets = tb.cache_ops(st.event_stream(spark, sf_dir)).filter(F.col("op") == "set")
    return st.write_behind(sets).select("key", r6("value"), "last_seq", "flush_at", "flush_no")


@register("stream_spans")
def q_stream_spans(spark, sf_dir):
    """ST7: starts and finishes as two streams; a closing row on both moves the
    watermarks past the last start, so spans without a finish within the hour
    come out as active."""
    s = _spans(spark, sf_dir).select("span_id", "start_ts", "end_ts")
    starts, ends = s.select("span_id", "start_ts"), s.filter("end_ts IS NOT NULL").select(
        F.col("span_id").alias("fspan_id"), "end_ts")
    into = [st.split_by_time(starts, "starts", "start_ts"), st.split_by_time(ends, "ends", "end_ts")]
    st.close_stream(spark, into[0], starts.schema, {"span_id": -1, "start_ts": "9999-01-01"})
    st.close_stream(spark, into[1], ends.schema, {"fspan_id": -2, "end_ts": "9999-01-01"})
    a = st.file_stream(spark, into[0], starts.schema)
    b = st.file_stream(spark, into[1], ends.schema)
    out = st.run_available(st.stream_spans(a, b, watermark="1 day"), "append", "stream_spans")
    return out.filter("span_id >= 0").select("span_id", r6("duration_ms"), "active")


def _answer_chunks(spark, sf_dir):
    """Assistant texts as streamed answers: pieces of 50 characters in order,
    the last one done; every tenth conversation ends with an error row."""
    c = tb.table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    n = F.greatest(F.ceil(F.length("text") / 50), F.lit(1)).cast("int")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "conv_id", "text",
                    n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    said = rows.select("request_id", "seq", F.substr("text", F.col("seq") * 50 + 1, F.lit(50)).alias("chunk"),
                       (F.col("seq") == F.col("n") - 1).alias("done"), F.lit(False).alias("is_error"))
    errors = rows.filter((F.col("conv_id") % 10 == 0) & (F.col("seq") == F.col("n") - 1)).select(
        "request_id", F.col("n").alias("seq"), F.lit("Error: upstream").alias("chunk"),
        F.lit(False).alias("done"), F.lit(True).alias("is_error"))
    both = said.unionByName(errors)
    return both.withColumn("ts", F.timestamp_micros((F.col("request_id") * 1000 + F.col("seq")) * 1000))


def _answer_stream(spark, sf_dir):
    rows = _answer_chunks(spark, sf_dir)
    return st.file_stream(spark, st.split_by_time(rows, "answers"), rows.schema)


@register("stream_chunks_sanitize")
def q_stream_chunks_sanitize(spark, sf_dir):
    out = st.run_available(st.stream_chunks_sanitize(_answer_stream(spark, sf_dir)), "append", "stream_chunks")
    return out.select("request_id", "seq", "chunk", "done", "is_error")


@register("assemble_stream")
def q_assemble_stream(spark, sf_dir):
    return st.run_latest(st.assemble_answers(_answer_stream(spark, sf_dir)), ["request_id"], "assemble")


@register("stream_business")
def q_stream_business(spark, sf_dir):
    """ST11; sketches of 2**18 registers count up to 196,608 users exactly."""
    b = tb.business_events(st.event_stream(spark, sf_dir))
    out = st.business_days(st.run_latest(st.stream_business(b, lg=18), ["w", "kind"], "stream_business"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "kind", "events",
                      "unique_users")


@register("stream_alerts")
def q_stream_alerts(spark, sf_dir):
    samples = st.event_stream(spark, sf_dir).withColumnRenamed("event_type", "metric")
    m = al.alert_match(samples, al.rules_df(spark, RULES))
    return st.run_available(st.stream_alerts(m), "append", "stream_alerts")


@register("stream_threats")
def q_stream_threats(spark, sf_dir):
    ev = st.event_stream(spark, sf_dir)
    t = st.stream_threats(ev, limit=1, text_col="props", failed=F.col("event_type") == "error")
    return st.run_available(t, "append", "stream_threats")


# ------------------------------------------------ ingest and collections ---
import uuid  # noqa: E402

from sluice.session import scratch_path  # noqa: E402


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("ingest")
def q_ingest(spark, sf_dir):
    """Documents -> hybrid chunks -> ids -> vectors -> collection (written,
    read back): SRC10, J1, E1."""
    d = tb.documents_meta(_docs(spark, sf_dir, True).drop("title").withColumn("source", F.lit("docs"))
                          .withColumn("lang", F.lit("any")))
    path = _fresh(spark, "collection")
    sk.write_chunks(rag.ingest(d, "hybrid", keep=["title", "collection"]), path)
    rows = spark.read.parquet(path).withColumn("u", vec.used_dims("embedding"))
    return rows.select("chunk_id", "doc_id", "collection", "chunk_index", "content", "u.dims", "u.dim_sum")


def _collection(spark, sf_dir):
    c = ch.with_chunk_id(ch.chunk(_docs(spark, sf_dir, False), "sliding_window", keep=["title"]))
    return c.select("chunk_id", "doc_id", "chunk_index", "content")


def _table(spark, rows):
    """The collection as a written table of one version."""
    t = cl.ChunkTable(spark, _fresh(spark, "chunks"))
    t.append(rows)
    return t


@register("delete_chunks")
def q_delete_chunks(spark, sf_dir):
    c = _collection(spark, sf_dir)
    t = _table(spark, c)
    t.delete(t.read().filter(F.col("chunk_index") % 3 == 1).select("chunk_id"))
    return t.read().select("chunk_id", "doc_id")


@register("delete_document")
def q_delete_document(spark, sf_dir):
    c = _collection(spark, sf_dir)
    t = _table(spark, c)
    t.delete_documents(t.read().filter(F.col("doc_id") % 4 == 0).select("doc_id"))
    t.compact()
    return t.read().select("chunk_id", "doc_id")


@register("upsert_chunks")
def q_upsert_chunks(spark, sf_dir):
    """Two updates of every first chunk (the second wins) and one new chunk
    per third document."""
    c = _collection(spark, sf_dir).withColumn("version", F.lit(0))
    t = _table(spark, c)
    first = t.read().filter(F.col("chunk_index") == 0)
    one = first.withColumn("content", F.lit("stale")).withColumn("version", F.lit(1))
    two = first.withColumn("content", F.concat(F.lit("v2 "), "content")).withColumn("version", F.lit(2))
    new = first.filter(F.col("doc_id") % 3 == 0).withColumn("chunk_id", F.concat(F.lit("new-"), "chunk_id")) \
        .withColumn("chunk_index", F.lit(-1)).withColumn("version", F.lit(1))
    t.upsert(one.unionByName(two).unionByName(new), version_col="version")
    return t.read().select("chunk_id", "doc_id", "chunk_index", "content", "version")


@register("collection_schema")
def q_collection_schema(spark, sf_dir):
    """Chunks conformed to the base schema with a custom number field."""
    labels = tb.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("quality_score"))
    rows = _collection(spark, sf_dir).join(labels, "doc_id", "left")
    out = sk.conform(rows, sk.collection_schema({"quality_score": "number"}))
    return out.select("chunk_id", "doc_id", "language", "quality_score")


@register("audit_sink")
def q_audit_sink(spark, sf_dir):
    path = _fresh(spark, "audit")
    sk.audit_sink(_events(spark, sf_dir).select("event_id", "ts", "user_id"), path)
    return spark.read.parquet(path).select("event_id", "user_id", F.col("date").cast("string").alias("date"))


@register("cache_json")
def q_cache_json(spark, sf_dir):
    """SRC16: records as JSON text and back."""
    j = _ops(spark, sf_dir).select("op_id", sk.to_json_record("key", "op", "size_bytes").alias("record"))
    back = sk.from_json_record(F.col("record"), "key string, op string, size_bytes long")
    return j.select("op_id", "record", back.alias("b")).select("op_id", "record", "b.key", "b.op", "b.size_bytes")


@register("event_append")
def q_event_append(spark, sf_dir):
    b = _business(spark, sf_dir).filter(F.col("kind") == "revenue").drop("kind")
    e = sk.event_append(b, "revenue")
    return e.select("kind", "user_id", r6("amount"), "currency", "source", F.size("metadata").alias("n_metadata"))


@register("doc_type_mime")
def q_doc_type_mime(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("application/pdf", "text/html; charset=utf-8", "application/json",
                                         "text/plain")])
    return tb.table(spark, sf_dir, "pages").select(
        "page_id", fl.doc_type_mime(F.element_at(kinds, (F.col("page_id") % 4 + 1).cast("int"))).alias("document_type"))


@register("file_limits")
def q_file_limits(spark, sf_dir):
    raw = fl.upload_filter(_raw(spark, sf_dir)).withColumn("file_size", F.octet_length("content").cast("long") * 10000)
    return fl.file_limits(raw).select("doc_id", "extension", "file_size")


@register("validate_search")
def q_validate_search(spark, sf_dir):
    t = F.col("turn")
    r = _user_turns(spark, sf_dir).withColumn("reasons", rq.validate_search("message", t * 15, t - 1, t * 0.25))
    return r.select("request_id", F.array_join("reasons", "; ").alias("reasons"))


@register("validate_ingest")
def q_validate_ingest(spark, sf_dir):
    n = F.col("n_chars")
    return tb.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(rq.validate_ingest(n % 3000, n % 700), "; ").alias("reasons"))


@register("result_projection")
def q_result_projection(spark, sf_dir):
    return rt.result_projection(_rag_hits(spark, sf_dir)).select(
        "query_id", "chunk_id", "metadata.title", "metadata.chunk_index", "metadata.document_type",
        "metadata.file_path", "metadata.rank")


# ------------------------------------------------------- security events ---
def _checked(spark, sf_dir):
    """User turns as timed requests of ten users with their rate breaches."""
    r = _user_turns(spark, sf_dir).withColumn("user_id", F.col("conv_id") % 10).withColumn(
        "ts", F.timestamp_micros(F.unix_micros(_as_of()) - (F.col("request_id") % 5000) * 1_000_000))
    return lm.rate_breach(r, id_col="request_id", limit=1)


@register("threat_verdict")
def q_threat_verdict(spark, sf_dir):
    """F21 with its threat step: a breach (W1) ends the check."""
    v = sop.request_verdict(_checked(spark, sf_dir), "message", "breach")
    return v.select("request_id", "allowed", "reason", "pii_detected", r6("content_risk_score"), "security_events")


def _security_events(spark, sf_dir):
    return sop.security_events(_checked(spark, sf_dir), "request_id", "user_id", "ts", "message", "breach")


@register("security_events")
def q_security_events(spark, sf_dir):
    return _security_events(spark, sf_dir).select("request_id", "user_id", "event_type", "severity", "blocked",
                                                  "content_preview")


@register("security_stats")
def q_security_stats(spark, sf_dir):
    s = sop.security_stats(_security_events(spark, sf_dir), _as_of())
    return s.select("total_events", "events_last_hour", F.array_join(F.transform(
        F.map_entries("event_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
        .alias("event_types"))


@register("critical_events")
def q_critical_events(spark, sf_dir):
    """PF18 over security events whose severity is raised for repeated breaches."""
    e = _security_events(spark, sf_dir).withColumn(
        "severity", F.when(F.col("user_id") % 3 == 0, "critical").otherwise(F.col("severity")))
    return sop.critical_events(e).select("request_id", "event_type")


@register("entity_order")
def q_entity_order(spark, sf_dir):
    d = tb.text_table(spark, sf_dir, "documents").select("doc_id", sfn.entity_order_desc(sfn.pii_findings("text")).alias("f"))
    return d.filter(F.size("f") > 0).select("doc_id", F.array_join(F.transform(
        "f", lambda x: x["start"].cast("string")), ",").alias("starts"))


@register("pattern_union")
def q_pattern_union(spark, sf_dir):
    """S3: configured patterns come before the defaults; blocked ones block."""
    cr = sfn.content_risk("text", blocked_patterns=["mit license"], suspicious=["apache license", "idiot"])
    d = tb.text_table(spark, sf_dir, "documents").select("doc_id", cr.alias("cr"))
    return d.select("doc_id", "cr.blocked", F.round("cr.risk_score", 6).alias("risk_score"),
                    F.array_join("cr.reasons", "; ").alias("reasons"))


# ---------------------------------------------------------- more analytics ---
@register("pipeline_counters")
def q_pipeline_counters(spark, sf_dir):
    """Files by extension and outcome, bytes as the amount."""
    f = fl.upload_filter(_raw(spark, sf_dir)).withColumn("bytes", F.octet_length("content").cast("long"))
    return us.counter(f, ["extension", "accepted"], F.col("bytes"), "bytes")


@register("market_rollup")
def q_market_rollup(spark, sf_dir):
    ev = _events(spark, sf_dir).select(F.to_date("ts").cast("string").alias("day"),
                                       F.col("event_type").alias("symbol"), "value")
    m = us.market_rollup(ev, "day", "symbol", "value")
    return m.select("day", F.explode("symbols").alias("symbol", "v")).select(
        "day", "symbol", "v.trades", F.round("v.price", 6).alias("price"))


@register("cache_size")
def q_cache_size(spark, sf_dir):
    return ca.cache_size(_entries(spark, sf_dir))


@register("provider_totals")
def q_provider_totals(spark, sf_dir):
    return us.provider_totals(us.provider_stats(_usage(spark, sf_dir), ro.providers_df(spark)))


@register("provider_union_all")
def q_provider_union_all(spark, sf_dir):
    """Configured providers and the providers of all requests, kept with
    their multiplicity."""
    seen = _usage(spark, sf_dir).select("provider")
    return ro.providers_df(spark).select("provider").unionAll(seen).groupBy("provider").agg(
        F.count("*").alias("rows"))


@register("cosine")
def q_cosine(spark, sf_dir):
    v = F.reverse("embedding")
    c = vec.cosine("embedding", v)
    return tb.table(spark, sf_dir, "embeddings").select("vec_id", F.round(c, 6).alias("cosine"),
                                                        F.round(vec.certainty(c), 6).alias("certainty"))


@register("l2_normalize")
def q_l2_normalize(spark, sf_dir):
    n = vec.l2_normalize(F.transform("embedding", lambda x: x * F.lit(3.0)))
    return tb.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(n).alias("pos", "x")).select("vec_id", "pos", F.round(F.col("x").cast("double"), 5).alias("x"))


@register("llm_cache_key")
def q_llm_cache_key(spark, sf_dir):
    r = _user_turns(spark, sf_dir)
    return r.select("request_id", ca.llm_cache_key({
        "provider": F.coalesce("provider", F.lit("any")), "message": F.col("message"),
        "max_tokens": F.col("max_tokens")}).alias("cache_key"))


@register("plain_prompt")
def q_plain_prompt(spark, sf_dir):
    r = _user_turns(spark, sf_dir)
    sys_ = F.when(F.col("conv_id") % 2 == 0, F.lit("Be brief."))
    return r.select("request_id", rq.plain_prompt("message", sys_).alias("human"),
                    rq.plain_prompt("message", sys_, "system").alias("system"))


@register("content_preview")
def q_content_preview(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select("doc_id", rq.content_preview("text").alias("preview"))


# -------------------------------------------------------- plug-in queries ---
@register("register_action")
def q_register_action(spark, sf_dir):
    """A named action over a column, with its result record."""
    reg = pl.PluginRegistry()
    reg.register_action("text", "head", lambda n: F.when(F.length("text") >= n, F.substring("text", 1, n)),
                        "first characters", n=40)
    out = reg.execute(tb.table(spark, sf_dir, "documents"), "text", "head", n=60)
    return out.select("doc_id", "result.success", "result.result", "result.error")


@register("custom_metrics")
def q_custom_metrics(spark, sf_dir):
    """A histogram declared as a metric."""
    m = pl.metric_aggregate(_http(spark, sf_dir), {"type": "histogram", "labels": ["method"],
                                                   "value": "duration_s", "buckets": [0.05, 0.1, 1.0]})
    return m.select("method", "le", "bucket_count", "count", r6("sum"))


@register("model_hooks")
def q_model_hooks(spark, sf_dir):
    """An embedder hook in place of the default one: a text's counts of
    four vowels."""
    def vowels(texts):
        return texts.map(lambda t: [float(t.lower().count(c)) for c in "aeio"])
    e = vec.embed("text", model=pl.model_hook(vowels, "array<float>"))
    return tb.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(e).alias("pos", "x")).select(
        "item_id", "pos", F.col("x").cast("double").alias("x"))


@register("sql_execute")
def q_sql_execute(spark, sf_dir):
    """Rows written as a table of the warehouse, then read back."""
    name = "sluice_audit_" + uuid.uuid4().hex[:10]
    rows = _events(spark, sf_dir).filter(F.col("event_type") == "error").select("event_id", "user_id")
    n = pl.sql_execute(spark, name, rows, "overwrite")
    return spark.table(name).select("event_id", "user_id", F.lit(n).cast("long").alias("affected_rows"))


@register("custom_rules")
def q_custom_rules(spark, sf_dir):
    """Two rules of the caller in the content filter."""
    text = F.col("text")
    rules = [pl.custom_rule("licence", "licen[cs]e", 2, False)(text), pl.custom_rule("insult", "idiot|moron", 4, True)(text)]
    d = tb.text_table(spark, sf_dir, "documents").select("doc_id", sfn.content_risk("text", custom_rules=rules).alias("cr"))
    return d.select("doc_id", "cr.blocked", F.round("cr.risk_score", 6).alias("risk_score"),
                    F.array_join("cr.reasons", "; ").alias("reasons"))


@register("chunk_semantic_breaks")
def q_chunk_semantic_breaks(spark, sf_dir):
    """F4 with breaks between dissimilar sentences."""
    c = ch.chunk_semantic(_docs(spark, sf_dir, False), keep=["title"], threshold=0.2001)
    return ch.with_chunk_id(c).select(*CHUNK_COLS)


@register("stream_ingest_vectors")
def q_stream_ingest_vectors(spark, sf_dir):
    """ST12 with E1 and upsert: chunks of new documents with their vectors,
    the newest version of a chunk id counts."""
    docs = tb.table(spark, sf_dir, "documents")
    parts = st.split_by_time(docs.withColumn("ts", F.timestamp_micros(F.col("doc_id"))), "documents-in", files=3)
    s = st.file_stream(spark, parts, docs.schema)
    out = st.stream_ingest(s, "hybrid").withColumn("embedding", vec.embed("content"))
    out = st.run_latest(out, ["chunk_id"], "stream_ingest_vectors")
    v = F.filter(F.transform("embedding", lambda x: x.cast("double")), lambda x: x != 0)
    return out.select("chunk_id", "doc_id", "chunk_index", "content", F.size(v).alias("dims"))


@register("hooked_rerank")
def q_hooked_rerank(spark, sf_dir):
    """U3 as a reranker: shorter texts first."""
    hits = rt.knn_join(inp.vector_queries(spark, sf_dir), inp.vectors(spark, sf_dir), 5, payload=["content"],
                       texts=inp.vector_texts(spark, sf_dir))
    hits = hits.withColumn("content", F.coalesce("content", F.lit("")))
    hook = pl.model_hook(lambda t: 1.0 / (1.0 + t.str.len()), "double")
    return rt.rerank(hits, model=hook).select("query_id", "chunk_id", "rank", F.round("similarity_score", 9).alias("similarity_score"))


@register("hooked_pii")
def q_hooked_pii(spark, sf_dir):
    """U3 as a PII analyser: runs of digits in brackets."""
    import re

    def find(texts):
        return texts.map(lambda t: [{"entity_type": "BRACKET", "start": m.start(), "end": m.end(), "score": 0.9,
                                     "text": m.group()} for m in re.finditer(r"\([0-9]+\)", t or "")])
    hook = pl.model_hook(find, "array<struct<entity_type:string,start:int,end:int,score:double,text:string>>")
    d = tb.table(spark, sf_dir, "documents").select("doc_id", sfn.pii_findings("text", model=hook).alias("f"))
    return d.select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.start", "f.text")


@register("pii_checked")
def q_pii_checked(spark, sf_dir):
    """F14 with check digits: Luhn for cards, mod 97 for IBANs."""
    d = tb.text_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(sfn.pii_findings("text", check_digits=True)).alias("f")).select("doc_id", "f.*")


@register("check_digits")
def q_check_digits(spark, sf_dir):
    """every card and IBAN finding with the verdict of its check digits."""
    d = tb.text_table(spark, sf_dir, "documents")
    f = d.select("doc_id", F.explode(sfn.pii_findings("text")).alias("f")).filter(
        F.col("f.entity_type").isin("CREDIT_CARD", "IBAN_CODE"))
    return f.select("doc_id", "f.entity_type", "f.start", "f.text", sfn.check_digits_ok(F.col("f")).alias("valid"))


@register("identifier_stats")
def q_identifier_stats(spark, sf_dir):
    """A5: identifiers with failures, and suspicious ones."""
    return sop.identifier_stats(lm.failed_attempts(_failures(spark, sf_dir)))


@register("operation_counters")
def q_operation_counters(spark, sf_dir):
    """Chunks by strategy, vector operations, and plug-in runs by outcome."""
    chunks = [ch.chunk(_docs(spark, sf_dir, s == "paragraph"), s).select(F.lit(s).alias("strategy"))
              for s in ("sliding_window", "sentence", "paragraph")]
    reg = pl.PluginRegistry()
    reg.register_action("text", "head", lambda n: F.when(F.length("text") >= n, F.substring("text", 1, n)), "", n=60)
    runs = reg.execute(tb.table(spark, sf_dir, "documents"), "text", "head", n=60)
    ops = tb.table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 50 == 0, "search").otherwise("insert").alias("op"))
    return us.operation_counters({
        "chunks": (chunks[0].unionByName(chunks[1]).unionByName(chunks[2]), "strategy"),
        "vector_ops": (ops, "op"),
        "plugin_runs": (runs, F.when(F.col("result.success"), "success").otherwise("error"))})


@register("sql_query_capped")
def q_sql_query_capped(spark, sf_dir):
    """T4: the first hundred rows of a longer result, marked as cut."""
    tb.table(spark, sf_dir, "lineitem").createOrReplaceTempView("sluice_lineitem")
    df = pl.sql_query(spark, "SELECT l_orderkey, l_linenumber, l_extendedprice FROM sluice_lineitem "
                             "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber", max_rows=100)
    return df.select("l_orderkey", "l_linenumber", r6("l_extendedprice"), "truncated")


@register("read_files")
def q_read_files(spark, sf_dir):
    """SRC1: the files below the folder, with size, type and digest."""
    root = sf_dir.rstrip("/").split("/")[-1]
    files = dg.content_digest(fl.read_files(spark, sf_dir), sf_dir)
    return files.select(F.substring_index("file_path", f"/{root}/", -1).alias("file"), "title", "document_type", "bytes", "sha256")


@register("markdown_to_text")
def q_markdown_to_text(spark, sf_dir):
    """SRC5 over documents written as Markdown."""
    d = tb.text_table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    md = F.concat(F.lit("# Document "), i, F.lit("\n\n> "), F.col("text"), F.lit("\n\n---\n* **bold** item\n2. see [page "), i,
                  F.lit("](http://h/"), i, F.lit(")\n```py\n# x  y\n\nz = "), i, F.lit("\n```\nlast *line*\n"))
    return d.select("doc_id", mk.markdown_to_text(md).alias("text"))


@register("json_to_text")
def q_json_to_text(spark, sf_dir):
    """SRC5 over documents written as JSON; every tenth is no JSON."""
    d = tb.text_table(spark, sf_dir, "documents")
    body = F.to_json(F.struct(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"),
                              F.struct("text", "lang").alias("body"), F.array("source", "lang").alias("tags"),
                              F.col("n_chars").alias("n"), F.lit(None).cast("string").alias("none")))
    return mk.json_to_text(d.select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("{not json")).otherwise(body).alias("t")),
                           "doc_id", "t")
