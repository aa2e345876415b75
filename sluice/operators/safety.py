"""Text-safety operators over DataFrames: PII findings (F14), statistics
(A16, A17), sanitising (F22), request verdicts (F21), security events and
their statistics (A5, PF18).

Everything is a narrow projection or an explode per row, except the
statistics, which are hash aggregates with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import safety as sf


def pii_detect(df: DataFrame, id_col: str, text_col: str = "text",
               threshold: float | None = sf.PII_THRESHOLD) -> DataFrame:
    """one row per finding (id, entity_type, start, end, score, text)."""
    return (df.select(id_col, F.explode(sf.pii_findings(text_col, threshold)).alias("f"))
            .select(id_col, "f.entity_type", "f.start", "f.end", "f.score",
                    F.col("f.text").alias("text")))


def pii_stats(findings: DataFrame, id_col: str) -> DataFrame:
    """Per entity type -> detections, documents with it, best score.

    The per-document best score (confidence_scores of the reference) is
    ``max(score)`` grouped by (id, type); here rolled up per type."""
    per_doc = findings.groupBy(id_col, "entity_type").agg(
        F.count("*").alias("n"), F.max("score").alias("best"))
    return per_doc.groupBy("entity_type").agg(
        F.sum("n").alias("detections"), F.count("*").alias("documents"),
        F.max("best").alias("best_score"))


def filter_stats(df: DataFrame, text_col: str = "text",
                 blocked_patterns: list[str] | None = None) -> DataFrame:
    """Content-filter counter per (filter_type, action). Only pattern
    checks count (not length or injection), one per matching pattern."""
    text = F.col(text_col)
    b = [F.when(text.rlike("(?i)" + p), F.lit("blocked_pattern|blocked"))
         for p in (blocked_patterns or [])]
    s = [F.when(f, F.lit("suspicious_pattern|detected")) for f in sf.suspicious_flags(text)]
    ev = df.select(F.explode(F.filter(F.array(*b, *s), lambda x: x.isNotNull())).alias("e"))
    return (ev.groupBy("e").count()
            .select(F.split("e", r"\|")[0].alias("filter_type"),
                    F.split("e", r"\|")[1].alias("action"),
                    F.col("count").alias("events")))


def sanitize_input(df: DataFrame, text_col: str = "text", anonymize: bool = True,
                   blocked_patterns: list[str] | None = None) -> DataFrame:
    """anonymise first, then filter the *anonymised* text.

    Adds sanitized (null when blocked), blocked, risk_score, reasons."""
    anon = sf.pii_anonymize(text_col) if anonymize else F.col(text_col)
    out = df.withColumn("_anon", anon).withColumn(
        "_cr", sf.content_risk("_anon", blocked_patterns))
    return (out.withColumn("sanitized", F.col("_cr.filtered_content"))
            .withColumn("blocked", F.col("_cr.blocked"))
            .withColumn("risk_score", F.col("_cr.risk_score"))
            .withColumn("reasons", F.col("_cr.reasons"))
            .drop("_anon", "_cr"))


def request_verdict(requests: DataFrame, text_col: str = "content",
                    rate_breach_col: str | None = None) -> DataFrame:
    """threats first -- a blocking threat (rate breach) ends the check
    with no PII/content fields; otherwise allowed = not content-blocked and
    PII alone never blocks. Short probes (F20) are non-blocking
    suspicious-activity events."""
    text = F.col(text_col)
    breach = F.col(rate_breach_col) if rate_breach_col else F.lit(False)
    cr = sf.content_risk(text)
    probe = sf.short_probe(text)
    return requests.select(
        "*",
        F.when(breach, F.lit(False)).otherwise(~cr["blocked"]).alias("allowed"),
        F.when(breach, F.lit("Security threat detected")).alias("reason"),
        F.when(breach, F.lit(None).cast("boolean")).otherwise(sf.has_pii(text)).alias("pii_detected"),
        F.when(breach, F.lit(None).cast("double")).otherwise(cr["risk_score"]).alias("content_risk_score"),
        (F.when(breach, 1).otherwise(0) + F.when(probe, 1).otherwise(0)).alias("security_events"),
    )


def security_events(requests: DataFrame, id_col: str, user_col: str, ts_col: str,
                    text_col: str, rate_breach_col: str | None = None) -> DataFrame:
    """Security events of the request checks as rows:
    RATE_LIMIT_EXCEEDED/medium/blocked, SUSPICIOUS_ACTIVITY/high (short probe,
    with a 100-char preview -- F30), PII_DETECTED/medium,
    CONTENT_BLOCKED/medium/blocked."""
    text = F.col(text_col)
    breach = F.col(rate_breach_col) if rate_breach_col else F.lit(False)
    cr = sf.content_risk(text)
    ev = F.array(
        F.when(breach, F.struct(F.lit("rate_limit_exceeded").alias("event_type"),
                                F.lit("medium").alias("severity"), F.lit(True).alias("blocked"))),
        F.when(sf.short_probe(text), F.struct(F.lit("suspicious_activity").alias("event_type"),
                                              F.lit("high").alias("severity"),
                                              F.lit(False).alias("blocked"))),
        F.when(~breach & sf.has_pii(text), F.struct(F.lit("pii_detected").alias("event_type"),
                                                     F.lit("medium").alias("severity"),
                                                     F.lit(False).alias("blocked"))),
        F.when(~breach & cr["blocked"], F.struct(F.lit("content_blocked").alias("event_type"),
                                                  F.lit("medium").alias("severity"),
                                                  F.lit(True).alias("blocked"))),
    )
    return (requests.select(F.col(id_col).alias("request_id"), F.col(user_col).alias("user_id"),
                            F.col(ts_col).alias("ts"), F.substring(text, 1, 100).alias("content_preview"),
                            F.explode(F.filter(ev, lambda e: e.isNotNull())).alias("e"))
            .select("request_id", "user_id", "ts", "e.event_type", "e.severity", "e.blocked",
                    "content_preview"))


def security_stats(events: DataFrame, as_of: Column) -> DataFrame:
    """A5: total events, events of the last hour (age < 3600 s) and the
    count per type in the last hour, as one row. Two-level aggregation: per
    type first (partial aggregates map-side), then the few type rows."""
    age = F.unix_micros(as_of) - F.unix_micros(F.col("ts").cast("timestamp"))
    per_type = events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if((age >= 0) & (age < 3600 * 1_000_000)).alias("r"))
    return per_type.agg(
        F.sum("n").alias("total_events"), F.sum("r").alias("events_last_hour"),
        F.map_from_entries(F.array_sort(F.filter(
            F.collect_list(F.struct("event_type", "r")), lambda x: x["r"] > 0))).alias("event_types"))


def identifier_stats(failures: DataFrame) -> DataFrame:
    """A5 (second half): identifiers with failures, and suspicious ones (> 5)."""
    return failures.agg(F.count("*").alias("failed_attempts"),
                        F.count_if(F.col("failures") > 5).alias("suspicious_ips"))


def critical_events(events: DataFrame) -> DataFrame:
    """PF18: events of severity critical go to the alert output."""
    return events.filter(F.col("severity") == "critical")
