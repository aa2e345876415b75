"""Oracle SQL (DuckDB dialect) for the registered queries.

Written from the operator definitions, without imports from the operators; the
driver tables are pre-registered views. Shared derivations are CTE snippets.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

CORPUS = """
corpus AS (
  SELECT e.vec_id AS chunk_id, e.embedding::DOUBLE[] AS cv, coalesce(d.text, '') AS content,
         d.lang, d.source, e.label
  FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id),
qry AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0)"""


def knn_sql(k: int, where: str = "TRUE", self_join: bool = False) -> str:
    src = "corpus q2 WHERE q2.chunk_id % 50 = 0" if self_join else "qry"
    qcols = "q2.chunk_id AS query_id, q2.cv AS qv" if self_join else "query_id, qv"
    excl = "AND q.query_id <> c.chunk_id" if self_join else ""
    return f"""
scored AS (
  SELECT q.query_id, c.chunk_id, c.content,
         (1 + list_cosine_similarity(q.qv, c.cv)) / 2 AS similarity_score
  FROM (SELECT {qcols} FROM {src}) q, corpus c WHERE {where} {excl}),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id
                               ORDER BY similarity_score DESC, chunk_id) AS rank
  FROM scored QUALIFY rank <= {k})"""


ORACLE["knn_join"] = f"""WITH {CORPUS}, {knn_sql(10)}
SELECT query_id, chunk_id, rank, round(similarity_score, 6) AS similarity_score FROM hits"""

ORACLE["metadata_filter"] = f"""WITH {CORPUS}, {knn_sql(5, "c.lang IN ('en', 'de') AND c.label = 3")}
SELECT query_id, chunk_id, rank, round(similarity_score, 6) AS similarity_score FROM hits"""

ORACLE["similar_chunks"] = f"""WITH {CORPUS}, {knn_sql(5, self_join=True)}
SELECT query_id, chunk_id, rank, round(similarity_score, 6) AS similarity_score FROM hits"""

RERANK = """
rr AS (
  SELECT query_id, chunk_id, rank AS old_rank, similarity_score AS vector_score,
         similarity_score * (0.8 + 0.2 * least(length(content) / 500.0, 1.0)) AS new_score
  FROM hits),
rk AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, old_rank) AS rank
  FROM rr)"""

ORACLE["rerank"] = f"""WITH {CORPUS}, {knn_sql(10)}, {RERANK}
SELECT query_id, chunk_id, rank, round(new_score, 6) AS similarity_score FROM rk"""

ORACLE["search_page"] = f"""WITH {CORPUS}, {knn_sql(7)}, {RERANK},
kept AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position,
         count(*) OVER (PARTITION BY query_id) AS total_results
  FROM rk WHERE new_score >= 0.6)
SELECT query_id, chunk_id, rank, position, total_results,
       round(new_score, 6) AS similarity_score, round(vector_score, 6) AS vector_score
FROM kept WHERE position > 2 AND position <= 7"""

ORACLE["top_sources"] = f"""WITH {CORPUS}, {knn_sql(5)}
SELECT query_id, chunk_id, rank, substr(content, 1, 200) || '...' AS preview
FROM hits WHERE rank <= 3"""


# ------------------------------------------------------------ chunking ---
NL2 = "chr(10) || chr(10)"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


def chunk_select(src: str) -> str:
    """src has doc_id, ord, content, start_char, end_char."""
    return f"""
SELECT doc_id, chunk_index,
       substr(md5(concat_ws('_', doc_id::VARCHAR, 'doc-' || doc_id::VARCHAR, '',
                            chunk_index::VARCHAR)), 1, 16) AS chunk_id,
       start_char, end_char, {words_sql('content')} AS tokens_count, content
FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1)::INTEGER AS chunk_index
      FROM {src})"""


def pieces_sql(name: str, source: str, split_expr: str) -> str:
    """CTE ``name``(doc_id, i, piece): stripped, non-empty pieces numbered 1.."""
    return f"""
{name}_raw AS (
  SELECT doc_id, unnest(arr) AS piece, generate_subscripts(arr, 1) AS pos
  FROM (SELECT doc_id, {split_expr} AS arr FROM {source})),
{name} AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, piece
  FROM (SELECT doc_id, pos, {strip_sql('piece')} AS piece FROM {name}_raw) WHERE piece <> '')"""


def fold_sql(name: str, pieces: str, sep: str, size: int = 512) -> str:
    """Greedy packing as a recursive CTE; ``name`` gets
    (doc_id, ord, content, start_char, end_char)."""
    pot = f"(f.cur || {sep} || p.piece)"
    return f"""
{name}_f(doc_id, i, cur, st, out_c, out_s) AS (
  SELECT doc_id, i, piece, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM {pieces} WHERE i = 1
  UNION ALL
  SELECT f.doc_id, p.i,
         CASE WHEN length({pot}) > {size} THEN p.piece ELSE {pot} END,
         CASE WHEN length({pot}) > {size} THEN f.st + length(f.cur) ELSE f.st END,
         CASE WHEN length({pot}) > {size} THEN f.cur END,
         CASE WHEN length({pot}) > {size} THEN f.st END
  FROM {name}_f f JOIN {pieces} p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
{name} AS (
  SELECT doc_id, i AS ord, out_c AS content, out_s AS start_char,
         out_s + length(out_c) AS end_char FROM {name}_f WHERE out_c IS NOT NULL
  UNION ALL
  SELECT f.doc_id, f.i + 1, f.cur, f.st, f.st + length(f.cur)
  FROM {name}_f f JOIN (SELECT doc_id, max(i) AS mi FROM {pieces} GROUP BY doc_id) m
    ON m.doc_id = f.doc_id AND f.i = m.mi)"""


DOCS_PARA = f"(SELECT doc_id, replace(text, chr(10), {NL2}) AS text FROM documents)"

ORACLE["chunk_sentence"] = f"""WITH RECURSIVE
{pieces_sql('sp', 'documents', "regexp_split_to_array(text, '[.!?]+')")},
{fold_sql('sc', 'sp', "' '")}
{chunk_select('sc')}"""
ORACLE["chunk_semantic"] = ORACLE["chunk_sentence"]

ORACLE["chunk_paragraph"] = f"""WITH RECURSIVE
{pieces_sql('pp', DOCS_PARA, f"string_split(text, {NL2})")},
{fold_sql('pc', 'pp', NL2)}
{chunk_select('pc')}"""

ORACLE["chunk_hybrid"] = f"""WITH RECURSIVE
{pieces_sql('pp', DOCS_PARA, f"string_split(text, {NL2})")},
{fold_sql('pc', 'pp', NL2)},
pcl AS (SELECT doc_id * 100000 + ord AS doc_id, doc_id AS real_doc, ord AS p_ord,
               content AS text, start_char AS p_start
        FROM pc WHERE length(content) > 2048),
{pieces_sql('sp', 'pcl', "regexp_split_to_array(text, '[.!?]+')")},
{fold_sql('sc', 'sp', "' '")},
hy AS (
  SELECT doc_id, ord * 100000 AS ord, content, start_char, end_char
  FROM pc WHERE length(content) <= 2048
  UNION ALL
  SELECT l.real_doc, l.p_ord * 100000 + s.ord, s.content, s.start_char + l.p_start,
         s.end_char + l.p_start
  FROM sc s JOIN pcl l ON l.doc_id = s.doc_id)
{chunk_select('hy')}"""

ORACLE["chunk_sliding"] = f"""WITH
w AS (
  SELECT doc_id, s, length(text) AS n, {strip_sql('substr(text, s + 1, 512)')} AS content
  FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 462)) AS s
        FROM documents WHERE length(text) > 0)),
k AS (
  SELECT doc_id, s AS ord, content, s::INTEGER AS start_char, least(s + 512, n)::INTEGER AS end_char
  FROM w WHERE (s = 0 OR s - 462 + 512 < n) AND length(content) >= 50)
{chunk_select('k')}"""

ORACLE["chunk_fixed"] = f"""WITH RECURSIVE
fx(doc_id, text, n, start, c_start, c_end, piece) AS (
  SELECT doc_id, text, length(text), 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR
  FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, n, greatest(start + 1, e - 50), start, e,
         {strip_sql('substr(text, start + 1, e - start)')}
  FROM (
    SELECT *, CASE WHEN e0 < n AND ls > start THEN ls ELSE e0 END AS e
    FROM (
      SELECT doc_id, text, n, start, e0,
             CASE WHEN strpos(reverse(sub), ' ') > 0
                  THEN start + length(sub) - strpos(reverse(sub), ' ') ELSE -1 END AS ls
      FROM (SELECT *, least(start + 512, n) AS e0,
                   substr(text, start + 1, least(start + 512, n) - start) AS sub
            FROM fx WHERE start < n)))),
k AS (
  SELECT doc_id, c_start AS ord, piece AS content, c_start::INTEGER AS start_char,
         c_end::INTEGER AS end_char
  FROM fx WHERE piece IS NOT NULL AND length(piece) >= 50)
{chunk_select('k')}"""


# -------------------------------------------------------------- safety ---
# What the recognisers and filters look for, written out for RE2
# (a finding's neighbours are checked in SQL).
PII = [
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}", 1.0, "[EMAIL]"),
    ("URL", r"https?://[^ \t\n\r\"'<>]+", 0.85, "[URL]"),
    ("IBAN_CODE", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", 1.0, "[IBAN_CODE]"),
    ("CREDIT_CARD", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", 1.0, "[CREDIT_CARD]"),
    ("US_SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.85, "[US_SSN]"),
    ("PHONE_NUMBER", r"(\+1[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}-[0-9]{4}", 0.9, "[PHONE]"),
    ("IP_ADDRESS", r"((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])", 0.95, "[IP_ADDRESS]"),
    ("US_PASSPORT", r"[A-Z][0-9]{8}", 0.4, "[US_PASSPORT]"),
]
SUSPICIOUS = [r"<script[^>]*>", r"javascript:", r"eval\s*\(", r"union\s+select", r"drop\s+table",
              r"['\"];\s*(drop|delete|insert|update)"]
INJECTION = ["' or '1'='1", "'; drop table", "<script>alert(", "javascript:void(0)", "onload=", "onerror=",
             "../../../etc/passwd", "{{7*7}}", "${jndi:ldap://"]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OFFSET = ("coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0)"
          " + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)")


def findings_sql(tab: str, idc: str, textc: str, threshold: float = 0.8) -> str:
    """Findings with offsets whose neighbours are not letters or digits."""
    parts = []
    for e, p, sc, mask in PII:
        if sc < threshold:
            continue
        parts.append(f"""
  SELECT {idc}, {lit(e)} AS entity_type, {lit(mask)} AS mask, m, {OFFSET} AS off, {sc}::DOUBLE AS score, t
  FROM (SELECT {idc}, t, ms, pieces, unnest(ms) AS m, generate_subscripts(ms, 1) AS i
        FROM (SELECT {idc}, {textc} AS t, regexp_extract_all({textc}, {lit(p)}) AS ms,
                     regexp_split_to_array({textc}, {lit(p)}) AS pieces
              FROM {tab} WHERE trim({textc}) <> ''))""")
    free = "NOT regexp_matches({0}, '[0-9A-Za-z]')"
    return (f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {free.format('substr(t, off::BIGINT, 1)')} "
            f"AND {free.format('substr(t, off::BIGINT + length(m) + 1, 1)')}".replace(
                "substr(t, off::BIGINT, 1)", "CASE WHEN off = 0 THEN '' ELSE substr(t, off::BIGINT, 1) END"))


def replaced_sql(tab: str, idc: str, textc: str, threshold: float, name: str, mask: str) -> str:
    """CTEs ending in ``name`` (id, text with its findings replaced)."""
    return f"""
{name}_f AS ({findings_sql(tab, idc, textc, threshold)}),
{name}_o AS (SELECT *, max(off + length(m)) OVER (PARTITION BY {idc} ORDER BY off, length(m) DESC, score DESC, entity_type
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {name}_f),
{name}_k AS (SELECT {idc}, off, off + length(m) AS until, t, {mask} AS mask,
                    coalesce(lag(off + length(m)) OVER (PARTITION BY {idc} ORDER BY off), 0) AS since
             FROM {name}_o WHERE before IS NULL OR off >= before),
{name}_r AS (SELECT {idc}, string_agg(substr(t, (since + 1)::BIGINT, (off - since)::BIGINT) || mask, '' ORDER BY off)
                    || substr(any_value(t), (max(until) + 1)::BIGINT) AS done_text FROM {name}_k GROUP BY {idc}),
{name} AS (SELECT x.*, coalesce(done_text, {textc}) AS replaced FROM {tab} x LEFT JOIN {name}_r USING ({idc}))"""


ORACLE["pii_detect"] = f"""
SELECT doc_id, entity_type, off::INTEGER AS start, (off + length(m))::INTEGER AS "end", score, m AS text
FROM ({findings_sql('documents', 'doc_id', 'text')})"""

ORACLE["pii_stats"] = f"""
SELECT entity_type, sum(n)::BIGINT AS detections, count(*)::BIGINT AS documents,
       round(max(best), 6) AS best_score
FROM (SELECT doc_id, entity_type, count(*) AS n, max(score) AS best
      FROM ({findings_sql('documents', 'doc_id', 'text')}) GROUP BY doc_id, entity_type)
GROUP BY entity_type"""

ORACLE["pii_mask"] = f"""WITH {replaced_sql('documents', 'doc_id', 'text', 0.8, 'done', 'mask')}
SELECT doc_id, replaced AS masked FROM done"""

TAG = "'<' || entity_type || '>'"
ORACLE["pii_anonymize"] = f"""WITH {replaced_sql('documents', 'doc_id', 'text', 0.0, 'done', TAG)}
SELECT doc_id, replaced AS anonymized FROM done"""


def inj_tenths(x: str) -> str:
    terms = " + ".join(f"(CASE WHEN contains(lower({x}), {lit(i)}) THEN 1 ELSE 0 END)"
                       for i in INJECTION)
    return f"least(2 * ({terms}), 10)"


def sus_flag(x: str, i: int) -> str:
    return f"regexp_matches({x}, {lit(SUSPICIOUS[i])}, 'i')"


def risk_cte(src: str, x: str, idc: str) -> str:
    sus = " + ".join(f"(CASE WHEN {sus_flag(x, i)} THEN 3 ELSE 0 END)"
                     for i in range(len(SUSPICIOUS)))
    reasons = ", ".join(
        [f"CASE WHEN length({x}) > 10000 THEN 'Content too long (' || length({x}) || ' > 10000)' END"]
        + [f"CASE WHEN {sus_flag(x, i)} THEN 'Suspicious pattern #{i} detected' END"
           for i in range(len(SUSPICIOUS))]
        + ["CASE WHEN inj > 5 THEN 'Potential injection attack detected' END"])
    return f"""
r0 AS (SELECT *, {inj_tenths(x)} AS inj FROM {src}),
r1 AS (SELECT *, (CASE WHEN length({x}) > 10000 THEN 3 ELSE 0 END) + {sus}
                 + (CASE WHEN inj > 5 THEN inj ELSE 0 END) AS risk,
              list_filter([{reasons}], lambda r: r IS NOT NULL) AS reasons
       FROM r0),
risk AS (SELECT *, (length({x}) > 10000 OR inj > 5 OR risk > 7) AS blocked,
                least(risk, 10) / 10.0 AS risk_score FROM r1)"""


ORACLE["content_risk"] = f"""WITH {risk_cte('documents', 'text', 'doc_id')}
SELECT doc_id, blocked, round(risk_score, 6) AS risk_score,
       array_to_string(reasons, '; ') AS reasons, blocked AS content_withheld FROM risk"""

ORACLE["injection_score"] = f"""
SELECT doc_id, round(least({inj_tenths('text')} / 10.0, 1.0), 6) AS injection_score
FROM documents"""

ORACLE["suspicious_patterns"] = "SELECT page_id, " + " || ".join(
    f"(CASE WHEN {sus_flag('html', i)} THEN '1' ELSE '0' END)"
    for i in range(len(SUSPICIOUS))) + " AS flags FROM pages"

ORACLE["short_probe"] = """
SELECT doc_id, (length(text) < 10 AND NOT contains(text, ' ')) AS short_probe,
       length(text) <= 10000 AS input_length_ok FROM documents"""

ORACLE["filter_stats"] = f"""
WITH t AS (SELECT text FROM documents UNION ALL SELECT html FROM pages)
SELECT 'suspicious_pattern' AS filter_type, 'detected' AS action, count(*)::BIGINT AS events
FROM ({" UNION ALL ".join(f"SELECT 1 FROM t WHERE {sus_flag('text', i)}"
                          for i in range(len(SUSPICIOUS)))})
HAVING count(*) > 0"""

USER_TURNS = """
turns AS (
  SELECT conv_id * 100 + turn AS request_id, conv_id AS user_id, conv_id, turn,
         text AS message,
         CASE conv_id % 4 WHEN 1 THEN 'openai' WHEN 2 THEN 'anthropic' WHEN 3 THEN 'ollama' END
           AS provider,
         (turn % 5) * 0.6 AS temperature, (1 + turn * 700)::INTEGER AS max_tokens
  FROM conversations WHERE role = 'user')"""

ORACLE["sanitize_input"] = f"""WITH {USER_TURNS},
{replaced_sql('turns', 'request_id', 'message', 0.0, 'done', TAG)},
anon AS (SELECT request_id, replaced AS a FROM done),
{risk_cte('anon', 'a', 'request_id')}
SELECT request_id, blocked, round(risk_score, 6) AS risk_score,
       CASE WHEN blocked THEN NULL ELSE a END AS sanitized FROM risk"""


def has_pii_sql(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {lit(p)})" for e, p, sc, _m in PII
                             if sc >= 0.8) + f") AND trim({x}) <> ''"


ORACLE["request_verdict"] = f"""WITH {USER_TURNS}, {risk_cte('turns', 'message', 'request_id')}
SELECT request_id, NOT blocked AS allowed, {has_pii_sql('message')} AS pii_detected,
       round(risk_score, 6) AS content_risk_score,
       (CASE WHEN length(message) < 10 AND NOT contains(message, ' ') THEN 1 ELSE 0 END)
         AS security_events
FROM risk"""

ORACLE["hash_sensitive"] = f"""
SELECT conv_id, turn, sha256('pepper-1' || text) AS hashed FROM conversations"""


# ------------------------------------------------------- usage & limits ---
AS_OF = "TIMESTAMP '2024-01-30 00:00:00'"

HTTP = """
http AS (
  SELECT event_id AS request_id, ts, user_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
         CASE event_type WHEN 'view' THEN '/api/v1/search'
                         WHEN 'click' THEN '/api/v1/chat/generate'
                         WHEN 'purchase' THEN '/api/v1/documents/upload'
                         WHEN 'signup' THEN '/api/v1/auth/keys'
                         WHEN 'error' THEN '/api/v1/chat/generate'
                         ELSE '/api/v1/status' END AS endpoint,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
         value / 1000.0 AS duration_s,
         printf('10.0.%d.%d', user_id % 4, user_id) AS client_ip,
         'k' || (user_id % 3)::VARCHAR AS api_key,
         round(value * 100000)::BIGINT AS content_length
  FROM events)"""

ORACLE["http_counters"] = f"""WITH {HTTP}
SELECT method, endpoint, status_code, count(*)::BIGINT AS requests
FROM http GROUP BY ALL"""

BUCKETS = [0.1, 0.5, 1.0, 2.5, 5.0, 10.0]
ORACLE["latency_histogram"] = f"""WITH {HTTP},
b(le, bound) AS (VALUES {", ".join(f"('{b!r}', {b})" for b in BUCKETS)}, ('+Inf', 'Infinity'::DOUBLE)),
g AS (SELECT method, endpoint, count(*)::BIGINT AS count, sum(duration_s) AS sum FROM http GROUP BY ALL)
SELECT g.method, g.endpoint, b.le,
       (SELECT count(*) FROM http h WHERE h.method = g.method AND h.endpoint = g.endpoint
                                      AND h.duration_s <= b.bound)::BIGINT AS bucket_count,
       g.count, round(g.sum, 6) AS sum
FROM g, b"""

ORACLE["summary_quantiles"] = f"""WITH {HTTP}
SELECT endpoint, count(*)::BIGINT AS count, round(sum(duration_s), 6) AS sum,
       round(quantile_cont(duration_s, 0.5), 6) AS q50, round(quantile_cont(duration_s, 0.9), 6) AS q90,
       round(quantile_cont(duration_s, 0.95), 6) AS q95, round(quantile_cont(duration_s, 0.99), 6) AS q99
FROM http GROUP BY endpoint"""

ORACLE["error_rate"] = f"""WITH {HTTP}
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       count(*)::BIGINT AS requests, round(avg((status_code >= 500)::INTEGER), 6) AS error_rate
FROM http GROUP BY 1"""

ORACLE["gauge_latest"] = """
SELECT user_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY user_id"""

BUSINESS = """
business AS (
  SELECT event_id, ts, user_id, 'user_activity' AS kind, event_type AS action,
         NULL::VARCHAR AS feature, NULL::DOUBLE AS amount, NULL::VARCHAR AS currency FROM events
  UNION ALL
  SELECT event_id, ts, user_id, 'revenue', NULL, NULL, value,
         CASE WHEN user_id % 2 = 0 THEN 'USD' ELSE 'EUR' END FROM events WHERE event_type = 'purchase'
  UNION ALL
  SELECT event_id, ts, user_id, 'feature_usage', NULL,
         'f' || (json_extract_string(props, '$.k')::BIGINT)::VARCHAR, NULL, NULL
  FROM events WHERE event_type = 'click'),
recent AS (
  SELECT * FROM business
  WHERE ts > TIMESTAMP '2024-01-29 00:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00')"""

ORACLE["user_activity_stats"] = f"""WITH {BUSINESS}
SELECT action, count(*)::BIGINT AS events, count(DISTINCT user_id)::BIGINT AS unique_users
FROM recent WHERE kind = 'user_activity' GROUP BY ROLLUP (action)"""

ORACLE["revenue_stats"] = f"""WITH {BUSINESS}
SELECT currency, count(*)::BIGINT AS events, round(sum(amount), 6) AS amount
FROM recent WHERE kind = 'revenue' GROUP BY ROLLUP (currency)"""

ORACLE["feature_stats"] = f"""WITH {BUSINESS}
SELECT feature, count(*)::BIGINT AS events
FROM recent WHERE kind = 'feature_usage' GROUP BY ROLLUP (feature)"""

ORACLE["health_rollup"] = f"""WITH {HTTP},
comp AS (SELECT ts::DATE AS day, endpoint, avg((status_code >= 500)::INTEGER) <= 0.5 AS healthy
         FROM http GROUP BY ALL)
SELECT day::VARCHAR AS day, bool_and(healthy) AS all_healthy, bool_or(healthy) AS any_healthy,
       count(*)::BIGINT AS components,
       CASE WHEN bool_and(healthy) THEN 'healthy' WHEN bool_or(healthy) THEN 'degraded'
            ELSE 'unhealthy' END AS status
FROM comp GROUP BY day"""


def window_count_sql(seconds: int, key: str = "user_id", src: str = "events",
                     idc: str = "event_id") -> str:
    return f"""
SELECT e.{idc}, e.{key}, count(*)::BIGINT AS n
FROM {src} e JOIN {src} p ON p.{key} = e.{key}
  AND epoch_us(p.ts) > epoch_us(e.ts) - {seconds * 1000000}
  AND (p.ts < e.ts OR (p.ts = e.ts AND p.{idc} <= e.{idc}))
GROUP BY e.{idc}, e.{key}"""


ORACLE["rate_breach"] = f"""
SELECT event_id, user_id, n AS requests_in_window, n > 1 AS breach
FROM ({window_count_sql(60)})"""

ORACLE["hourly_count"] = f"""
SELECT event_id, n AS requests_last_hour FROM ({window_count_sql(3600)})"""

ORACLE["rate_limit_admit"] = f"""WITH RECURSIVE {HTTP},
r AS (SELECT request_id, api_key || ':' || client_ip AS bucket, epoch_us(ts) AS us,
             row_number() OVER (PARTITION BY api_key || ':' || client_ip
                                ORDER BY epoch_us(ts), request_id) AS i
      FROM http),
f(bucket, i, request_id, admitted, in_window, log) AS (
  SELECT bucket, i, request_id, true, 0::BIGINT, [us] FROM r WHERE i = 1
  UNION ALL
  SELECT r.bucket, r.i, r.request_id,
         len(list_filter(f.log, lambda x: x > r.us - {6 * 3600 * 1000000})) < 3,
         len(list_filter(f.log, lambda x: x > r.us - {6 * 3600 * 1000000}))::BIGINT,
         CASE WHEN len(list_filter(f.log, lambda x: x > r.us - {6 * 3600 * 1000000})) < 3
              THEN list_append(list_filter(f.log, lambda x: x > r.us - {6 * 3600 * 1000000}), r.us)
              ELSE list_filter(f.log, lambda x: x > r.us - {6 * 3600 * 1000000}) END
  FROM f JOIN r ON r.bucket = f.bucket AND r.i = f.i + 1)
SELECT request_id, admitted, in_window, greatest(0, 3 - len(log))::BIGINT AS remaining FROM f"""

FAILS = "(SELECT event_id, ts, user_id AS identifier FROM events WHERE event_type = 'error')"

ORACLE["failed_attempts"] = f"""
SELECT identifier, count(*)::BIGINT AS failures FROM {FAILS} GROUP BY identifier"""

ORACLE["flag_attempts"] = f"""
SELECT event_id, identifier, n AS failures_so_far, n > 5 AS suspicious, (n > 5 OR n > 10) AS blocked
FROM (SELECT event_id, identifier,
             count(*) OVER (PARTITION BY identifier ORDER BY ts, event_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS n
      FROM {FAILS})"""

ORACLE["blocked_requests"] = f"""
SELECT event_id, user_id AS identifier FROM events
WHERE user_id IN (SELECT identifier FROM {FAILS} GROUP BY identifier
                  HAVING count(*) > 5 OR count(*) > 10)"""

ORACLE["repeat_requests"] = """
SELECT event_id, repeats, repeats > 10 AS repeated
FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, md5(props))::BIGINT AS repeats
      FROM events)"""

# --------------------------------------------------------------- cache ---
OPS = """
ops AS (
  SELECT event_id AS op_id, ts, user_id,
         'key:' || (json_extract_string(props, '$.k')::BIGINT)::VARCHAR AS key,
         CASE WHEN event_type IN ('view', 'click') THEN 'get'
              WHEN event_type IN ('signup', 'purchase') THEN 'set' ELSE 'delete' END AS op,
         round(value * 100)::BIGINT AS size_bytes, 3600::BIGINT AS ttl_s, value
  FROM events)"""

REPLAY = """
rp0 AS (
  SELECT *,
    last_value(CASE WHEN op IN ('set', 'delete') THEN op END IGNORE NULLS) OVER w AS lw_op,
    last_value(CASE WHEN op IN ('set', 'delete') THEN epoch_us(ts) END IGNORE NULLS) OVER w AS lw_us,
    last_value(CASE WHEN op IN ('set', 'delete') THEN ttl_s END IGNORE NULLS) OVER w AS lw_ttl
  FROM ops
  WINDOW w AS (PARTITION BY key ORDER BY epoch_us(ts), op_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rp AS (
  SELECT *, CASE WHEN op <> 'get' THEN op
                 WHEN lw_op = 'set' AND epoch_us(ts) > lw_us + lw_ttl * 1000000 THEN 'expired'
                 WHEN lw_op = 'set' THEN 'hit' ELSE 'miss' END AS status
  FROM rp0)"""

ORACLE["cache_stats"] = f"""WITH {OPS}, {REPLAY}
SELECT count_if(status = 'hit')::BIGINT AS hits,
       count_if(status IN ('miss', 'expired'))::BIGINT AS misses,
       count_if(status = 'set')::BIGINT AS sets, count_if(status = 'delete')::BIGINT AS deletes,
       count_if(status = 'expired')::BIGINT AS evictions, count_if(status = 'error')::BIGINT AS errors,
       round(CASE WHEN count_if(status IN ('hit', 'miss', 'expired')) > 0
                  THEN count_if(status = 'hit') / count_if(status IN ('hit', 'miss', 'expired'))
                  ELSE 0.0 END, 6) AS hit_ratio
FROM rp"""

ENTRIES = f"""
before AS (SELECT * FROM ops WHERE ts < {AS_OF}),
lastw AS (
  SELECT key, arg_max(op, (epoch_us(ts), op_id)) AS op, max((epoch_us(ts), op_id)) AS o,
         arg_max(ts, (epoch_us(ts), op_id)) AS at, arg_max(size_bytes, (epoch_us(ts), op_id)) AS size_bytes,
         arg_max(ttl_s, (epoch_us(ts), op_id)) AS ttl_s, arg_max(value, (epoch_us(ts), op_id)) AS value
  FROM before WHERE op IN ('set', 'delete') GROUP BY key),
entries AS (
  SELECT l.key, l.value, l.at AS created_at,
         (SELECT max(b.ts) FROM before b WHERE b.key = l.key) AS last_accessed,
         (SELECT count(*) FROM before b WHERE b.key = l.key AND b.op = 'get'
            AND (epoch_us(b.ts), b.op_id) > l.o) AS access_count,
         l.ttl_s, l.size_bytes
  FROM lastw l WHERE l.op = 'set'),
live AS (SELECT * FROM entries
         WHERE NOT (epoch_us({AS_OF}) > epoch_us(created_at) + ttl_s * 1000000)),
l1 AS (SELECT * FROM live WHERE split_part(key, ':', 2)::BIGINT % 2 = 0),
l2 AS (SELECT * FROM live WHERE split_part(key, ':', 2)::BIGINT % 3 = 0)"""

ORACLE["cache_lookup"] = f"""WITH {OPS}, {ENTRIES}
SELECT g.op_id, g.key,
       CASE WHEN l1.key IS NOT NULL THEN 'L1' WHEN l2.key IS NOT NULL THEN 'L2' END AS hit_level,
       CASE WHEN l1.key IS NOT NULL THEN false WHEN l2.key IS NOT NULL THEN true END AS promoted,
       round(coalesce(l1.value, l2.value), 6) AS value
FROM (SELECT op_id, key FROM ops WHERE op = 'get') g
LEFT JOIN l1 ON l1.key = g.key LEFT JOIN l2 ON l2.key = g.key"""

ORACLE["key_exists"] = f"""WITH {OPS}, {ENTRIES}
SELECT DISTINCT key FROM ops WHERE key IN (SELECT key FROM l1 UNION SELECT key FROM l2)"""

HOT = f"""
hot AS (
  SELECT key, count_if(epoch_us(ts) > epoch_us({AS_OF}) - 3600000000)::BIGINT AS freq,
         count_if(epoch_us(ts) > epoch_us({AS_OF}) - 3600000000)
           / ((epoch_us({AS_OF}) - max(epoch_us(ts))) / 1000000.0 + 1.0) AS score,
         min(epoch_us(ts)) AS first_us
  FROM ops WHERE ts > {AS_OF} - INTERVAL 24 HOUR AND ts <= {AS_OF} GROUP BY key
  ORDER BY score DESC, first_us, key LIMIT 50)"""

ORACLE["hot_keys"] = f"""WITH {OPS}, {HOT}
SELECT key, freq, round(score, 9) AS score FROM hot"""

# an entry is alive for its 3600 s
ORACLE["missing_keys"] = f"""WITH {OPS}, {ENTRIES}, {HOT},
alive AS (SELECT key, split_part(key, ':', 2)::BIGINT AS k FROM entries
          WHERE created_at + INTERVAL 3600 SECOND >= {AS_OF})
SELECT key, CASE WHEN key IN (SELECT key FROM alive WHERE k % 3 = 0) THEN 'L2' ELSE 'warm' END AS source
FROM hot WHERE key NOT IN (SELECT key FROM alive WHERE k % 2 = 0)"""

ORACLE["lru_evict"] = f"""WITH {OPS}, {ENTRIES},
e AS (SELECT *, epoch_us({AS_OF}) > epoch_us(created_at) + ttl_s * 1000000 AS expired FROM entries),
r AS (SELECT key, row_number() OVER w AS rank, sum(size_bytes) OVER w AS running_bytes
      FROM e WHERE NOT expired
      WINDOW w AS (ORDER BY last_accessed DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT key, rank <= 50 AND running_bytes <= 1000000 AS kept,
       CASE WHEN rank <= 50 AND running_bytes <= 1000000 THEN NULL ELSE 'size_limit' END AS reason,
       rank::BIGINT AS rank, running_bytes::BIGINT AS running_bytes FROM r
UNION ALL
SELECT key, false, 'expired', NULL, NULL FROM e WHERE expired"""

ORACLE["coalesce_writes"] = f"""WITH {OPS},
s AS (SELECT * EXCLUDE ttl_s, CASE WHEN op_id % 3 <> 0 THEN op_id % 7 * 600 END AS ttl_s,
             floor(epoch_us(ts) / 5000000)::BIGINT AS batch FROM ops WHERE op = 'set')
SELECT k.batch, k.key, round(k.value, 6) AS value, t.ttl_s
FROM (SELECT batch, key, arg_max(value, op_id) AS value FROM s GROUP BY batch, key) k
LEFT JOIN (SELECT batch, arg_min(ttl_s, op_id) AS ttl_s FROM s WHERE ttl_s IS NOT NULL
           GROUP BY batch) t ON t.batch = k.batch"""

# ---------------------------------------------------- routing and costs ---
ORACLE["route_provider"] = f"""WITH {USER_TURNS}
SELECT request_id, coalesce(provider, 'ollama') AS selected,
       CASE WHEN provider IS NULL THEN 'ollama,anthropic,openai' ELSE provider END AS candidates
FROM turns"""

USAGE = """
prices(provider, model, cost_in_1k, cost_out_1k) AS (
  VALUES ('openai', 'gpt-4', 0.03, 0.06), ('anthropic', 'claude-2', 0.008, 0.024),
         ('ollama', 'llama3', 0.0, 0.0)),
conv AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations),
u0 AS (
  SELECT conv_id * 100 + turn - 1 AS request_id,
         CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 50 END AS user_id,
         CASE conv_id % 4 WHEN 1 THEN 'openai' WHEN 2 THEN 'anthropic' ELSE 'ollama' END AS provider,
         CASE WHEN conv_id % 10 = 0 THEN 'error' ELSE 'success' END AS status,
         len(list_filter(regexp_split_to_array(coalesce(prompt, ''), '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE
           AS input_tokens,
         len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE AS output_tokens
  FROM conv WHERE role = 'assistant'),
usage AS (
  SELECT u0.*, p.model, u0.output_tokens * 0.02::DOUBLE AS latency_s,
         u0.input_tokens / 1000.0 * p.cost_in_1k::DOUBLE
           + u0.output_tokens / 1000.0 * p.cost_out_1k::DOUBLE AS cost_usd
  FROM u0 JOIN prices p USING (provider))"""

ORACLE["price_usage"] = f"""WITH {USAGE}
SELECT request_id, provider, model, status, round(input_tokens, 6) AS input_tokens,
       round(output_tokens, 6) AS output_tokens, round(cost_usd, 6) AS cost_usd FROM usage"""

ORACLE["llm_usage"] = f"""WITH {USAGE}
SELECT provider, model, status, coalesce(user_id::VARCHAR, 'anonymous') AS "user",
       count(*)::BIGINT AS requests,
       round(sum(CASE WHEN input_tokens > 0 THEN input_tokens ELSE 0 END), 6) AS input_tokens,
       round(sum(CASE WHEN output_tokens > 0 THEN output_tokens ELSE 0 END), 6) AS output_tokens,
       round(sum(CASE WHEN cost_usd > 0 THEN cost_usd ELSE 0 END), 6) AS cost_usd,
       round(sum(latency_s), 6) AS latency_s
FROM usage GROUP BY ALL"""

ORACLE["provider_stats"] = f"""WITH {USAGE},
cfg(provider, priority, enabled) AS (VALUES ('openai', 1, true), ('anthropic', 2, true),
                                            ('ollama', 3, true)),
per AS (SELECT provider, count(*) AS requests, count_if(status <> 'success') AS failures
        FROM usage GROUP BY provider)
SELECT c.provider, c.priority, c.enabled, coalesce(p.requests, 0)::BIGINT AS requests,
       coalesce(p.failures, 0)::BIGINT AS failures
FROM cfg c LEFT JOIN per p USING (provider)"""

ORACLE["lb_counts"] = f"""WITH {USAGE}
SELECT request_id, provider,
       count(*) OVER w::BIGINT AS requests_so_far,
       sum((status <> 'success')::INTEGER) OVER w::BIGINT AS failures_so_far
FROM usage
WINDOW w AS (PARTITION BY provider ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

ORACLE["token_estimate"] = """
SELECT conv_id, turn,
       round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3, 6) AS tokens
FROM conversations"""

# -------------------------------------------------------------- traces ---
SPANS = """
spans AS (
  SELECT event_id AS span_id,
         lag(event_id) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS parent_span_id,
         first_value(event_id) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS trace_id,
         event_type AS operation, user_id, ts AS start_ts,
         CASE WHEN event_type = 'error' THEN NULL
              ELSE make_timestamp(epoch_us(ts) + round(value * 1000)::BIGINT) END AS end_ts,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status
  FROM events),
pairs AS (
  SELECT span_id, trace_id,
         CASE WHEN end_ts IS NOT NULL THEN (epoch_us(end_ts) - epoch_us(start_ts)) / 1000.0 END
           AS duration_ms,
         end_ts IS NULL AS active, CASE WHEN end_ts IS NULL THEN 'active' ELSE status END AS status
  FROM spans)"""

ORACLE["span_pairs"] = f"""WITH {SPANS}
SELECT p.span_id, p.trace_id, round(duration_ms, 6) AS duration_ms, active, p.status,
       CASE WHEN active THEN 'op=' || operation || ',state=open'
            ELSE 'op=' || operation || ',state=closed,user=' || user_id::VARCHAR END AS tags,
       CASE WHEN active THEN 'start:' || p.span_id::VARCHAR
            ELSE 'start:' || p.span_id::VARCHAR || ',end:' || p.status END AS logs
FROM pairs p JOIN spans s USING (span_id)"""

ORACLE["trace_stats"] = f"""WITH {SPANS}
SELECT count_if(active)::BIGINT AS active_spans, count_if(NOT active)::BIGINT AS completed_spans,
       round(CASE WHEN count_if(NOT active) > 0
                  THEN coalesce(sum(CASE WHEN NOT active THEN duration_ms END), 0) / count_if(NOT active)
                  ELSE 0.0 END, 6) AS avg_duration_ms
FROM pairs"""

ORACLE["trace_roots"] = f"""WITH RECURSIVE {SPANS},
walk(span_id, root_id, depth) AS (
  SELECT span_id, span_id, 0 FROM spans WHERE parent_span_id IS NULL
  UNION ALL
  SELECT s.span_id, w.root_id, w.depth + 1 FROM spans s JOIN walk w ON s.parent_span_id = w.span_id)
SELECT span_id, root_id AS trace_id, depth::BIGINT AS depth, false AS orphan FROM walk"""

ORACLE["trace_sample"] = f"""WITH {SPANS}
SELECT span_id, trace_id FROM spans
WHERE ('0x' || substr(md5(trace_id::VARCHAR), 1, 8))::BIGINT % 1000 < 100"""

# -------------------------------------------------------------- alerts ---
MATCHES = """
rules(name, metric, op, threshold, severity, cooldown_s) AS (
  VALUES ('purchase_high', 'purchase', '>', 150.0, 'high', 86400),
         ('click_ge', 'click', '>=', 100.0, 'medium', 3600),
         ('view_le', 'view', '<=', 1.0, 'low', 300)),
matches AS (
  SELECT r.name, r.cooldown_s, r.severity, e.event_id, e.ts, e.value
  FROM events e JOIN rules r ON r.metric = e.event_type
  WHERE (r.op = '>' AND e.value > r.threshold) OR (r.op = '>=' AND e.value >= r.threshold)
     OR (r.op = '<=' AND e.value <= r.threshold))"""

COOLDOWN = """
m AS (SELECT *, epoch_us(ts) AS us,
             row_number() OVER (PARTITION BY name ORDER BY epoch_us(ts), event_id) AS i FROM matches),
cd(name, i, event_id, fired, last_us) AS (
  SELECT name, i, event_id, true, us FROM m WHERE i = 1
  UNION ALL
  SELECT m.name, m.i, m.event_id, m.us - cd.last_us >= m.cooldown_s::BIGINT * 1000000,
         CASE WHEN m.us - cd.last_us >= m.cooldown_s::BIGINT * 1000000 THEN m.us ELSE cd.last_us END
  FROM cd JOIN m ON m.name = cd.name AND m.i = cd.i + 1)"""

ORACLE["alert_match"] = f"""WITH {MATCHES}
SELECT name, event_id, round(value, 6) AS value FROM matches"""

ORACLE["alert_cooldown"] = f"""WITH RECURSIVE {MATCHES}, {COOLDOWN}
SELECT name, event_id FROM cd WHERE fired"""

ORACLE["alert_stats"] = f"""WITH RECURSIVE {MATCHES}, {COOLDOWN},
fired AS (SELECT cd.name, m.severity FROM cd JOIN m USING (name, i) WHERE cd.fired)
SELECT severity, count(*)::BIGINT AS total, count(*)::BIGINT AS active
FROM fired GROUP BY ROLLUP (severity)"""


# ----------------------------------------------------------- streaming ---
ORACLE["stream_counters"] = """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       event_type, count(*)::BIGINT AS requests, round(sum(value), 6) AS value_sum
FROM events GROUP BY ALL"""

ORACLE["stream_rate_limit"] = ORACLE["rate_limit_admit"]


# ------------------------------------------------- sources, html, rag ---
# Character references, dropped blocks, links and titles.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
DROP_BLOCKS = [r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->"]
LINK = r'(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def unescape_sql(x: str) -> str:
    for a, b in ENTITIES:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def html_text_sql(x: str) -> str:
    for p in DROP_BLOCKS:
        x = f"regexp_replace({x}, {lit(p)}, '', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', chr(10), 'g')"
    x = unescape_sql(x)
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({x}, '^[ \\n]+|[ \\n]+$', '', 'g')"


ORACLE["html_to_text"] = f"SELECT page_id, {html_text_sql('html')} AS text FROM pages"

ORACLE["page_scrape"] = f"""
SELECT page_id, url, {html_text_sql('html')} AS content, {unescape_sql(f"regexp_extract(html, {lit(TITLE)}, 1)")} AS title,
       len(regexp_extract_all(html, {lit(LINK)}, 1))::INTEGER AS links FROM pages"""

ORACLE["extract_links"] = f"""
SELECT page_id, (pos - 1)::INTEGER AS pos, t[pos] AS text, h[pos] AS href
FROM (SELECT page_id, h, t, generate_subscripts(h, 1) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, {lit(LINK)}, 1) AS h,
                   regexp_extract_all(html, {lit(LINK)}, 2) AS t FROM pages))"""

URL_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
URL_HOST = "regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)"
TITLE_URL = (f"CASE WHEN regexp_replace({URL_PATH}, '^/+|/+$', '', 'g') <> '' "
             f"THEN split_part(regexp_replace({URL_PATH}, '^/+|/+$', '', 'g'), '/', -1) "
             f"ELSE {URL_HOST} END")

ORACLE["title_from_url"] = f"SELECT page_id, {TITLE_URL} AS title FROM pages"

ORACLE["url_documents"] = f"""
SELECT page_id AS doc_id, {TITLE_URL} AS title, url AS source_url, 'html' AS document_type,
       octet_length(encode(html))::INTEGER AS file_size FROM pages"""

RAW = """
raw AS (
  SELECT doc_id, text,
         '/docs/' || doc_id::VARCHAR || '.' ||
         CASE WHEN doc_id % 50 = 0 THEN 'exe'
              ELSE ['pdf', 'docx', 'txt', 'html', 'htm', 'md', 'json', 'csv'][doc_id % 8 + 1] END
           AS file_path
  FROM documents)"""

ORACLE["doc_type_ext"] = f"""WITH {RAW}
SELECT doc_id, CASE split_part(file_path, '.', -1)
  WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'txt' THEN 'txt' WHEN 'html' THEN 'html'
  WHEN 'htm' THEN 'html' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'csv' THEN 'csv'
  WHEN 'xlsx' THEN 'xlsx' ELSE 'txt' END AS document_type FROM raw"""

ORACLE["upload_filter"] = f"""WITH {RAW}
SELECT doc_id, split_part(file_path, '.', -1) AS extension,
       split_part(file_path, '.', -1) IN ('pdf', 'docx', 'txt', 'html', 'md', 'json') AS accepted,
       CASE WHEN split_part(file_path, '.', -1) IN ('pdf', 'docx', 'txt', 'html', 'md', 'json')
            THEN NULL ELSE 'File type .' || split_part(file_path, '.', -1) || ' not allowed' END AS reason
FROM raw"""

ORACLE["decode_text"] = """
SELECT doc_id, text,
       (octet_length(encode(text)) + CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END)::INTEGER AS file_size
FROM documents"""

ORACLE["ingest_report"] = f"""WITH {RAW},
ok AS (SELECT doc_id, text FROM raw
       WHERE split_part(file_path, '.', -1) IN ('pdf', 'docx', 'txt', 'html', 'md', 'json')),
w AS (SELECT doc_id, s, length(text) AS n, {strip_sql('substr(text, s + 1, 512)')} AS content
      FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 462)) AS s
            FROM ok WHERE length(text) > 0)),
k AS (SELECT doc_id, count(*) AS c FROM w
      WHERE (s = 0 OR s - 462 + 512 < n) AND length(content) >= 50 GROUP BY doc_id)
SELECT ok.doc_id, coalesce(k.c, 0)::BIGINT AS chunks_created, true AS success
FROM ok LEFT JOIN k USING (doc_id)"""

ORACLE["collection_stats"] = """
WITH w AS (SELECT source AS collection, s, length(text) AS n,
                  regexp_replace(substr(text, s + 1, 512), '^\\s+|\\s+$', '', 'g') AS content
           FROM (SELECT source, text, unnest(generate_series(0, length(text) - 1, 462)) AS s
                 FROM documents WHERE length(text) > 0))
SELECT collection, count(*)::BIGINT AS chunks FROM w
WHERE (s = 0 OR s - 462 + 512 < n) AND length(content) >= 50 GROUP BY collection"""

ORACLE["embed"] = """
WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'),
                                             lambda x: x <> '')) AS tok FROM documents),
b AS (SELECT doc_id, (('0x' || substr(md5(tok), 1, 8))::BIGINT % 384)::INTEGER AS dim_index,
             count(*) AS cnt FROM t GROUP BY ALL)
SELECT doc_id, dim_index, round(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id)), 6) AS weight
FROM b"""

CORPUS_T = CORPUS.replace("d.lang, d.source, e.label", "d.lang, d.source, e.label, 'doc-' || e.vec_id::VARCHAR AS title")
KNN5_T = knn_sql(5).replace("SELECT q.query_id, c.chunk_id, c.content,", "SELECT q.query_id, c.chunk_id, c.content, c.title,")


def rag_sql(max_len: int) -> str:
    return f"""WITH {CORPUS_T}, {KNN5_T},
p AS (SELECT query_id, rank, '[Source: ' || title || ']' || chr(10) || content || chr(10) || '---' || chr(10) AS piece
      FROM hits),
r AS (SELECT *, sum(length(piece)) OVER (PARTITION BY query_id ORDER BY rank
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM p),
ctx AS (SELECT query_id, coalesce(string_agg(piece, chr(10) ORDER BY rank) FILTER (WHERE run <= {max_len}), '') AS context,
               count(*) FILTER (WHERE run <= {max_len})::BIGINT AS pieces
        FROM r GROUP BY query_id)"""


ORACLE["rag_context"] = rag_sql(4000) + "\nSELECT query_id, context, pieces FROM ctx"

ORACLE["rag_prompt"] = rag_sql(4000) + """
SELECT query_id, md5('You are a helpful assistant. Use the provided context to answer the question. '
                     || 'If the context doesn''t contain relevant information, say so.'
                     || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10)
                     || 'Question: What is document ' || query_id::VARCHAR || ' about?'
                     || chr(10) || chr(10) || 'Answer:') AS prompt_md5 FROM ctx"""

ORACLE["chat_messages"] = """
SELECT conv_id, turn, n_messages, messages_sha256 FROM (
  SELECT conv_id, turn, role, count(*) OVER w::INTEGER AS n_messages,
         sha256(array_to_string(list(role || chr(10) || text) OVER w, chr(10))) AS messages_sha256
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE role = 'user'"""

ORACLE["last_n"] = """
SELECT user_id, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5"""

ORACLE["validate_chat"] = f"""WITH {USER_TURNS},
v AS (SELECT request_id, list_filter([
        CASE WHEN length(trim(message)) < 1 THEN 'message is empty' END,
        CASE WHEN length(trim(message)) > 8192 THEN 'message longer than 8192' END,
        CASE WHEN temperature < 0 OR temperature > 2 THEN 'temperature outside 0..2' END,
        CASE WHEN max_tokens < 1 OR max_tokens > 4096 THEN 'max_tokens outside 1..4096' END,
        CASE WHEN provider IS NOT NULL AND provider NOT IN ('openai', 'anthropic', 'ollama')
             THEN 'unknown provider' END], lambda r: r IS NOT NULL) AS reasons FROM turns)
SELECT request_id, len(reasons) = 0 AS valid, array_to_string(reasons, '; ') AS reasons FROM v"""

HEADERS = f"""{HTTP},
hdr AS (
  SELECT request_id, content_length, client_ip AS cip, api_key AS k, user_id,
         CASE WHEN user_id % 3 = 0 THEN ' 172.16.' || (user_id % 7)::VARCHAR || '.1 , ' || client_ip END AS xff,
         CASE WHEN user_id % 3 = 1 THEN client_ip END AS real_ip,
         CASE WHEN user_id % 5 <> 0 THEN client_ip END AS peer,
         CASE WHEN user_id % 4 = 0 THEN 'key-' || api_key || '-long' END AS x_api_key,
         CASE WHEN user_id % 4 = 1 THEN 'Bearer ' || api_key END AS auth_hdr,
         CASE WHEN user_id % 10 = 0 THEN 'Googlebot/2.1 (+http://www.google.com/bot.html)'
              WHEN user_id % 10 = 1 THEN 'python-Scraper/1.0' ELSE 'Mozilla/5.0' END AS user_agent,
         CASE WHEN user_id % 6 = 0 THEN 'http' ELSE 'https' END AS scheme
  FROM http),
hk AS (SELECT *, CASE WHEN coalesce(x_api_key, auth_hdr, 'anonymous') LIKE 'Bearer %'
                      THEN substr(coalesce(x_api_key, auth_hdr, 'anonymous'), 8)
                      ELSE coalesce(x_api_key, auth_hdr, 'anonymous') END AS norm_key FROM hdr)"""

ORACLE["client_ip"] = f"""WITH {HEADERS}
SELECT request_id, coalesce(nullif(trim(split_part(xff, ',', 1)), ''), nullif(real_ip, ''), peer, 'unknown')
  AS client_ip FROM hdr"""

ORACLE["api_key_norm"] = f"""WITH {HEADERS} SELECT request_id, norm_key AS api_key FROM hk"""

ORACLE["key_prefix"] = f"""WITH {HEADERS}
SELECT request_id, CASE WHEN length(norm_key) > 8 THEN substr(norm_key, 1, 8) || '...' ELSE norm_key END
  AS key_prefix FROM hk"""

ORACLE["suspicious_ua"] = f"""WITH {HEADERS}
SELECT request_id, regexp_matches(lower(user_agent), 'bot|crawler|spider|scraper') AS suspicious FROM hdr"""

ORACLE["request_size_ok"] = f"""WITH {HEADERS}
SELECT request_id, coalesce(content_length <= 20000000, true) AS size_ok FROM hdr"""

ORACLE["require_https"] = f"""WITH {HEADERS} SELECT request_id, scheme = 'https' AS allowed FROM hdr"""

ORACLE["key_union"] = """
SELECT 'k0' AS api_key UNION SELECT 'k1' UNION SELECT 'k' || (user_id % 3)::VARCHAR FROM events"""

ORACLE["valid_keys"] = f"""WITH {HTTP}
SELECT request_id, api_key, api_key IN ('k0', 'k1') AS valid FROM http"""

ORACLE["error_catalog"] = """
WITH cat(i, exception, error_code, status_code) AS (VALUES
  (0, 'ValidationError', 'VALIDATION_ERROR', 422), (1, 'AuthenticationError', 'AUTHENTICATION_ERROR', 401),
  (2, 'AuthorizationError', 'AUTHORIZATION_ERROR', 403), (3, 'RateLimitExceededError', 'RATE_LIMIT_EXCEEDED', 429),
  (4, 'LLMProviderError', 'LLM_PROVIDER_ERROR', 502), (5, 'VectorDatabaseError', 'VECTOR_DATABASE_ERROR', 502),
  (6, 'CacheError', 'CACHE_ERROR', 500), (7, 'PluginError', 'PLUGIN_ERROR', 500),
  (8, 'PluginExecutionError', 'PLUGIN_EXECUTION_ERROR', 500), (9, 'PluginTimeoutError', 'PLUGIN_TIMEOUT_ERROR', 408),
  (10, 'SecurityError', 'SECURITY_ERROR', 403), (11, 'PIIDetectionError', 'PII_DETECTION_ERROR', 500),
  (12, 'FileProcessingError', 'FILE_PROCESSING_ERROR', 422), (13, 'ConfigurationError', 'CONFIGURATION_ERROR', 500),
  (14, 'ServiceUnavailableError', 'SERVICE_UNAVAILABLE', 503), (15, 'ContentTooLargeError', 'CONTENT_TOO_LARGE', 413),
  (16, 'NotFoundError', 'NOT_FOUND', 404), (17, 'DatabaseError', 'DATABASE_ERROR', 500))
SELECT e.event_id, c.exception, c.error_code, c.status_code
FROM events e JOIN cat c ON c.i = e.user_id % 18 WHERE e.event_type = 'error'"""

ORACLE["domain_reputation"] = f"""
WITH rep(host, safe, category, risk_score) AS (VALUES
  ('blog.tionsh.example.net', false, 'spam', 0.9), ('thther.example.org', true, 'news', 0.1),
  ('blog.tionsh.example.com', false, 'malware', 0.95))
SELECT p.page_id, p.host, coalesce(r.safe, true) AS safe, coalesce(r.category, 'unknown') AS category,
       coalesce(r.risk_score::DOUBLE, 0.0) AS risk_score
FROM (SELECT page_id, {URL_HOST} AS host FROM pages) p LEFT JOIN rep r USING (host)"""

ORACLE["domain_allowed"] = f"""
SELECT page_id, {URL_HOST} IN ('thther.example.org', 'blog.ththan.example.net') AS allowed FROM pages"""

ORACLE["retention"] = f"SELECT event_id FROM events WHERE ts > {AS_OF} - INTERVAL 7 DAY"

ORACLE["prom_text"] = f"""WITH {HTTP}
SELECT 'http_requests_total{{endpoint="' || endpoint || '",method="' || method || '",status="'
       || status_code::VARCHAR || '"}} ' || count(*)::VARCHAR AS line
FROM http GROUP BY method, endpoint, status_code"""

ORACLE["parse_request_log"] = f"""WITH {HTTP}
SELECT request_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, method, endpoint, status_code,
       round(duration_s, 6) AS duration_s, client_ip, api_key, content_length FROM http"""

ORACLE["duration_ms"] = f"WITH {HTTP} SELECT request_id, round(duration_s * 1000, 2) AS duration_ms FROM http"

ORACLE["cache_key"] = f"""WITH {USER_TURNS}
SELECT request_id, 'chat:' || coalesce(provider, 'any') || ':' || max_tokens::VARCHAR || ':'
       || substr(md5(to_json({{'message': message}})), 1, 8) AS cache_key FROM turns"""

ORACLE["round_robin"] = f"""WITH {USER_TURNS}
SELECT request_id, ['openai', 'anthropic', 'ollama'][((row_number() OVER (ORDER BY request_id) - 1) % 3) + 1]
  AS selected FROM turns"""

ORACLE["cache_stats_combined"] = f"""WITH {OPS}, {REPLAY}
SELECT count_if(status = 'hit')::BIGINT AS hits, count_if(status IN ('miss', 'expired'))::BIGINT AS misses,
       round(count_if(status = 'hit') / greatest(1, count_if(status IN ('hit', 'miss', 'expired'))), 6)
         AS hit_ratio
FROM rp"""

ORACLE["latest_quote"] = """
WITH t AS (SELECT event_type AS symbol, value, ts, event_id,
                  lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events)
SELECT symbol, round(arg_max(value, (ts, event_id)), 6) AS price,
       round(arg_max(value - prev, (ts, event_id)), 6) AS change,
       round(arg_max((value - prev) / prev * 100, (ts, event_id)), 6) AS percent,
       count(*)::BIGINT AS volume
FROM t GROUP BY symbol"""


# k-means on unit vectors (the 20,000 smallest md5 of the id), then a search of
# the cells of the nearest centres
def _near(rows: str, centres: str, key: str) -> str:
    return (f"SELECT {key}, u, cell FROM (SELECT {key}, u, cell, row_number() OVER (PARTITION BY {key} "
            f"ORDER BY list_dot_product(u, c) DESC, cell) AS r FROM {rows}, {centres}) WHERE r = 1")


def _kmeans(rounds: int) -> str:
    out = []
    for k in range(rounds):
        out.append(f"""near{k} AS MATERIALIZED ({_near('sample', f'c{k}', 'o')}),
mean{k} AS (SELECT cell, list(t ORDER BY i) AS m FROM (
  SELECT cell, i, sum(x) AS t FROM (SELECT o, cell, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM near{k})
  GROUP BY cell, i) GROUP BY cell),
c{k + 1} AS MATERIALIZED (
  SELECT cell, CASE WHEN m IS NULL OR list_dot_product(m, m) = 0 THEN c
                    ELSE list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) END AS c
  FROM c{k} LEFT JOIN mean{k} USING (cell))""")
    return ",\n".join(out)


APPROX = f"""{CORPUS},
unit AS MATERIALIZED (SELECT chunk_id, list_transform(cv, lambda x: x / sqrt(list_dot_product(cv, cv))) AS u FROM corpus),
sample AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY md5(chunk_id::VARCHAR), chunk_id::VARCHAR) AS o, u FROM unit
  QUALIFY o <= 20000),
c0 AS MATERIALIZED (SELECT o - 1 AS cell, u AS c FROM sample
                    WHERE o <= (SELECT greatest(1, least(1024, count(*) // 8)) FROM sample)),
{_kmeans(6)},
asker AS (SELECT * FROM sample WHERE o <= 200),
friend AS (SELECT a.o, s.o AS f FROM asker a, sample s
           QUALIFY row_number() OVER (PARTITION BY a.o ORDER BY list_dot_product(a.u, s.u) DESC, s.o) <= 10),
place AS (SELECT o, cell, row_number() OVER (PARTITION BY o ORDER BY list_dot_product(u, c) DESC, cell) AS p
          FROM asker, c6),
shome AS ({_near('sample', 'c6', 'o')}),
probe AS (SELECT list_sort(list(p))[ceil(0.95 * count(*))::BIGINT] AS n
          FROM friend f JOIN shome h ON h.o = f.f JOIN place p ON p.o = f.o AND p.cell = h.cell),
home AS MATERIALIZED ({_near('unit', 'c6', 'chunk_id')}),
asked AS (SELECT chunk_id AS query_id, cell FROM unit, c6 WHERE chunk_id % 50 = 0
          QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY list_dot_product(u, c) DESC, cell)
                  <= (SELECT n FROM probe)),
met AS MATERIALIZED (SELECT query_id, h.chunk_id FROM asked JOIN home h USING (cell)),
approx AS (
  SELECT query_id, m.chunk_id, (1 + list_cosine_similarity(qv, cv)) / 2 AS similarity_score,
         row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, m.chunk_id) AS rank
  FROM met m JOIN qry USING (query_id) JOIN corpus c ON c.chunk_id = m.chunk_id QUALIFY rank <= 10)"""

ORACLE["knn_approx"] = f"""WITH {APPROX}
SELECT query_id, chunk_id, rank, round(similarity_score, 6) AS similarity_score FROM approx"""

ORACLE["knn_recall"] = f"""WITH {APPROX}, {knn_sql(10)}
SELECT round(avg(CASE WHEN a.chunk_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall,
       avg(CASE WHEN a.chunk_id IS NULL THEN 0.0 ELSE 1.0 END) >= 0.9 AS enough,
       round((SELECT count(*) FROM met) / ((SELECT count(*) FROM qry) * (SELECT count(*) FROM corpus)::DOUBLE), 6) AS touched_share,
       (SELECT count(*) FROM c6)::INTEGER AS cells, (SELECT n FROM probe)::INTEGER AS probes
FROM hits h LEFT JOIN approx a ON a.query_id = h.query_id AND a.chunk_id = h.chunk_id"""


# ------------------------------------------------------------- plug-ins ---
ORACLE["sql_query"] = """
SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue, count(*)::BIGINT AS n
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus"""

ORACLE["links_udtf"] = ORACLE["extract_links"]

ORACLE["stream_ingest"] = ORACLE["chunk_sliding"]
ORACLE["stream_dedup"] = """
WITH RECURSIVE r AS (
  SELECT event_id, user_id::VARCHAR || ':' || event_type AS cache_key, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id) AS i FROM events),
f(cache_key, i, event_id, answered, last_us) AS (
  SELECT cache_key, i, event_id, true, us FROM r WHERE i = 1
  UNION ALL
  SELECT r.cache_key, r.i, r.event_id, r.us - f.last_us >= 3600000000,
         CASE WHEN r.us - f.last_us >= 3600000000 THEN r.us ELSE f.last_us END
  FROM f JOIN r ON r.cache_key = f.cache_key AND r.i = f.i + 1)
SELECT cache_key, event_id FROM f WHERE answered"""

# an entry that no write replaces in time expires once a later operation of its
# key or the last watermark (ten minutes before the newest row) is past it
ORACLE["stream_cache_ttl"] = f"""WITH {OPS},
o AS (SELECT op_id, key, op, epoch_us(ts) AS us, epoch_us(ts) + coalesce(nullif(ttl_s, 0), 3600) * 1000000 AS until FROM ops),
w AS (SELECT *, lead(us) OVER (PARTITION BY key ORDER BY us, op_id) AS next_write FROM o WHERE op <> 'get'),
g AS (SELECT *, max(us) OVER (PARTITION BY key) AS key_end, max(us) OVER () AS stream_end FROM o),
before AS (
  SELECT o.op_id, o.key, o.op, o.us, arg_max(w.op, (w.us, w.op_id)) AS last_op, arg_max(w.until, (w.us, w.op_id)) AS until
  FROM o LEFT JOIN w ON w.key = o.key AND (w.us, w.op_id) < (o.us, o.op_id) GROUP BY ALL)
SELECT op_id, key, CASE WHEN op <> 'get' THEN op WHEN last_op = 'set' AND us <= until THEN 'hit' ELSE 'miss' END AS status,
       NULL::BIGINT AS until_us FROM before
UNION ALL
SELECT NULL, w.key, 'expired', w.until FROM w JOIN g USING (op_id)
WHERE w.op = 'set' AND (next_write IS NULL OR next_write > w.until)
  AND (key_end > w.until OR ceil(w.until / 1000.0) < floor(stream_end / 1000.0) - 600000)"""

ORACLE["stream_write_behind"] = f"""WITH {OPS}
SELECT key, round(arg_max(value, (us, op_id)), 6) AS value, arg_max(op_id, (us, op_id)) AS last_seq,
       arg_max(stretch, (us, op_id)) AS flush_at, arg_max(part, (us, op_id)) AS flush_no
FROM (SELECT *, ((row_number() OVER (PARTITION BY stretch ORDER BY us, op_id) - 1) // 100)::INTEGER AS part
      FROM (SELECT key, value, op_id, epoch_us(ts) AS us, epoch_us(ts) // 5000000 * 5000000 AS stretch FROM ops WHERE op = 'set'))
GROUP BY key"""

ORACLE["stream_spans"] = f"""WITH {SPANS}
SELECT span_id, CASE WHEN NOT active AND duration_ms <= 3600000 THEN round(duration_ms, 6) END AS duration_ms,
       active OR duration_ms > 3600000 AS active FROM pairs"""

ANSWERS = """
a AS (SELECT conv_id * 1000 + turn AS request_id, conv_id, text, greatest(ceil(length(text) / 50.0), 1)::INTEGER AS n
      FROM conversations WHERE role = 'assistant'),
chunks AS (
  SELECT request_id, seq::INTEGER AS seq, substr(text, (seq * 50 + 1)::BIGINT, 50) AS chunk, seq = n - 1 AS done, false AS is_error
  FROM (SELECT *, unnest(range(n)) AS seq FROM a)
  UNION ALL SELECT request_id, n, 'Error: upstream', false, true FROM a WHERE conv_id % 10 = 0)"""

ORACLE["stream_chunks_sanitize"] = f"""WITH {ANSWERS},
named AS (SELECT *, request_id * 10000 + seq AS piece FROM chunks),
{replaced_sql('named', 'piece', 'chunk', 0.0, 'clean', TAG)}
SELECT request_id, seq, replaced AS chunk, done, is_error FROM clean"""

ORACLE["assemble_stream"] = f"""WITH {ANSWERS}
SELECT request_id, text AS content, CASE WHEN conv_id % 10 = 0 THEN 'error_stream' ELSE 'success_stream' END AS status
FROM a"""

ORACLE["stream_business"] = f"""WITH {BUSINESS}
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_start, kind,
       count(*)::BIGINT AS events, count(DISTINCT user_id)::BIGINT AS unique_users
FROM business, range(24) h(k) GROUP BY ALL"""

ORACLE["stream_gauges"] = """
SELECT strftime(time_bucket(INTERVAL 60 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id,
       round(arg_max(value, (ts, event_id)), 6) AS value
FROM events GROUP BY ALL"""

ORACLE["stream_alerts"] = ORACLE["alert_cooldown"]

ORACLE["stream_threats"] = f"""
WITH n AS ({window_count_sql(60)}),
f AS (SELECT event_id, sum((event_type = 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS failures_so_far,
             length(props) < 10 AND NOT contains(props, ' ') AS probe FROM events)
SELECT event_id, user_id, n AS requests_in_window, n > 1 AS breach, failures_so_far, failures_so_far > 5 AS suspicious, probe
FROM n JOIN f USING (event_id)"""


# ------------------------------------------------ ingest and collections ---
def hybrid_ctes() -> str:
    full = ORACLE["chunk_hybrid"]
    return full[:full.rindex("\nSELECT doc_id, chunk_index")]


ORACLE["ingest"] = f"""{hybrid_ctes()},
ck AS MATERIALIZED ({chunk_select('hy')}),
tk AS MATERIALIZED (SELECT DISTINCT chunk_id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS tok FROM ck),
hx AS MATERIALIZED (SELECT tok, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 384 AS dim FROM (SELECT DISTINCT tok FROM tk)),
bk AS (SELECT DISTINCT chunk_id, dim FROM tk JOIN hx USING (tok)),
vs AS (SELECT chunk_id, count(*)::INTEGER AS dims, sum(dim)::BIGINT AS dim_sum FROM bk GROUP BY chunk_id)
SELECT ck.chunk_id, doc_id, 'docs' AS collection, chunk_index, content, coalesce(dims, 0) AS dims,
       coalesce(dim_sum, 0)::BIGINT AS dim_sum
FROM ck LEFT JOIN vs USING (chunk_id)"""

COLLECTION = f"col AS ({ORACLE['chunk_sliding']})"

ORACLE["delete_chunks"] = f"""WITH {COLLECTION} SELECT chunk_id, doc_id FROM col WHERE chunk_index % 3 <> 1"""
ORACLE["delete_document"] = f"""WITH {COLLECTION} SELECT chunk_id, doc_id FROM col WHERE doc_id % 4 <> 0"""
ORACLE["upsert_chunks"] = f"""WITH {COLLECTION}
SELECT chunk_id, doc_id, chunk_index, CASE WHEN chunk_index = 0 THEN 'v2 ' || content ELSE content END AS content,
       CASE WHEN chunk_index = 0 THEN 2 ELSE 0 END AS version FROM col
UNION ALL
SELECT 'new-' || chunk_id, doc_id, -1, content, 1 FROM col WHERE chunk_index = 0 AND doc_id % 3 = 0"""
ORACLE["collection_schema"] = f"""WITH {COLLECTION}
SELECT chunk_id, col.doc_id::VARCHAR AS doc_id, NULL::VARCHAR AS language, quality::DOUBLE AS quality_score
FROM col LEFT JOIN labels USING (doc_id)"""
ORACLE["audit_sink"] = "SELECT event_id, user_id, ts::DATE::VARCHAR AS date FROM events"
ORACLE["cache_json"] = f"""WITH {OPS}
SELECT op_id, '{{"key":"' || key || '","op":"' || op || '","size_bytes":' || size_bytes::VARCHAR || '}}' AS record,
       key, op, size_bytes FROM ops"""
ORACLE["event_append"] = """
SELECT 'revenue' AS kind, user_id, round(value, 6) AS amount, CASE WHEN user_id % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
       'api' AS source, 0 AS n_metadata FROM events WHERE event_type = 'purchase'"""
ORACLE["doc_type_mime"] = "SELECT page_id, ['pdf', 'html', 'json', 'txt'][page_id % 4 + 1] AS document_type FROM pages"
ORACLE["file_limits"] = f"""WITH {RAW},
s AS (SELECT doc_id, split_part(file_path, '.', -1) AS extension, octet_length(encode(text))::BIGINT * 10000 AS file_size FROM raw)
SELECT * FROM s WHERE file_size <= 52428800 AND extension IN ('pdf', 'docx', 'txt', 'html', 'md', 'json')"""
ORACLE["validate_search"] = f"""WITH {USER_TURNS}
SELECT request_id, array_to_string(list_filter([
  CASE WHEN length(message) < 1 OR length(message) > 1024 THEN 'query length outside 1..1024' END,
  CASE WHEN turn * 15 < 1 OR turn * 15 > 50 THEN 'limit outside 1..50' END,
  CASE WHEN turn - 1 < 0 THEN 'offset below 0' END,
  CASE WHEN turn * 0.25 > 1 THEN 'threshold outside 0..1' END], lambda r: r IS NOT NULL), '; ') AS reasons FROM turns"""
ORACLE["validate_ingest"] = """
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN n_chars % 3000 < 100 OR n_chars % 3000 > 2048 THEN 'chunk_size outside 100..2048' END,
  CASE WHEN n_chars % 700 > 500 THEN 'chunk_overlap outside 0..500' END,
  CASE WHEN n_chars % 700 >= n_chars % 3000 THEN 'chunk_overlap not below chunk_size' END], lambda r: r IS NOT NULL), '; ') AS reasons
FROM documents"""
ORACLE["result_projection"] = f"""WITH {CORPUS_T}, {KNN5_T}
SELECT query_id, chunk_id, title, NULL::INTEGER AS chunk_index, NULL::VARCHAR AS document_type, NULL::VARCHAR AS file_path, rank FROM hits"""

# ------------------------------------------------------- security events ---
CHECKED = f"""{USER_TURNS},
timed AS (SELECT request_id, conv_id % 10 AS user_id, message,
                 TIMESTAMP '2024-01-30 00:00:00' - (request_id % 5000) * INTERVAL 1 SECOND AS ts FROM turns),
counted AS ({window_count_sql(60, src='timed', idc='request_id')}),
chk AS (SELECT timed.*, n > 1 AS breach FROM timed JOIN counted USING (request_id)),
{risk_cte('chk', 'message', 'request_id')},
flagged AS (SELECT *, {has_pii_sql('message')} AS pii, length(message) < 10 AND NOT contains(message, ' ') AS probe FROM risk)"""
ORACLE["threat_verdict"] = f"""WITH {CHECKED}
SELECT request_id, CASE WHEN breach THEN false ELSE NOT blocked END AS allowed,
       CASE WHEN breach THEN 'Security threat detected' END AS reason, CASE WHEN NOT breach THEN pii END AS pii_detected,
       CASE WHEN NOT breach THEN round(risk_score, 6) END AS content_risk_score,
       breach::INTEGER + probe::INTEGER AS security_events FROM flagged"""
SECURITY = f"""{CHECKED},
sec AS (
  SELECT request_id, user_id, ts, message, 'rate_limit_exceeded' AS event_type, 'medium' AS severity, true AS blocked FROM flagged WHERE breach
  UNION ALL SELECT request_id, user_id, ts, message, 'suspicious_activity', 'high', false FROM flagged WHERE probe
  UNION ALL SELECT request_id, user_id, ts, message, 'pii_detected', 'medium', false FROM flagged WHERE NOT breach AND pii
  UNION ALL SELECT request_id, user_id, ts, message, 'content_blocked', 'medium', true FROM flagged WHERE NOT breach AND blocked)"""
ORACLE["security_events"] = f"""WITH {SECURITY}
SELECT request_id, user_id, event_type, severity, blocked, substr(message, 1, 100) AS content_preview FROM sec"""
ORACLE["security_stats"] = f"""WITH {SECURITY},
late AS (SELECT event_type, count(*) AS n FROM sec WHERE ts > TIMESTAMP '2024-01-29 23:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1)
SELECT (SELECT count(*) FROM sec)::BIGINT AS total_events, sum(n)::BIGINT AS events_last_hour,
       string_agg(event_type || '=' || n::VARCHAR, ',' ORDER BY event_type) AS event_types FROM late"""
ORACLE["critical_events"] = f"""WITH {SECURITY} SELECT request_id, event_type FROM sec WHERE user_id % 3 = 0"""
ORACLE["entity_order"] = f"""
SELECT doc_id, string_agg(start::VARCHAR, ',' ORDER BY start DESC) AS starts FROM ({ORACLE['pii_detect']}) GROUP BY doc_id"""


def _risk_with(extra: str) -> str:
    return f"""f AS (SELECT doc_id, text, {inj_tenths('text')} AS inj, length(text) > 10000 AS long, {extra},
  {', '.join(f"{sus_flag('text', i)} AS d{i}" for i in range(6))} FROM documents)"""


_DEFAULTS = " + ".join(f"3 * d{i}::INTEGER" for i in range(6))
ORACLE["pattern_union"] = f"""WITH {_risk_with("regexp_matches(text, 'mit license', 'i') AS b0, regexp_matches(text, 'apache license', 'i') AS c0, regexp_matches(text, 'idiot', 'i') AS c1")},
r AS (SELECT *, 3 * long::INTEGER + 5 * b0::INTEGER + 3 * c0::INTEGER + 3 * c1::INTEGER + {_DEFAULTS} + CASE WHEN inj > 5 THEN inj ELSE 0 END AS risk FROM f)
SELECT doc_id, long OR b0 OR inj > 5 OR risk > 7 AS blocked, round(least(risk, 10) / 10.0, 6) AS risk_score,
       array_to_string(list_filter([CASE WHEN long THEN 'Content too long (' || length(text) || ' > 10000)' END,
         CASE WHEN b0 THEN 'Blocked pattern #0 matched' END, CASE WHEN c0 THEN 'Suspicious pattern #0 detected' END,
         CASE WHEN c1 THEN 'Suspicious pattern #1 detected' END,
         {', '.join(f"CASE WHEN d{i} THEN 'Suspicious pattern #{i + 2} detected' END" for i in range(6))},
         CASE WHEN inj > 5 THEN 'Potential injection attack detected' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM r"""
ORACLE["custom_rules"] = f"""WITH {_risk_with("regexp_matches(text, 'licen[cs]e', 'i') AS u0, regexp_matches(text, 'idiot|moron', 'i') AS u1")},
r AS (SELECT *, 3 * long::INTEGER + 2 * u0::INTEGER + 4 * u1::INTEGER + {_DEFAULTS} + CASE WHEN inj > 5 THEN inj ELSE 0 END AS risk FROM f)
SELECT doc_id, long OR u1 OR inj > 5 OR risk > 7 AS blocked, round(least(risk, 10) / 10.0, 6) AS risk_score,
       array_to_string(list_filter([CASE WHEN long THEN 'Content too long (' || length(text) || ' > 10000)' END,
         {', '.join(f"CASE WHEN d{i} THEN 'Suspicious pattern #{i} detected' END" for i in range(6))},
         CASE WHEN inj > 5 THEN 'Potential injection attack detected' END, CASE WHEN u0 THEN 'Custom rule licence matched' END,
         CASE WHEN u1 THEN 'Custom rule insult matched' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM r"""

# ---------------------------------------------------------- more analytics ---
ORACLE["pipeline_counters"] = f"""WITH {RAW},
f AS (SELECT split_part(file_path, '.', -1) AS extension, octet_length(encode(text)) AS n FROM raw)
SELECT extension, extension IN ('pdf', 'docx', 'txt', 'html', 'md', 'json') AS accepted, sum(n)::BIGINT AS bytes FROM f GROUP BY ALL"""
ORACLE["market_rollup"] = """
SELECT ts::DATE::VARCHAR AS day, event_type AS symbol, count(*)::BIGINT AS trades, round(avg(value), 6) AS price FROM events GROUP BY ALL"""
ORACLE["cache_size"] = f"""WITH {OPS}, {ENTRIES} SELECT count(*)::BIGINT AS entries, sum(size_bytes)::BIGINT AS bytes FROM entries"""
ORACLE["provider_totals"] = f"""WITH {USAGE}
SELECT 3::BIGINT AS providers, 3::BIGINT AS enabled_providers, count(*)::BIGINT AS requests,
       count_if(status <> 'success')::BIGINT AS failures FROM usage"""
ORACLE["provider_union_all"] = f"""WITH {USAGE}
SELECT provider, count(*)::BIGINT AS rows FROM (SELECT provider FROM prices UNION ALL SELECT provider FROM usage) GROUP BY provider"""
ORACLE["cosine"] = """
SELECT vec_id, round(list_cosine_similarity(v, list_reverse(v)), 6) AS cosine,
       round((1 + list_cosine_similarity(v, list_reverse(v))) / 2, 6) AS certainty
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"""
ORACLE["l2_normalize"] = """
SELECT vec_id, (i - 1)::INTEGER AS pos, round(((v[i] * 3) / sqrt(list_sum(list_transform(v, lambda x: x * x * 9))))::FLOAT::DOUBLE, 5) AS x
FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, 65)) AS i FROM embeddings)"""
ORACLE["llm_cache_key"] = f"""WITH {USER_TURNS}
SELECT request_id, 'llm:' || md5(to_json({{'max_tokens': max_tokens, 'message': message, 'provider': coalesce(provider, 'any')}})) AS cache_key FROM turns"""
ORACLE["plain_prompt"] = f"""WITH {USER_TURNS}
SELECT request_id, CASE WHEN conv_id % 2 = 0 THEN 'Be brief.' || chr(10) || chr(10) ELSE '' END || 'Human: ' || message || chr(10) || chr(10) || 'Assistant:' AS human,
       CASE WHEN conv_id % 2 = 0 THEN 'System: Be brief.' || chr(10) || chr(10) || 'User: ' || message || chr(10) || chr(10) || 'Assistant:' ELSE message END AS system
FROM turns"""
ORACLE["content_preview"] = "SELECT doc_id, substr(text, 1, 100) AS preview FROM documents"

# -------------------------------------------------------- plug-in queries ---
ORACLE["register_action"] = """
SELECT doc_id, length(text) >= 60 AS success, CASE WHEN length(text) >= 60 THEN substr(text, 1, 60) END AS result,
       CASE WHEN length(text) < 60 THEN 'null result' END AS error FROM documents"""
ORACLE["custom_metrics"] = f"""WITH {HTTP},
b(le, bound) AS (VALUES ('0.05', 0.05), ('0.1', 0.1), ('1.0', 1.0), ('+Inf', 'Infinity'::DOUBLE)),
g AS (SELECT method, count(*)::BIGINT AS count, sum(duration_s) AS sum FROM http GROUP BY ALL)
SELECT g.method, b.le, (SELECT count(*) FROM http h WHERE h.method = g.method AND h.duration_s <= b.bound)::BIGINT AS bucket_count,
       g.count, round(g.sum, 6) AS sum FROM g, b"""
ORACLE["model_hooks"] = """
SELECT item_id, i::INTEGER AS pos, (length(lower(text)) - length(replace(lower(text), substr('aeio', (i + 1)::BIGINT, 1), '')))::DOUBLE AS x
FROM (SELECT item_id, text, unnest(range(4)) AS i FROM benchmark)"""
ORACLE["sql_execute"] = """
SELECT event_id, user_id, count(*) OVER ()::BIGINT AS affected_rows FROM events WHERE event_type = 'error'"""


# sentences as in chunk_sentence; a chunk also ends where the next sentence's
# token buckets have a cosine below 0.2001 with those of the one before it
ORACLE["chunk_semantic_breaks"] = f"""WITH RECURSIVE
{pieces_sql('sp', 'documents', "regexp_split_to_array(text, '[.!?]+')")},
tk AS (SELECT doc_id, i, unnest(list_filter(regexp_split_to_array(lower(piece), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS tok FROM sp),
bk AS (SELECT doc_id, i, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 384 AS dim, count(*) AS c FROM tk GROUP BY ALL),
nm AS (SELECT doc_id, i, sqrt(sum(c * c)) AS norm FROM bk GROUP BY ALL),
dt AS (SELECT b.doc_id, b.i, sum(a.c * b.c) AS dot FROM bk a JOIN bk b ON a.doc_id = b.doc_id AND a.i = b.i - 1 AND a.dim = b.dim GROUP BY ALL),
sm AS (SELECT sp.doc_id, sp.i, sp.piece, coalesce(dot / (x.norm * y.norm), 0.0) < 0.2001 AS far
       FROM sp LEFT JOIN dt USING (doc_id, i) LEFT JOIN nm x ON x.doc_id = sp.doc_id AND x.i = sp.i
       LEFT JOIN nm y ON y.doc_id = sp.doc_id AND y.i = sp.i - 1),
fo(doc_id, i, cur, st, out_c, out_s) AS (
  SELECT doc_id, i, piece, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM sm WHERE i = 1
  UNION ALL
  SELECT f.doc_id, p.i, CASE WHEN p.far OR length(f.cur || ' ' || p.piece) > 512 THEN p.piece ELSE f.cur || ' ' || p.piece END,
         CASE WHEN p.far OR length(f.cur || ' ' || p.piece) > 512 THEN f.st + length(f.cur) ELSE f.st END,
         CASE WHEN p.far OR length(f.cur || ' ' || p.piece) > 512 THEN f.cur END,
         CASE WHEN p.far OR length(f.cur || ' ' || p.piece) > 512 THEN f.st END
  FROM fo f JOIN sm p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
sc AS (SELECT doc_id, i AS ord, out_c AS content, out_s AS start_char, out_s + length(out_c) AS end_char FROM fo WHERE out_c IS NOT NULL
       UNION ALL
       SELECT f.doc_id, f.i + 1, f.cur, f.st, f.st + length(f.cur) FROM fo f
       JOIN (SELECT doc_id, max(i) AS mi FROM sm GROUP BY doc_id) m ON m.doc_id = f.doc_id AND f.i = m.mi)
{chunk_select('sc')}"""

ORACLE["stream_ingest_vectors"] = f"""WITH RECURSIVE
{pieces_sql('pp', 'documents', f"string_split(text, {NL2})")},
{fold_sql('pc', 'pp', NL2)},
pcl AS (SELECT doc_id * 100000 + ord AS doc_id, doc_id AS real_doc, ord AS p_ord, content AS text, start_char AS p_start
        FROM pc WHERE length(content) > 2048),
{pieces_sql('sp', 'pcl', "regexp_split_to_array(text, '[.!?]+')")},
{fold_sql('sc', 'sp', "' '")},
hy AS (SELECT doc_id, ord * 100000 AS ord, content, start_char, end_char FROM pc WHERE length(content) <= 2048
       UNION ALL
       SELECT l.real_doc, l.p_ord * 100000 + s.ord, s.content, s.start_char + l.p_start, s.end_char + l.p_start
       FROM sc s JOIN pcl l ON l.doc_id = s.doc_id),
ck AS ({chunk_select('hy')}),
tk AS (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS tok FROM ck)
SELECT ck.chunk_id, doc_id, chunk_index, content,
       (SELECT count(DISTINCT ('0x' || substr(md5(tok), 1, 8))::BIGINT % 384) FROM tk WHERE tk.chunk_id = ck.chunk_id)::INTEGER AS dims
FROM ck"""

ORACLE["hooked_rerank"] = f"""WITH {CORPUS}, {knn_sql(5)},
rr AS (SELECT query_id, chunk_id, rank AS old_rank, similarity_score * (1.0::DOUBLE / (1 + length(content))) AS s FROM hits)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, old_rank) AS rank, round(s, 9) AS similarity_score FROM rr"""

ORACLE["hooked_pii"] = """
WITH p AS (SELECT doc_id, regexp_extract_all(text, '\\([0-9]+\\)') AS ms, regexp_split_to_array(text, '\\([0-9]+\\)') AS pieces FROM documents),
u AS (SELECT doc_id, ms, pieces, unnest(ms) AS text, generate_subscripts(ms, 1) AS i FROM p)
SELECT doc_id, (list_sum(list_transform(pieces[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::INTEGER AS start, text FROM u"""

# ------------------------------------------------ check digits, counters ---
_TURNED = "list_transform(string_split(substr(t, 5) || substr(t, 1, 4), ''), lambda c: ascii(c))"
LUHN = ("list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[i] "
        "ELSE d[i] * 2 - CASE WHEN d[i] > 4 THEN 9 ELSE 0 END END)) % 10 = 0")
MOD97 = (f"list_reduce(list_prepend(0, {_TURNED}), lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 "
         "ELSE (a * 10 + c - 48) % 97 END) = 1")
CHECKED = f"""found AS (SELECT *, text AS t, list_transform(list_reverse(string_split(regexp_replace(text, '[^0-9]', '', 'g'), '')),
                  lambda x: try_cast(x AS INTEGER)) AS d FROM ({ORACLE['pii_detect']})),
checked AS (SELECT doc_id, entity_type, start, "end", score, text,
  CASE WHEN entity_type = 'CREDIT_CARD' THEN {LUHN} WHEN entity_type = 'IBAN_CODE' THEN {MOD97} ELSE true END AS valid FROM found)"""
ORACLE["pii_checked"] = f"""WITH {CHECKED} SELECT doc_id, entity_type, start, "end", score, text FROM checked WHERE valid"""
ORACLE["check_digits"] = f"""WITH {CHECKED}
SELECT doc_id, entity_type, start, text, valid FROM checked WHERE entity_type IN ('CREDIT_CARD', 'IBAN_CODE')"""
ORACLE["identifier_stats"] = f"""
SELECT count(*)::BIGINT AS failed_attempts, count_if(n > 5)::BIGINT AS suspicious_ips
FROM (SELECT identifier, count(*) AS n FROM {FAILS} GROUP BY identifier)"""
ORACLE["operation_counters"] = f"""
SELECT 'chunks' AS component, 'sliding_window' AS label, count(*)::BIGINT AS value FROM ({ORACLE['chunk_sliding']})
UNION ALL SELECT 'chunks', 'sentence', count(*) FROM ({ORACLE['chunk_sentence']})
UNION ALL SELECT 'chunks', 'paragraph', count(*) FROM ({ORACLE['chunk_paragraph']})
UNION ALL SELECT 'vector_ops', CASE WHEN vec_id % 50 = 0 THEN 'search' ELSE 'insert' END, count(*) FROM embeddings GROUP BY 2
UNION ALL SELECT 'plugin_runs', CASE WHEN length(text) >= 60 THEN 'success' ELSE 'error' END, count(*) FROM documents GROUP BY 2"""
ORACLE["sql_query_capped"] = """
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS l_extendedprice,
       (SELECT count(*) > 100 FROM lineitem) AS truncated
FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100"""


# ------------------------------------------------------ Markdown, JSON ---
# What the extraction strips, in order, outside of code fences.
MARKDOWN = [
    ("\r\n?", "\n"), ("\x01", " "), (r"(?m)^ {0,3}[-*_][ \t]*[-*_][ \t]*[-*_][-*_ \t]*$", ""), (r"(?m)^[ \t]{0,3}>[> \t]*", ""),
    (r"(?m)^ {0,3}#{1,6}[ \t]+([^\n]*)$", "\n\n\\1\n\n"), (r"(?m)^[ \t]*(?:[-*+]|[0-9]{1,9}[.)])[ \t]+", "\n\n"),
    (r"!?\[([^\]\n]*)\]\([^)\n]*\)", "\\1"), (r"\*\*([^*\n]+)\*\*", "\\1"), (r"__([^_\n]+)__", "\\1"),
    (r"\*([^* \t\n][^*\n]*)\*", "\\1"), (r"`([^`\n]+)`", "\\1"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n\n+", "\x01"),
    (r"\n", " "), ("\x01", "\n"), (r"^[ \n]+|[ \n]+$", "")]


def markdown_sql(x: str) -> str:
    for p, to in MARKDOWN:
        x = f"regexp_replace({x}, {lit(p)}, {lit(to)}, 'g')"
    return x


ORACLE["markdown_to_text"] = f"""
SELECT doc_id, array_to_string(list_filter([{markdown_sql('a')}, '# x  y' || chr(10) || chr(10) || 'z = ' || doc_id::VARCHAR,
                                            {markdown_sql('b')}], lambda p: p <> ''), chr(10)) AS text
FROM (SELECT doc_id, '# Document ' || doc_id::VARCHAR || chr(10) || chr(10) || '> ' || text || chr(10) || chr(10) || '---' || chr(10)
             || '* **bold** item' || chr(10) || '2. see [page ' || doc_id::VARCHAR || '](http://h/' || doc_id::VARCHAR || ')' || chr(10) AS a,
             chr(10) || 'last *line*' || chr(10) AS b FROM documents)"""
ORACLE["json_to_text"] = """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '{not json' ELSE concat_ws(chr(10), lang, text, n_chars::VARCHAR, source, lang,
                                                                        'doc-' || doc_id::VARCHAR) END AS text
FROM documents"""
