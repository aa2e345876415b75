"""Request validation and header functions: PF2-PF4 validators (reasons
arrays), PF6 request size, PF7 client ip, PF8 API key, PF9 key prefix,
PF10 suspicious user agent, PF16 domain allow-list, PF17 https rule,
F27-F29 prompts, F30 content preview."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Request bounds of the API models.
CHAT_MAX_CHARS = 8192
MAX_TOKENS = 4096
PROVIDERS = ["openai", "anthropic", "ollama"]
MAX_REQUEST_BYTES = 10 * 1024 * 1024
BOT_MARKERS = ["bot", "crawler", "spider", "scraper"]
DEFAULT_RAG_SYSTEM = ("You are a helpful assistant. Use the provided context to answer the "
                      "question. If the context doesn't contain relevant information, say so.")


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _reasons(*pairs) -> Column:
    return F.filter(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in pairs]),
                    lambda r: r.isNotNull())


def validate_chat(message, temperature, max_tokens, provider) -> Column:
    """PF2: reasons of an invalid chat request (empty array = valid).
    Defaults (temperature 0.7, max_tokens 1024) apply to nulls."""
    m = F.trim(_c(message))
    t = F.coalesce(_c(temperature), F.lit(0.7))
    k = F.coalesce(_c(max_tokens), F.lit(1024))
    p = _c(provider)
    return _reasons(
        (m.isNull() | (F.length(m) < 1), "message is empty"),
        (F.length(m) > CHAT_MAX_CHARS, f"message longer than {CHAT_MAX_CHARS}"),
        ((t < 0) | (t > 2), "temperature outside 0..2"),
        ((k < 1) | (k > MAX_TOKENS), f"max_tokens outside 1..{MAX_TOKENS}"),
        (p.isNotNull() & ~p.isin(PROVIDERS), "unknown provider"))


def validate_search(query, limit, offset, threshold) -> Column:
    """PF3: query 1..1024 chars; limit 1..50; offset >= 0; threshold 0..1."""
    q, lm, off, th = _c(query), _c(limit), _c(offset), _c(threshold)
    return _reasons(
        ((F.length(q) < 1) | (F.length(q) > 1024), "query length outside 1..1024"),
        ((lm < 1) | (lm > 50), "limit outside 1..50"),
        (off < 0, "offset below 0"),
        ((th < 0) | (th > 1), "threshold outside 0..1"))


def validate_ingest(chunk_size, overlap) -> Column:
    """PF4: chunk_size 100..2048; overlap 0..500; overlap < chunk_size."""
    s, o = _c(chunk_size), _c(overlap)
    return _reasons(
        ((s < 100) | (s > 2048), "chunk_size outside 100..2048"),
        ((o < 0) | (o > 500), "chunk_overlap outside 0..500"),
        (o >= s, "chunk_overlap not below chunk_size"))


def request_size_ok(content_length, max_bytes: int = MAX_REQUEST_BYTES) -> Column:
    """PF6: content_length above the limit is rejected (unknown passes)."""
    return F.coalesce(_c(content_length) <= max_bytes, F.lit(True))


def client_ip(forwarded_for, real_ip, peer) -> Column:
    """PF7: first X-Forwarded-For entry (trimmed), X-Real-IP, peer, 'unknown'."""
    first = F.nullif(F.trim(F.split_part(_c(forwarded_for), F.lit(","), F.lit(1))), F.lit(""))
    return F.coalesce(first, F.nullif(_c(real_ip), F.lit("")), _c(peer), F.lit("unknown"))


def api_key_norm(x_api_key, authorization) -> Column:
    """PF8: X-API-Key, else Authorization, else 'anonymous'; 'Bearer ' removed."""
    k = F.coalesce(F.nullif(_c(x_api_key), F.lit("")), F.nullif(_c(authorization), F.lit("")),
                   F.lit("anonymous"))
    return F.when(k.startswith("Bearer "), F.substring(k, 8, 1 << 30)).otherwise(k)


def key_prefix(key) -> Column:
    """PF9: first 8 characters + '...' when longer than 8."""
    k = _c(key)
    return F.when(F.length(k) > 8, F.concat(F.substring(k, 1, 8), F.lit("..."))).otherwise(k)


def suspicious_ua(user_agent) -> Column:
    """PF10: lower(user agent) mentions a bot marker (flag only)."""
    return F.lower(F.coalesce(_c(user_agent), F.lit(""))).rlike("|".join(BOT_MARKERS))


def require_https(scheme, debug: bool = False, required: bool = True) -> Column:
    """PF17: rejected when not debug, https required and scheme is not https."""
    if debug or not required:
        return F.lit(True)
    return _c(scheme) == "https"


def url_host(url) -> Column:
    return F.parse_url(_c(url), F.lit("HOST"))


def domain_allowed(url, allowed: list[str]) -> Column:
    """PF16: host of the URL in the allow-list."""
    return url_host(url).isin(allowed)


def rag_prompt(query, context, system_prompt=None) -> Column:
    """system (or the default sentence), Context, Question, Answer:."""
    sys_ = F.coalesce(_c(system_prompt), F.lit(DEFAULT_RAG_SYSTEM)) if system_prompt is not None \
        else F.lit(DEFAULT_RAG_SYSTEM)
    return F.concat(sys_, F.lit("\n\nContext:\n"), _c(context), F.lit("\n\nQuestion: "),
                    _c(query), F.lit("\n\nAnswer:"))


def plain_prompt(message, system_prompt=None, style: str = "human") -> Column:
    """'Human: ..\\n\\nAssistant:' or 'System: ..\\n\\nUser: ..\\n\\nAssistant:'."""
    m = _c(message)
    s = _c(system_prompt) if system_prompt is not None else F.lit(None).cast("string")
    if style == "human":
        with_sys = F.concat(s, F.lit("\n\nHuman: "), m, F.lit("\n\nAssistant:"))
        without = F.concat(F.lit("Human: "), m, F.lit("\n\nAssistant:"))
    else:
        with_sys = F.concat(F.lit("System: "), s, F.lit("\n\nUser: "), m, F.lit("\n\nAssistant:"))
        without = m
    return F.when(s.isNotNull() & (s != ""), with_sys).otherwise(without)


def content_preview(text, n: int = 100) -> Column:
    """first n characters."""
    return F.substring(_c(text), 1, n)
