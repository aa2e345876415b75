"""Text-safety column functions: PII recognisers (F14), masking (F15),
anonymising (F16), content risk (F17), injection score (F18), suspicious
patterns (F19), short probes (F20), hashing of sensitive data (F23).

All are JVM-side column expressions (regex, contains, HOFs), evaluated per
row inside whole-stage-codegen'd projections where Spark allows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# PII recognisers of this library (type, pattern, score), in
# masking order. Scores are ours; findings below the threshold (0.8) are
# dropped except for anonymize_all. No group is repeated without a bound (the
# JVM matches those by recursion): a host name has at most 127 labels (RFC
# 1035), and a mailbox name is a whole run of its characters, so a run is
# read once.
PII_RECOGNIZERS = [
    ("EMAIL_ADDRESS", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}", 1.0),
    ("URL", r"https?://[^ \t\n\r\"'<>]+", 0.85),
    ("IBAN_CODE", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", 1.0),
    ("CREDIT_CARD", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", 1.0),
    ("US_SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.85),
    ("PHONE_NUMBER", r"(\+1[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}-[0-9]{4}", 0.9),
    ("IP_ADDRESS", r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])", 0.95),
    ("US_PASSPORT", r"[A-Z][0-9]{8}", 0.4),
]
PII_THRESHOLD = 0.8

# Mask text per entity type (others use "[TYPE]").
MASKS = {"EMAIL_ADDRESS": "[EMAIL]", "PHONE_NUMBER": "[PHONE]",
         "PERSON": "[PERSON]", "LOCATION": "[LOCATION]"}

# Default suspicious patterns (case-insensitive), in order.
SUSPICIOUS_PATTERNS = [
    r"<script[^>]*>",
    r"javascript:",
    r"eval\s*\(",
    r"union\s+select",
    r"drop\s+table",
    r"['\"];\s*(drop|delete|insert|update)",
]

# Injection indicators, 0.2 each, compared lower-cased.
INJECTION_INDICATORS = [
    "' OR '1'='1",
    "'; DROP TABLE",
    "<script>alert(",
    "javascript:void(0)",
    "onload=",
    "onerror=",
    "../../../etc/passwd",
    "{{7*7}}",
    "${jndi:ldap://",
]

MAX_INPUT_LENGTH = 10000

FINDING = T.StructType([
    T.StructField("entity_type", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("text", T.StringType()),
])


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _recognizers(threshold: float | None):
    return [r for r in PII_RECOGNIZERS if threshold is None or r[2] >= threshold]


# ------------------------------------------------------------------ F14 ---
# A finding is not part of a longer run of letters and digits: the recogniser
# is preceded and followed by an end of the text or another character (Java
# look-around; has_pii and the masks use the same findings).
def bounded(pattern: str) -> str:
    return r"(?<![0-9A-Za-z])(?:" + pattern + r")(?![0-9A-Za-z])"


def findings_of(text: Column | str, entity: str, pattern: str, score: float) -> Column:
    """All matches of one recogniser with their character offsets.

    One fold over the matches and the text between them carries the offset:
    a match starts after everything before it."""
    text = _c(text)
    matches = F.regexp_extract_all(text, F.lit(bounded(pattern)), 0)
    pieces = F.split(text, bounded(pattern), -1)
    pairs = F.filter(F.arrays_zip(pieces.alias("p"), matches.alias("m")), lambda x: x["m"].isNotNull())
    empty = F.array().cast(T.ArrayType(FINDING))

    def step(s, x):
        start = s["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        one = F.struct(F.lit(entity).alias("entity_type"), start.alias("start"), end.alias("end"),
                       F.lit(float(score)).alias("score"), x["m"].alias("text"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step,
                       lambda s: s["out"])


def luhn_ok(number: Column) -> Column:
    """Whether the digits of a card number (other characters are skipped) add
    up to a multiple of ten by Luhn's rule."""
    digits = F.reverse(F.filter(F.split(F.regexp_replace(number, "[^0-9]", ""), ""), lambda d: d != ""))
    parts = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return (F.size(digits) > 0) & (F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0)


def mod97_ok(iban: Column) -> Column:
    """Whether an IBAN, its first four characters put last and its letters read
    as 10 to 35, leaves 1 when divided by 97."""
    turned = F.filter(F.split(F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4)), ""), lambda c: c != "")

    def step(a, c):
        letter = F.ascii(c) >= 65
        return (a * F.when(letter, 100).otherwise(10) + F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)) % 97
    return F.aggregate(turned, F.lit(0), step) == 1


def check_digits_ok(f: Column) -> Column:
    """Whether a finding's check digits hold (true for types without any)."""
    return (F.when(f["entity_type"] == "CREDIT_CARD", luhn_ok(f["text"]))
            .when(f["entity_type"] == "IBAN_CODE", mod97_ok(f["text"])).otherwise(F.lit(True)))


def pii_findings(text: Column | str, threshold: float | None = PII_THRESHOLD, model=None,
                 check_digits: bool = False) -> Column:
    """F14 + PF13: array<FINDING> of every recogniser (score >= threshold);
    blank text -> empty array. ``model`` (a U3 hook from text to
    array<FINDING>) replaces the recognisers; the threshold still holds. With
    ``check_digits`` a card number or IBAN whose check digits are wrong is no
    finding."""
    if check_digits:
        return F.filter(pii_findings(text, threshold, model), check_digits_ok)
    text = _c(text)
    if model is not None:
        found = F.coalesce(model(text), F.array().cast(T.ArrayType(FINDING)))
        return found if threshold is None else F.filter(found, lambda f: f["score"] >= threshold)
    none = F.array().cast(T.ArrayType(FINDING))
    # offsets are worked out only where the recogniser matches at all
    parts = [F.when(text.rlike(bounded(p)), findings_of(text, e, p, s)).otherwise(none)
             for e, p, s in _recognizers(threshold)]
    allf = F.concat(*parts) if len(parts) > 1 else parts[0]
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", none).otherwise(allf)


def has_pii(text: Column | str, threshold: float | None = PII_THRESHOLD) -> Column:
    """Yes/no PII test with plain ``rlike`` (no offsets needed)."""
    text = _c(text)
    cond = F.lit(False)
    for _, p, _s in _recognizers(threshold):
        cond = cond | text.rlike(bounded(p))
    return cond & (F.trim(text) != "")


def entity_order_desc(findings: Column) -> Column:
    """Findings sorted by start, descending (masking order)."""
    return F.array_sort(findings, lambda a, b: (b["start"] - a["start"]).cast("int"))


# ------------------------------------------------------------ F15, F16 ---
def disjoint(findings: Column) -> Column:
    """Findings without overlaps, in text order. Of findings that overlap the
    one that starts first stays; at equal starts the longer, then the one of
    the higher score, then the smaller type name."""
    ordered = F.array_sort(F.transform(findings, lambda f: F.struct(
        f["start"].alias("start"), (-f["end"]).alias("last"), (-f["score"]).alias("worse"),
        f["entity_type"].alias("entity_type"))))
    kind = "array<struct<entity_type:string,start:int,end:int>>"

    def step(s, f):
        one = F.struct(f["entity_type"].alias("entity_type"), f["start"].alias("start"),
                       (-f["last"]).alias("end"))
        return F.when(f["start"] >= s["at"], F.struct(
            (-f["last"]).alias("at"), F.concat(s["out"], F.array(one)).alias("out"))).otherwise(s)
    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step,
                       lambda s: s["out"])


def replace_findings(text: Column, findings: Column, mask) -> Column:
    """Every disjoint finding replaced by ``mask(entity_type)``, from the
    right, so earlier positions stay valid."""
    return F.aggregate(entity_order_desc(disjoint(findings)), text, lambda t, f: F.concat(
        F.substr(t, F.lit(1), f["start"]), mask(f["entity_type"]),
        F.substr(t, f["end"] + 1, F.length(t))))


def pii_mask(text: Column | str, threshold: float | None = PII_THRESHOLD) -> Column:
    """every finding replaced by its mask ([EMAIL], [PHONE], ... else
    [TYPE]); overlapping findings are resolved first (``disjoint``)."""
    def mask(e):
        out = F.concat(F.lit("["), e, F.lit("]"))
        for name, m in MASKS.items():
            out = F.when(e == name, m).otherwise(out)
        return out
    return replace_findings(_c(text), pii_findings(text, threshold), mask)


def pii_anonymize(text: Column | str, anonymize_all: bool = True,
                  threshold: float = PII_THRESHOLD) -> Column:
    """F16: findings replaced by ``<TYPE>``. With ``anonymize_all`` (the
    reference behaviour) findings under the threshold are replaced too."""
    return replace_findings(_c(text), pii_findings(text, None if anonymize_all else threshold),
                            lambda e: F.concat(F.lit("<"), e, F.lit(">")))


# ------------------------------------------------------------ F18-F20 ---
def injection_score(text: Column | str) -> Column:
    """0.2 per indicator found (lower-cased), capped at 1.0."""
    return _injection_tenths(_c(text)) / 10.0


def _injection_tenths(text: Column) -> Column:
    found = F.get(F.transform(F.array(F.lower(text)), lambda low: sum(
        F.when(low.contains(i.lower()), 1).otherwise(0) for i in INJECTION_INDICATORS)), F.lit(0))
    return F.least(found * 2, F.lit(10))


def suspicious_flags(text: Column | str, extra: list[str] | None = None) -> list[Column]:
    """one boolean per suspicious pattern (configured first, then the
    six defaults -- S3), case-insensitive."""
    text = _c(text)
    return [text.rlike("(?i)" + p) for p in [*(extra or []), *SUSPICIOUS_PATTERNS]]


def short_probe(text: Column | str) -> Column:
    """shorter than 10 characters and no space."""
    text = _c(text)
    return (F.length(text) < 10) & ~text.contains(" ")


def input_length_ok(text: Column | str, max_len: int = MAX_INPUT_LENGTH) -> Column:
    """PF5."""
    return F.length(_c(text)) <= max_len


# ------------------------------------------------------------------ F17 ---
def content_risk(text: Column | str, blocked_patterns: list[str] | None = None,
                 suspicious: list[str] | None = None, max_len: int = MAX_INPUT_LENGTH,
                 custom_rules: list[tuple[str, Column, int, bool]] | None = None) -> Column:
    """F17 content filter -> struct(blocked, risk_score, reasons, filtered_content).

    Scores are summed in tenths as integers: too long +3 (blocks), each
    blocked pattern +5 (blocks), each suspicious pattern +3, injection > 5
    tenths adds itself (blocks), total > 7 blocks; capped at 10.
    ``custom_rules`` (U6) are (name, condition, weight in tenths, blocks).
    """
    text = _c(text)
    rules = custom_rules or []
    n_blocked = len(blocked_patterns or [])
    patterns = [*(blocked_patterns or []), *(suspicious or []), *SUSPICIOUS_PATTERNS]
    # everything that reads the text, once per row; the lambda below binds the
    # values, so no pattern is evaluated again for a second output
    seen = F.struct(F.length(text).alias("n"), _injection_tenths(text).alias("inj"),
                    F.array(*[text.rlike("(?i)" + p) for p in patterns]).alias("hit"),
                    F.array(*[cond for _, cond, _w, _b in rules]).cast("array<boolean>").alias("own"),
                    text.alias("text"))

    def judge(s):
        too_long, inj = s["n"] > max_len, s["inj"] > 5
        weights = [5] * n_blocked + [3] * (len(patterns) - n_blocked)
        risk = F.when(too_long, 3).otherwise(0) + F.when(inj, s["inj"]).otherwise(0)
        hard = too_long | inj
        reasons = [F.when(too_long, F.format_string(f"Content too long (%d > {max_len})", s["n"]))]
        for i, w in enumerate(weights):
            hit = F.get(s["hit"], F.lit(i))
            risk = risk + F.when(hit, w).otherwise(0)
            if i < n_blocked:
                hard = hard | hit
                reasons.append(F.when(hit, F.lit(f"Blocked pattern #{i} matched")))
            else:
                reasons.append(F.when(hit, F.lit(f"Suspicious pattern #{i - n_blocked} detected")))
        reasons.append(F.when(inj, F.lit("Potential injection attack detected")))
        for i, (name, _c1, w, blocks) in enumerate(rules):
            hit = F.get(s["own"], F.lit(i))
            risk = risk + F.when(hit, w).otherwise(0)
            hard = (hard | hit) if blocks else hard
            reasons.append(F.when(hit, F.lit(f"Custom rule {name} matched")))
        return F.struct(s["text"].alias("text"), hard.alias("hard"), risk.alias("risk"),
                        F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"))

    def result(s):
        blocked = s["hard"] | (s["risk"] > 7)
        return F.struct(blocked.alias("blocked"), (F.least(s["risk"], F.lit(10)) / 10.0).alias("risk_score"),
                        s["reasons"].alias("reasons"),
                        F.when(blocked, F.lit(None).cast("string")).otherwise(s["text"]).alias("filtered_content"))
    return F.get(F.transform(F.transform(F.array(seen), judge), result), F.lit(0))


# ------------------------------------------------------------------ F23 ---
def hash_sensitive(data: Column | str, salt: str) -> Column:
    """sha256 hex of salt + data; the salt is the caller's."""
    return F.sha2(F.concat(F.lit(salt), _c(data)), 256)
