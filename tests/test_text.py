"""Chunking and safety edge rows (FIXTURES.md section 4), hand-worked."""

from pyspark.sql import functions as F

from sluice.functions import safety as sf
from sluice.operators import chunking as ch


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


EDGE_TEXTS = [
    "", "x" * 49, "x" * 50, "y" * 511, "z" * 512, "w" * 513, "a" * 974,
    ("word " * 200).strip(), " leading space " + "b " * 300, "tail " * 102 + " " * 3,
    "nospace" * 100, "One. Two! Three? " * 60, "..!!??", "s" * 600 + ". short.",
]


def _chunks(spark, texts, strategy, **kw):
    out = {i: [] for i in range(len(texts))}
    for r in ch.chunk(_docs(spark, texts), strategy, **kw).collect():
        out[r.doc_id].append((r.chunk_index, r.content, r.start_char, r.end_char))
    return {i: sorted(v) for i, v in out.items()}


def test_fixed_size_hand_worked(spark):
    # size 10, overlap 3, at least 4 characters
    texts = ["", "abcde", "abcdefghij", "abcd efgh ijkl mnop qrstu", "abcdefghijklmnop", "   x   ", None]
    got = _chunks(spark, texts, "fixed_size", size=10, overlap=3, min_size=4)
    assert got[0] == got[5] == got[6] == []
    assert got[1] == [(0, "abcde", 0, 5)]
    assert got[2] == [(0, "abcdefghij", 0, 10)]
    # cut at the last blank before the limit, then 3 characters back
    assert got[3] == [(0, "abcd efgh", 0, 9), (1, "fgh ijkl", 6, 14), (2, "jkl mnop", 11, 19),
                      (3, "nop qrstu", 16, 25)]
    # no blank: cut at the limit
    assert got[4] == [(0, "abcdefghij", 0, 10), (1, "hijklmnop", 7, 16)]


def test_fixed_size_default_lengths(spark):
    got = _chunks(spark, EDGE_TEXTS, "fixed_size")
    spans = {i: [(s, e) for _, _, s, e in v] for i, v in got.items()}
    assert spans[0] == spans[1] == []                   # empty, 49 characters
    assert spans[2] == [(0, 50)]                        # exactly the minimum
    assert spans[3] == [(0, 511)] or spans[3] == [(0, 511), (461, 511)]
    assert spans[5][0] == (0, 512) and spans[5][1][0] == 462


def test_sliding_hand_worked(spark):
    got = _chunks(spark, ["x" * 49, "x" * 50, "y" * 512, "w" * 513, "a" * 974, "b" * 975], "sliding_window")
    spans = {i: [(s, e) for _, _, s, e in v] for i, v in got.items()}
    assert spans[0] == []
    assert spans[1] == [(0, 50)]
    assert spans[2] == [(0, 512)]
    assert spans[3] == [(0, 512), (462, 513)]
    assert spans[4] == [(0, 512), (462, 974)]
    assert spans[5] == [(0, 512), (462, 974), (924, 975)]


def test_sentence_and_paragraph_hand_worked(spark):
    kw = {"size": 10}
    got = _chunks(spark, ["One. Two! Three? Four", "..!!??", "longer than ten. no", ""], "sentence", **kw)
    assert got[0] == [(0, "One Two", 0, 7), (1, "Three Four", 7, 17)]
    assert got[1] == got[3] == []
    assert got[2] == [(0, "longer than ten", 0, 15), (1, "no", 15, 17)]
    got = _chunks(spark, ["ab\n\ncd\n\n\n\nefghij\n\nk"], "paragraph", **kw)
    assert got[0] == [(0, "ab\n\ncd", 0, 6), (1, "efghij\n\nk", 6, 15)]


def test_exactly_512_after_join(spark):
    t = "a" * 255 + ". " + "b" * 256          # 255 + 1 + 256 = 512 -> one chunk
    rows = ch.chunk(_docs(spark, [t]), "sentence").collect()
    assert len(rows) == 1 and len(rows[0].content) == 512


def test_overlap_must_be_below_size(spark):
    import pytest
    with pytest.raises(ValueError):
        ch.chunk(_docs(spark, ["x"]), "sliding_window", size=100, overlap=100)


def _risk(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r.cr for r in df.select(sf.content_risk("t").alias("cr")).collect()]


def test_content_risk_levels(spark):
    r = _risk(spark, ["hello", "<script>x", "<script> javascript:", "<script> javascript: eval(",
                      "<script> javascript: eval( union select drop table"])
    assert [x.risk_score for x in r] == [0.0, 0.3, 0.6, 0.9, 1.0]
    assert [x.blocked for x in r] == [False, False, False, True, True]
    assert r[0].filtered_content == "hello" and r[3].filtered_content is None
    assert r[1].reasons == ["Suspicious pattern #0 detected"]


def test_content_length_edges(spark):
    r = _risk(spark, ["a" * 10000, "a" * 10001])
    assert not r[0].blocked and r[1].blocked
    assert r[1].reasons == ["Content too long (10001 > 10000)"]


def test_injection_two_and_three(spark):
    two = "onload= onerror="
    three = two + " {{7*7}}"
    r = _risk(spark, [two, three])
    assert not r[0].blocked and r[1].blocked
    assert "Potential injection attack detected" in r[1].reasons


def test_pii_findings_and_mask(spark):
    t = "mail a.b@x.example.com or call +1 (555) 555-1234, ssn 123-45-6789"
    df = spark.createDataFrame([(1, t), (2, "   ")], "id long, t string")
    f = df.select("id", F.explode(sf.pii_findings("t")).alias("f")).select("id", "f.*").collect()
    found = {(r.entity_type, t[r.start:r.end]) for r in f}
    assert ("EMAIL_ADDRESS", "a.b@x.example.com") in found
    assert ("PHONE_NUMBER", "+1 (555) 555-1234") in found
    assert ("US_SSN", "123-45-6789") in found
    assert all(r.id == 1 for r in f)
    m = df.select(sf.pii_mask("t").alias("m")).collect()[0].m
    assert m == "mail [EMAIL] or call [PHONE], ssn [US_SSN]"


def test_short_probe(spark):
    df = spark.createDataFrame([("abc",), ("a b",), ("abcdefghij",)], "t string")
    assert [r.p for r in df.select(sf.short_probe("t").alias("p")).collect()] == [True, False, False]


def test_overlapping_and_bounded_findings(spark):
    texts = ["see http://10.0.0.1/a now", "v 1.2.3.4444 and 300.1.2.3", "id 12345678901234567890",
             "a@b.example.com,c@d.example.com", "10.0.0.1", "4111 1111 1111 1111 10.0.0.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    m = {r.i: r.m for r in df.select("i", sf.pii_mask("t").alias("m")).collect()}
    assert m[0] == "see [URL] now"
    assert m[1] == texts[1] and m[2] == texts[2]
    assert m[3] == "[EMAIL],[EMAIL]"
    assert m[4] == "[IP_ADDRESS]" and m[5] == "[CREDIT_CARD] [IP_ADDRESS]"
    f = df.select("i", F.explode(sf.pii_findings("t")).alias("f")).select("i", "f.*").collect()
    assert all(texts[r.i][r.start:r.end] == r.text for r in f)
    # Positions from the right
    order = df.filter("i = 3").select(sf.entity_order_desc(sf.pii_findings("t")).alias("x")).first().x
    assert [x.start for x in order] == sorted((x.start for x in order), reverse=True)


def test_risk_reads_each_pattern_once(spark):
    df = spark.createDataFrame([("x",)], "t string").withColumn("cr", sf.content_risk("t"))
    out = df.select("cr.blocked", "cr.risk_score", "cr.reasons", "cr.filtered_content")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == len(sf.SUSPICIOUS_PATTERNS)
    assert plan.count("lower(") == 1


def test_email_hosts_of_any_length(spark):
    """Long hosts and long runs of mailbox characters neither overflow a stack
    nor are read again and again."""
    long = "x@" + "a." * 6000 + "com"
    runs = ["-", ".", "%", "a", "a.", "@", "a@", "@a.", "a@b.", "_@-."]
    texts = [long, "x@" + "a." * 100 + "com", "Mail bob@mail.example.co.uk.", "a@b.com-x", "a@b.com.x1", "a@b..com",
             "x@" + "a" * 1_000_000 + ".com", *(r * (1_000_000 // len(r)) + " bob@example.com" for r in runs)]
    df = _docs(spark, texts).select("doc_id", sf.pii_findings("text").alias("f"), sf.pii_anonymize("text").alias("t"))
    got = {r.doc_id: r for r in df.collect()}
    mails = {i: [f.text for f in got[i].f if f.entity_type == "EMAIL_ADDRESS"] for i in got}
    assert mails[1] == ["x@" + "a." * 100 + "com"] and mails[2] == ["bob@mail.example.co.uk"]
    assert mails[3] == ["a@b.com"] and mails[4] == ["a@b.com"] and mails[5] == []
    assert mails[0] == [] and mails[6] == ["x@" + "a" * 1_000_000 + ".com"]      # a host has at most 127 labels
    assert all(mails[7 + i][-1] == "bob@example.com" for i in range(len(runs)))
    assert got[2].t == "Mail <EMAIL_ADDRESS>."
