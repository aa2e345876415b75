"""Sources, sinks, plug-ins and session rules."""

import pytest
from pyspark.sql import functions as F

from sluice.functions import plugins as pl
from sluice.functions import vectors as vec
from sluice.operators import chunking as ch
from sluice.sources import files as fl
from sluice.sources import sinks as sk


def test_read_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.md").write_bytes(b"hi")
    (tmp_path / "two.pdf").write_bytes(b"\xff\xfex")
    got = {r.title: r for r in fl.read_files(spark, str(tmp_path)).collect()}
    assert got["one"].document_type == "markdown" and got["one"].file_size == 2
    assert got["two"].document_type == "pdf"
    text = fl.read_files(spark, str(tmp_path), "*.pdf").select(fl.decode_text(F.col("content")).alias("t"))
    assert [r.t for r in text.collect()] == ["x"]


def test_corrupt_log_line(spark):
    lines = spark.createDataFrame([('{"request_id": 1, "user_agent": "x"}',), ("not json",)], "value string")
    got = fl.parse_request_log(lines).collect()
    assert [(r.request_id, r.user_agent, r._corrupt_record) for r in got] == [(1, "x", None), (None, None, "not json")]


def test_upsert_keeps_one_row_per_id(spark):
    have = spark.createDataFrame([("a", "old", 0), ("b", "keep", 0)], "chunk_id string, content string, v int")
    new = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("c", "z", 1), ("c", "z", 1)], have.schema)
    got = sorted((r.chunk_id, r.content) for r in sk.upsert_chunks(have, new, version_col="v").collect())
    assert got == [("a", "y"), ("b", "keep"), ("c", "z")]


def test_sql_guard(spark):
    for bad in ("DROP TABLE t", "WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT * FROM x",
                "CREATE TABLE t AS SELECT 1", "SET a = 1", "INSERT INTO t VALUES (1)"):
        with pytest.raises(ValueError):
            pl.sql_query(spark, bad)
    assert pl.sql_query(spark, "SELECT 'drop table x' AS insert_into, 1 AS `update`").count() == 1
    assert pl.sql_query(spark, "WITH x AS (SELECT id FROM range(3000)) SELECT * FROM x").count() == 3000
    cut = pl.sql_query(spark, "SELECT id FROM range(10)", max_rows=4).collect()
    assert len(cut) == 4 and all(r.truncated for r in cut)
    assert not pl.sql_query(spark, "SELECT id FROM range(3)", max_rows=4).first().truncated


def test_actions(spark):
    reg = pl.PluginRegistry()
    reg.register_action("t", "up", lambda c: F.upper(c), "upper case", c="x")
    assert reg.actions("t") == [{"name": "up", "doc": "upper case", "params": {"c": "x"}}]
    df = spark.createDataFrame([("a",), (None,)], "x string")
    got = [tuple(r.result)[:3] for r in reg.execute(df, "t", "up").collect()]
    assert got == [(True, "A", None), (False, None, "null result")]
    with pytest.raises(KeyError):
        reg.execute(df, "t", "none")


def test_semantic_breaks(spark):
    text = "red apple tree. green apple tree. stock market fell. bond market fell"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.content for r in ch.chunk_semantic(df, threshold=0.3).orderBy("chunk_index").collect()]
    assert got == ["red apple tree green apple tree", "stock market fell bond market fell"]


def test_embed_sparse_equals_dense(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "a b b"), (3, "")], "id long, t string")
    dense = {r.id: r.v for r in df.select("id", vec.embed("t").alias("v")).collect()}
    for r in vec.embed_sparse(df, "id", "t").collect():
        assert abs(dense[r.id][r.dim_index] - r.weight) < 1e-6
    assert sum(x != 0 for x in dense[1]) == 2 and not any(dense[3])


def test_embed_shuffles_no_text(spark):
    """Copies, repeated ids, nulls, odd tokens; against plain Python."""
    import hashlib
    import math
    import re
    from collections import Counter
    texts = ["a b b", "a b b", "", None, "...", " Ünï 9x, 9X!", "x" * 5000, "日本 語 日本", "a b"]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(None, "a")], "id long, t string")
    sparse = vec.embed_sparse(df, "id", "t")
    plan = sparse._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    want = []
    for i, t in [(i // 2, t) for i, t in enumerate(texts)] + [(None, "a")]:
        n = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % vec.EMBED_DIM
                    for w in re.split(r"[\W_]+", (t or "").lower()) if w)
        norm = math.sqrt(sum(x * x for x in n.values()))
        want += [(i, b, x / norm) for b, x in n.items()]
    assert sorted(map(str, map(tuple, sparse.collect()))) == sorted(map(str, want))
    dense = df.select("t", vec.embed("t").alias("v")).collect()
    assert [None if r.v is None else sum(x != 0 for x in r.v) for r in dense] == [2, 2, 0, None, 0, 2, 1, 2, 2, 1]


def test_arrow_batches_of_texts_are_small(spark):
    from sluice.session import ARROW_BYTES, apply_sql_conf
    apply_sql_conf(spark)
    assert spark.conf.get(ARROW_BYTES) in ("16m", str(16 << 20), f"{16 << 20}b")


def test_checkpoint_folder_is_required_on_a_cluster():
    from sluice.session import checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_check_digits(spark):
    from sluice.functions import safety as sf
    texts = [("card", "4539 1488 0343 6467", True), ("card", "4539 1488 0343 6468", False),
             ("iban", "DE89370400440532013000", True), ("iban", "DE88370400440532013000", False),
             ("iban", "GB82WEST12345698765432", True), ("card", "4111-1111-1111-1111", True), ("card", "0000000000000001", False)]
    df = spark.createDataFrame([(i, f"pay {t} now") for i, (_, t, _) in enumerate(texts)], "id int, t string")
    off = {r.id: [f.text for f in r.f] for r in df.select("id", sf.pii_findings("t").alias("f")).collect()}
    on = {r.id: [f.text for f in r.f] for r in df.select("id", sf.pii_findings("t", check_digits=True).alias("f")).collect()}
    for i, (_, t, ok) in enumerate(texts):
        assert off[i] == [t] and on[i] == ([t] if ok else [])
    other = spark.createDataFrame([(1, "mail bob@example.com"), (2, None), (3, "")], "id int, t string")
    assert [len(r.f) for r in other.select("id", sf.pii_findings("t", check_digits=True).alias("f")).orderBy("id").collect()] == [1, 0, 0]


def test_read_files_query(spark):
    import hashlib
    import os

    from sluice.plans.catalog import QUERIES
    folder = "/root/testdata/sf0.001"
    got = {r.file: r for r in QUERIES["read_files"](spark, folder).collect()}
    assert set(got) == set(os.listdir(folder))
    for name, r in got.items():
        data = open(f"{folder}/{name}", "rb").read()
        assert (r.bytes, r.sha256, r.title) == (len(data), hashlib.sha256(data).hexdigest(), name.rsplit(".", 1)[0])


def test_digests_of_long_files_by_parts(spark, tmp_path):
    import hashlib
    import random

    from sluice.sources import digests as dg
    rnd = random.Random(7)
    (tmp_path / "a b%20[1]").mkdir()
    data = {"a b%20[1]/x {y}.pdf": rnd.randbytes(100_000), "crlf.txt": b"a\r\n\n" * 15_000,
            "no_end.txt": rnd.randbytes(70_000) + b"z", "bom.md": dg.BOM + b"q\n" * 30_000,
            "bom_no_end.md": dg.BOM + b"q\n" * 30_000 + b"e", "lines.csv": b"\n" * 40_000, "one_line.json": b"\xff\xfe\x00" * 15_000,
            "x.gz": rnd.randbytes(50_000), "part.txt": b"x" * 29_999 + b"\n", "over.txt": b"x" * 30_000 + b"\n", "short.txt": b"hello"}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    key, part, split = "spark.sql.files.maxPartitionBytes", 30_000, 10_000
    was = spark.conf.get(key)
    spark.conf.set(key, split)
    try:
        files = fl.read_files(spark, str(tmp_path))
        got = {r.file_path.split(f"{tmp_path}/")[1]: (r.bytes, r.sha256, r.title)
               for r in dg.content_digest(files, str(tmp_path), part_bytes=part).collect()}
        assert got == {n: (len(b), hashlib.sha256(b).hexdigest(), n.split("/")[-1].rsplit(".", 1)[0]) for n, b in data.items()}
        pdf = {r.file_path[-9:]: r.sha256 for r in dg.content_digest(
            fl.read_files(spark, str(tmp_path), "*.pdf"), str(tmp_path), "*.pdf", part).collect()}
        assert pdf == {"x {y}.pdf": hashlib.sha256(data["a b%20[1]/x {y}.pdf"]).hexdigest()}
        ids = fl.scan_files(spark, "binaryFile", str(tmp_path), "no_end.txt").select(
            F.col("_metadata.file_path").alias("uri"), F.lit(0).alias("file_no"))
        sums = dg._pieces(spark, str(tmp_path), "no_end.txt", ids, part).groupBy("part").agg(F.sum("n").alias("n")).collect()
        assert sorted(r.part for r in sums) == [0, 1, 2] and max(r.n for r in sums) <= part + split + 5_000
    finally:
        spark.conf.set(key, was)


def test_files_that_no_line_reader_reads_are_hashed_whole(spark, tmp_path, monkeypatch):
    import gzip
    import hashlib

    from sluice.sources import digests as dg
    monkeypatch.setattr(dg, "CODEC_NAMES", "^$")
    monkeypatch.setattr(dg, "LINE_BYTES", 1_000)
    data = {"x y.gz": gzip.compress(b"line\n" * 5_000), "zeros.bin": b"\0" * 20_000, "one_long.txt": b"a\n" * 900 + b"b" * 2_500 + b"\na",
            "lines.txt": b"abc\n" * 1_000}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    try:
        for split in (was, 4_000, 700):
            spark.conf.set(key, split)
            out = dg.content_digest(fl.read_files(spark, str(tmp_path)), str(tmp_path), part_bytes=1_500)
            got = {r.file_path.split("/")[-1]: (r.bytes, r.sha256) for r in out.collect()}
            assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in data.items()}
            _, torn = dg._long_digests(spark, str(tmp_path), "*.[bt]*", 1_500)
            assert sorted(u.split("/")[-1] for u in torn) == ["one_long.txt", "zeros.bin"]
    finally:
        spark.conf.set(key, was)


def test_row_cap_of_the_sql_action(spark):
    from sluice.functions import plugins as pl
    spark.range(10).createOrReplaceTempView("t_cap")
    for cap, cut in ((3, True), (10, False), (11, False), (0, True)):
        rows = pl.sql_query(spark, "SELECT id FROM t_cap ORDER BY id", max_rows=cap).collect()
        assert [r.id for r in rows] == list(range(min(cap, 10))) and all(r.truncated == cut for r in rows)


def test_operation_counters(spark):
    from sluice.operators import usage
    a = spark.createDataFrame([("x",), ("x",), (None,)], "kind string")
    out = usage.operation_counters({"a": (a, "kind"), "b": (spark.range(3), F.col("id") % 2)})
    assert sorted((r.component, str(r.label), r.value) for r in out.collect()) == [
        ("a", "None", 1), ("a", "x", 2), ("b", "0", 2), ("b", "1", 1)]


def test_collection_changes_by_merge_on_read(spark, tmp_path):
    import os

    from sluice.sources.collections import ChunkTable
    rows = spark.range(20_000).select(F.concat(F.lit("c"), F.col("id")).alias("chunk_id"), (F.col("id") % 500).alias("doc_id"),
                                      F.md5(F.col("id").cast("string")).alias("content"), F.lit(0).alias("n"))
    t = ChunkTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.read()
    t.append(rows)
    want = {r.chunk_id: r for r in rows.collect()}

    def same(version=None):
        got = t.read(version).collect()
        assert len(got) == len(want) and {r.chunk_id: (r.doc_id, r.content, r.n) for r in got} == {
            k: (r.doc_id, r.content, r.n) for k, r in want.items()}

    def size(*parts):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(os.path.join(t.path, *parts)) for f in fs)
    t.delete(rows.filter("n = 0 and conv(substr(content, 1, 2), 16, 10) < 3").select("chunk_id"))    # about 1 %
    for k in [k for k, r in want.items() if int(r.content[:2], 16) < 3]:
        del want[k]
    same()
    assert size("gone") < 0.03 * size("data") and not os.path.exists(f"{t.path}/data/v=2")
    first = dict(want)
    up = spark.createDataFrame([("c1", 1, "new", 1), ("c1", 1, "newer", 2), ("x1", 9000, "added", 1), ("c2", 2, "b", 1)],
                               "chunk_id string, doc_id long, content string, n int")
    t.upsert(up, version_col="n")
    for r in up.collect():
        want[r.chunk_id] = r
    same()
    t.delete_documents(spark.createDataFrame([(7,), (9000,), (None,)], "doc_id long"))
    want = {k: r for k, r in want.items() if r.doc_id not in (7, 9000)}
    t.delete(spark.createDataFrame([("c2",), ("absent",), (None,)], "chunk_id string"))
    want.pop("c2")
    same()
    # an id that was removed comes back; then one version without lists
    t.append(spark.createDataFrame([("c2", 2, "back", 5)], up.schema))
    want["c2"] = t.read().filter("chunk_id = 'c2'").first()
    assert want["c2"].content == "back"
    same()
    t.compact()
    same()
    assert "_gone" not in t.read()._jdf.queryExecution().toString()
    assert [r.content for r in t.read(key="c1").collect()] == ["newer"]
    want = first
    same(2)                                     # older versions stay readable


def test_markdown_and_json_text(spark):
    from sluice.functions import markup as mk
    md = ["# Head #1\nPara one\ngoes on.\n\n- a\n- b **c**\n  more\n\n1) x ![alt](u) [t](v)\n***\n> q1\n> q2\n",
          "```\n# code\n\n- kept\n```\nafter", "~~~py\nopen", "", None, " plain  text ", "a\r\nb\r\n\r\nc", "* " * 50_000, "x\n" * 50_000, "*" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(md)], "id int, t string")
    got = {r.id: r.x for r in df.select("id", mk.markdown_to_text("t").alias("x")).collect()}
    assert got[0] == "Head #1\nPara one goes on.\na\nb c more\nx alt t\nq1 q2"
    assert got[1] == "# code\n\n- kept\nafter" and got[2] == "open" and got[3] == "" and got[4] is None
    assert got[5] == "plain text" and got[6] == "a b\nc" and got[8] == " ".join(["x"] * 50_000)
    js = ['{"b": [1, {"z": "deep", "a": true}], "a": "first"}', '"only"', "[]", "{}", "null", "{broken", None, "",
          '[' * 7 + '"far"' + ']' * 7, '{"a": null, "b": "x\\ny"}', '{"b": 2}']
    df = spark.createDataFrame([(i % 10, t) for i, t in enumerate(js)], "id int, t string").repartition(3)
    got = sorted(((r.id, r.text) for r in mk.json_to_text(df, "id", "t").collect()), key=str)
    assert got == sorted([(0, "first\n1\ntrue\ndeep"), (1, "only"), (2, ""), (3, ""), (4, ""), (5, "{broken"), (6, None), (7, ""),
                          (8, "far"), (9, "x\ny"), (0, "2")], key=str)


def test_embedder_tokens_are_those_of_the_pattern(spark):
    """ASCII texts are spaced by bytes, others by the pattern: the same buckets
    as each token hashed by itself."""
    import hashlib

    texts = ["Ab, c-D 1x\ty\n\x00\x7f_z", " lead and trail. ", "Übung ÀÉ, naïve  №5 x²", "İstanbul Σας", "a b c", "", None, "...", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").union(
        spark.sql("SELECT 100, CAST(unhex('6162FF6364') AS STRING)")).coalesce(1)
    want = {r.id: r.k for r in df.select("id", vec.tokens("t").alias("k")).collect()}
    rows = df.select("id", vec.embed("t").alias("v")).withColumn("u", vec.used_dims("v")).collect()
    assert len(rows) == len(texts) + 1 and want[100] == ["ab", "cd"]
    for r in rows:
        if want[r.id] is None:
            assert r.v is None and r.u.dims is None and r.u.dim_sum is None
            continue
        counts = [0] * vec.EMBED_DIM
        for k in want[r.id]:
            counts[int(hashlib.md5(k.encode()).hexdigest()[:8], 16) % vec.EMBED_DIM] += 1
        norm = sum(c * c for c in counts) ** 0.5 or 1
        assert r.v == pytest.approx([c / norm for c in counts], abs=1e-6)
        used = [i for i, c in enumerate(counts) if c]
        assert (r.u.dims, r.u.dim_sum) == (len(used), sum(used))
    plan = df.select(vec.embed("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan          # one string a text goes to Python, not an array of tokens


def test_packing_strips_and_measures_as_before(spark):
    """Pieces stripped by the pattern (also before line ends that are no white
    space) and packed while the joined length fits."""
    def packed(text, split, joiner, size):
        import re
        out, cur, st = [], "", 0
        for s in filter(None, (re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+(?=[\x85  ]?\Z)", "", p) for p in re.split(split, text))):
            pot = cur + joiner + s if cur else s
            if cur and len(pot) > size:
                out.append((cur, st, st + len(cur)))
                cur, st = s, st + len(cur)
            else:
                cur = pot
        return out + ([(cur, st, st + len(cur))] if cur else [])

    texts = [" a b.  c d \x0b! \t.e", "x" * 9 + ". y. " + "ü😀" * 4 + "? z", "one  . two \x85!three   ", "", "...", "a.b.c.d.e.f.g.h.i", " \n\n p1\n\n\n\np2 \n\n" + "q" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for split, joiner in ((ch.SENTENCE_SPLIT, " "), (ch.PARAGRAPH_SPLIT, "\n\n")):
        for size in (1, 5, 10, 512):
            got = df.select("id", ch.packed_pieces(F.col("t"), split, joiner, size).alias("p")).collect()
            for r in got:
                assert [tuple(p) for p in r.p] == packed(texts[r.id], split, joiner, size), (r.id, split, size)
