"""The pipeline's stages on edge rows, and what they keep and drop."""

import random

import corpus_pipeline as cp
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", n_words int, kept string, size string, taken int, row string, spans string, hit_words int"


def frame(spark, rows):
    full = [(i, t, lang, src, len(t) if t is not None else None, 1, "k", "s", 2, "r", "p", 3)
            for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS + CLASH)


def bench(spark, tmp_path):
    rows = [("b1", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), ("b2", None)]
    spark.createDataFrame(rows, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def prose(r, n):
    common = "the of and to in a is that it for on".split()
    words = [r.choice(common) if r.random() < .4 else "".join(r.choice("abcdefghij") for _ in range(6))
             for _ in range(n)]
    return " ".join(words) + "."


def corpus():
    r = random.Random(11)
    rows = [(i, prose(r, 120), "en", f"s{i % 3}") for i in range(20)]
    shared = prose(r, 60)
    rows[3] = (3, rows[3][1] + "\n" + shared + "\n" + prose(r, 40), "en", "s0")
    rows[7] = (7, prose(r, 50) + "\n" + shared, "en", None)
    rows.append((30, rows[5][1], "en", "s1"))                             # exact copy
    rows.append((31, rows[6][1].replace("the", "The", 1) + " end", "en", "s1"))   # near copy
    rows.append((32, prose(r, 60) + " Alpha beta gamma delta epsilon zeta eta theta iota kappa. " + prose(r, 30), "en", "s2"))
    rows.append((33, "junk### " * 90, "en", "s2"))
    rows += [(34, None, "en", "s2"), (35, "", None, "s2"), (36, " \n", "fr", None), (None, prose(r, 70), "en", "s0"),
             (8, rows[8][1], "en", "s2"), (37, "one two", "en", "s2")]
    return rows


def test_stages(spark, tmp_path):
    sf = bench(spark, tmp_path)
    docs = frame(spark, corpus())
    cols = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "ngram_jaccard_join", "substring_dedup",
                                         "decontaminate", "mix_sources"]
    stage = dict(cp.STAGES)
    a = stage["quality_rules"](spark, docs, sf)
    ids = sorted(x.doc_id for x in a.filter("doc_id is not null").collect())
    assert a.columns == cols
    assert set(range(20)) | {30, 31, 32} <= set(ids) and not {33, 34, 35, 36, 37} & set(ids)
    b = stage["ngram_jaccard_join"](spark, a, sf)
    ids = sorted(x.doc_id for x in b.filter("doc_id is not null").collect())
    assert b.columns == cols and ids == [*range(20), 32]                  # 8 once, copies gone
    assert b.filter("doc_id is null").count() == 1
    c = stage["substring_dedup"](spark, b, sf)
    text = {x.doc_id: (x.text, x.n_chars) for x in c.collect()}
    before = {x.doc_id: x.text for x in b.collect()}
    assert c.columns == cols and set(text) == set(before)
    assert text[3][0] == before[3]
    # the passage goes from the later document, its first part stays as it was
    assert text[7][0] == before[7].split("\n")[0] + "\n" and text[7][1] == len(text[7][0])
    assert all(text[i][0] == before[i] for i in before if i != 7)
    d = stage["decontaminate"](spark, c, sf)
    assert d.columns == cols and {x.doc_id for x in d.collect()} == set(before) - {32}
    e = stage["mix_sources"](spark, d, sf)
    got = e.collect()
    assert {"doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"} <= set(e.columns)
    assert got and all(x.taken in (x.size, 2 * x.size) and x.taken > 0 for x in got)


def test_empty_input(spark, tmp_path):
    sf = bench(spark, tmp_path)
    docs = frame(spark, [])
    for name, f in cp.STAGES:
        out = f(spark, docs, sf)
        assert out.count() == 0
        if name != "mix_sources":
            assert out.columns == docs.columns


def test_run_is_the_stages(spark, tmp_path):
    sf = bench(spark, tmp_path)
    frame(spark, corpus()).select(*DOCS.replace(" long", "").replace(" string", "").split(", ")) \
        .write.parquet(f"{sf}/documents.parquet")
    out = cp.run(spark, sf)
    again = cp.run(spark, sf)
    key = lambda df: sorted((x.doc_id or -1, x.text, x.taken) for x in df.collect())
    assert key(out) == key(again) and out.filter(F.col("taken") <= 0).count() == 0
