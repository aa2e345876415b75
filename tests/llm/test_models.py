"""Language identification, toxicity and quality classifiers: held-out
accuracy on the given tables, independence of labels and ids, counterfactual
swaps, edge rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import langid, quality_model, toxicity
from sluice.llm import tokens as tk

TABLES = "/root/testdata/sf0.01"
EDGE = [(None, "a b"), (9000, None), (9001, ""), (9002, "12 345 !!"), (9003, "word " * 20000),
        (9004, "漢字 ü"), (9004, "漢字 ü")]


@pytest.fixture(scope="module")
def docs(spark):
    from sluice.session import ship_package
    ship_package(spark)
    return spark.read.parquet(f"{TABLES}/documents.parquet")


def test_language_accuracy(docs):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in got if x.held_out]
    assert 250 < len(held) < 420
    assert sum(x.lang == x.lang_pred for x in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 for x in got)


def test_language_does_not_read_lang_of_held_out_rows(docs):
    held = langid.crc_remainder("doc_id", 3) == 1
    other = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    key = lambda df: sorted((x.doc_id, x.lang_pred, round(x.score, 9)) for x in df.collect())
    assert key(langid.identify(docs)) == key(langid.identify(other))


def test_language_edges_and_blocks(make, docs):
    train = docs.filter(F.col("lang").isin("en", "fr", "de"))
    whole = langid.fit(train)
    blocks = langid.fit(train, block_langs=1)
    assert len(whole) == 1 and len(blocks) == 3
    rows = EDGE + [(1, "the thing and of with the"), (2, "le de la et une que des")]
    a = langid.predict(make(rows, "score string"), whole).collect()
    b = langid.predict(make(rows, "score string"), blocks).collect()
    pick = lambda out: sorted((str(x.doc_id), x.lang_pred, round(x.score, 6)) for x in out)
    assert pick(a) == pick(b)
    got = {x.doc_id: x for x in a}
    assert [got[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and got[9000].score == 0
    assert got[9004].lang_pred != "und"
    assert (got[1].lang_pred, got[2].lang_pred) == ("en", "fr")
    assert langid.predict(make([]), whole).count() == 0
    none = langid.fit(train.limit(0))
    assert {x.lang_pred for x in langid.predict(make(rows), none).collect()} == {"und"}


def test_toxicity_accuracy(docs, spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    out = toxicity.toxicity(docs, labels)
    got = out.join(labels, "doc_id").collect()
    train = [x for x in got if not x.held_out]
    held = [x for x in got if x.held_out]
    assert sum(x.predicted == x.toxic for x in train) / len(train) > 0.95
    assert sum(x.predicted == x.toxic for x in held) / len(held) > 0.85
    # labels of held-out rows are not read
    flipped = labels.withColumn("toxic", F.when(langid.crc_remainder("doc_id", 5) == 0, 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    key = lambda df: sorted((x.doc_id, round(x.score, 9)) for x in df.collect())
    assert key(out) == key(toxicity.toxicity(docs, flipped))


def identity_corpus():
    """Insults mostly come with one group's name; the name alone is neutral."""
    r = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(["tree", "house", "river", "market", "song", "bread"]) for _ in range(12)]
        toxic = i % 2
        if toxic and r.random() < .6:
            words += [r.choice(["grunk", "vlim"])]
        if r.random() < (.8 if toxic else .1):
            words += ["women"]
        r.shuffle(words)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, toxic))
    return rows, labels


def test_counterfactual_penalty(make, spark):
    rows, labels = identity_corpus()
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = make([(1, "the women sang"), (2, "the men sang"), (3, "a grunk"), (4, None), (5, "")])
    every = F.lit(True)
    score = {}
    for penalty in (0.0, 8.0):
        m = toxicity.fit(make(rows), lab, "toxic", every, swap_penalty=penalty)
        score[penalty] = {x.doc_id: x.score for x in toxicity.score(probe, m).collect()}
    gap = {p: abs(s[1] - s[2]) for p, s in score.items()}
    assert gap[0.0] > 0.2 and gap[8.0] < 0.05
    assert score[8.0][1] < 0.5 < score[8.0][3]
    assert score[8.0][4] == score[8.0][5]


def test_toxicity_without_labels(make, spark):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.fit(make(EDGE), lab, "toxic", F.lit(True))
    assert {x.score for x in toxicity.score(make(EDGE, "score string"), m).collect()} == {0.5}
    one = spark.createDataFrame([(9001, 1), (9001, 1), (12345, None)], "doc_id long, toxic int")
    assert all(x.score > 0.99 for x in toxicity.score(make(EDGE), toxicity.fit(
        make(EDGE), one, "toxic", F.lit(True))).collect())
    missing = spark.createDataFrame([(77001, 1), (77002, 0)], "doc_id long, toxic int")
    assert {x.score for x in toxicity.score(make(EDGE), toxicity.fit(
        make(EDGE), missing, "toxic", F.lit(True))).collect()} == {0.5}
    assert toxicity.score(make([]), m).count() == 0


def plain_words(text):
    """Lower-case words of the letters that the test's texts hold."""
    return [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split(" ") if w]


def test_toxicity_scores_match_plain_python(make):
    r = random.Random(7)
    vocabulary = ["Idiots", "idiot", "women", "WOMEN", "stupidly", "stupid", "été", "ÉTÉ", "naïveté", "a", "9", "ab-c"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25))) for _ in range(60)] + [None, "", "!", "zz"]
    known = sorted({w for v in vocabulary for w in plain_words(v)})
    whole = tk.word_hash(known)
    head = tk.mix(tk.word_hash(["idiot", "stupi"]) + np.uint64(toxicity.PREFIX))     # beginnings of longer words
    weights = np.random.default_rng(3).standard_normal(len(known) + 2)
    m = toxicity.Model(np.concatenate([whole, head]), weights.copy(), 0.25)
    weight = dict(zip([*known, "idiot-", "stupi-"], weights))
    got = {x.doc_id: x.score for x in toxicity.score(make(list(enumerate(texts))), m).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = set(plain_words(t))
        held = words | {w[:5] + "-" for w in words if len(w.encode()) > toxicity.PREFIX}
        z = 0.25 + sum(weight.get(f, 0.0) for f in held)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9, repr(t)


def test_quality_accuracy(docs, spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    got = quality_model.quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [x for x in got if x.held_out]
    assert sum(x.predicted == x.quality for x in held) / len(held) > 0.93
    assert all(0 <= x.score <= 1 for x in got)


def plain_quality_features(text):
    """Buckets of one text, gram by gram."""
    low = (1 << 64) - 1
    b = bytes(0x20 if 9 <= c <= 13 else c for c in (text or "").encode())
    words = [w for w in b.split(b" ") if w]
    bucket = lambda h: int(tk.mix(np.array([h & low], dtype=np.uint64))[0]) % quality_model.BUCKETS
    gram = lambda hs: int(tk.grams(np.array(hs, dtype=np.uint64), len(hs))[0])
    out = set()
    for k in (1, 2, 3):
        for i in range(len(b) - k + 1):
            h = k
            for c in b[i:i + k]:
                h = h << 8 | c
            out.add(bucket(h))
    shapes = []
    for i, w in enumerate(words):
        upper, digit = sum(65 <= c <= 90 for c in w), sum(48 <= c <= 57 for c in w)
        lower = sum(97 <= c <= 122 or c >= 128 for c in w)
        other = len(w) - upper - digit - lower
        kind = min(upper, 2) + 3 * min(lower, 2) + 9 * min(digit, 1) + 18 * min(other, 3)
        shapes.append(2 * kind + (i > 0 and words[i - 1] == w) + 1)
    for k in (1, 2, 3):
        out |= {bucket(gram(shapes[i:i + k])) for i in range(len(shapes) - k + 1)}
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    if triples:
        out.add(bucket(1000 + int(10 * (1 - len(set(triples)) / len(triples))) << 32))
    return out


def test_quality_scores_match_plain_python(make, docs):
    r = random.Random(5)
    texts = [x.text for x in docs.filter("doc_id % 37 = 1").select("text").collect()][:20]
    texts += ["".join(r.choice(["Ab", "a ", " ", "\n", "9", "#", "é", "漢 ", "x x x ", "|"]) for _ in range(r.randint(0, 60)))
              for _ in range(60)] + [None, "", " ", "a", "a a a a"]
    g = np.random.default_rng(6)
    m = quality_model.Model(g.standard_normal(quality_model.BUCKETS), g.random(quality_model.BUCKETS), 0.1, 1.5, -0.2)
    got = {x.doc_id: x.score for x in quality_model.score(make(list(enumerate(texts))), m).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        f = sorted(plain_quality_features(t))
        margin = sum(m.weight[f]) / sum(m.square[f]) ** .5 + m.bias if f else m.bias
        assert abs(got[i] - 1 / (1 + np.exp(-(1.5 * margin - 0.2)))) < 1e-9, repr(t)


def test_log_count_ratio_counts_indicators():
    rows = [np.array([1, 5]), np.array([5]), np.array([1, 7])]
    r = quality_model.log_count_ratio(rows, np.array([0, 1, 1]))
    n = quality_model.BUCKETS
    assert abs(r[5] - np.log((2 / (n + 3)) / (2 / (n + 2)))) < 1e-12
    assert abs(r[7] - np.log((2 / (n + 3)) / (1 / (n + 2)))) < 1e-12


def test_quality_edges(make, spark):
    lab = spark.createDataFrame([], "doc_id long, quality int")
    m = quality_model.fit(make(EDGE), lab, "quality", F.lit(True))
    assert {x.score for x in quality_model.score(make(EDGE, "score string"), m).collect()} == {0.5}
    few = spark.createDataFrame([(9003, 0), (9004, 1), (9000, 1)], "doc_id long, quality int")
    m = quality_model.fit(make(EDGE), few, "quality", F.lit(True))
    got = {x.doc_id: x.score for x in quality_model.score(make(EDGE), m).collect()}
    assert got[9003] < got[9004] and got[9000] == got[9001]
    assert quality_model.score(make([]), m).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    """Primal and dual objectives of the hinge loss meet."""
    r = np.random.default_rng(0)
    rows = [np.sort(r.choice(200, 12, replace=False)) for _ in range(60)]
    y = np.array([int(f[0] < 12) for f in rows])
    scale = r.normal(size=quality_model.BUCKETS)
    w, b = quality_model.descend(rows, y, scale, 1.0, 400)
    x = [scale[f] / np.linalg.norm(scale[f]) for f in rows]
    sign = np.where(y == 1, 1, -1)
    cost = (len(y) / 2 / np.bincount(y, minlength=2))[y]
    z = np.array([a @ w[f] + b for a, f in zip(x, rows)])
    primal = 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - sign * z)).sum()
    # at the optimum primal = dual = sum(alpha) - |w|^2 / 2; margins inside 1 are at their bound
    outside = cost[(sign * z) < 1 - 1e-6].sum()
    assert primal >= outside - 0.5 * (w @ w + b * b) - 1e-6
    for _ in range(20):
        dw, db = r.normal(size=w.shape) * 1e-3 * (w != 0), r.normal() * 1e-3
        z2 = np.array([a @ (w + dw)[f] + b + db for a, f in zip(x, rows)])
        other = 0.5 * ((w + dw) @ (w + dw) + (b + db) ** 2) + (cost * np.maximum(0, 1 - sign * z2)).sum()
        assert other >= primal - 1e-4
