"""Toxicity: counterfactual-regularised logistic regression on words.

Features are the distinct words of a document (letters and digits, case
folded) and their beginnings of ``PREFIX`` bytes, which inflected forms share. The classifier is fitted on a bounded sample of labelled rows
(``PER_CLASS`` documents a class, in the order of an id hash). Every sampled
sentence that names an identity group is also taken with its identity terms
swapped for the next term of the same list, and with the terms left out; the
squared changes of the score are part of the loss, so a term that only marks a
group cannot carry the verdict and neutral mentions of a group score like
those of another group or of none. An L1 term keeps words without evidence at zero. Both classes weigh the same, so 0.5
is the point where a text is as likely to come from either class.

The vocabulary is counted with Spark over the sample and holds at most
``MAX_WORDS`` words, so the broadcast model is bounded. Scoring is one narrow
pass over the documents.

Defined results: null or empty text scores as a text without known words;
without both classes among the training labels every score is the share of
label 1 (0.5 without labels); labels of missing documents and values other
than 0 and 1 are not used; repeated rows give repeated results; an empty table
gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import tokens as tk
from sluice.llm.langid import crc_remainder
from sluice.llm.sampling import class_sizes, labelled_sample
from sluice.llm.store import materialise

PER_CLASS = 6000
MIN_DOCS = 4
MAX_WORDS = 20000
PREFIX = 5
SWAP_PENALTY = 8.0
L1 = 2e-4
STEPS = 400

# Identity terms; a term is swapped within its list.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"],
    ["muslim", "jewish", "christian", "hindu", "buddhist", "atheist"],
    ["muslims", "jews", "christians", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"], ["african", "european", "american", "arab"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "refugees", "natives", "foreigners"], ["disabled", "deaf", "blind"],
    ["old", "young"], ["frauen", "männer"], ["femmes", "hommes"], ["mujeres", "hombres"],
]


def swap_table(groups=IDENTITY) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of the terms, hash each is swapped for)."""
    pairs = [(a, g[(i + 1) % len(g)]) for g in groups for i, a in enumerate(g)]
    h = tk.word_hash([a for a, _ in pairs])
    to = tk.word_hash([b for _, b in pairs])
    order = np.argsort(h)
    return h[order], to[order]


def features(s: tk.Slice, h: np.ndarray) -> np.ndarray:
    """Two feature hashes per word: the word's, then its beginning's (of
    words that are longer; otherwise the word's again)."""
    long = s.ends - s.starts > PREFIX
    head = np.where(long, tk.mix(s.hashes(PREFIX) + np.uint64(PREFIX)), h)
    return np.column_stack([h, head])


def sentence_swaps(s: tk.Slice, h: np.ndarray, terms: np.ndarray, to: np.ndarray):
    """Per document with identity terms, two pairs per such sentence: its
    words and the swapped words, its words and those without the terms.

    A sentence ends at a line break or at ``.``, ``!`` or ``?``.
    """
    pos = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    named = terms[pos] == h
    if not named.any():
        return {}
    ends = np.isin(s.buf, np.frombuffer(b".!?\n", dtype=np.uint8))
    sentence = np.concatenate(([0], np.cumsum(ends)))[s.starts]
    other = np.where(named, to[pos], h)
    out: dict[int, list] = {}
    for d, n in {(int(s.doc[i]), int(sentence[i])) for i in np.flatnonzero(named)}:
        at = (s.doc == d) & (sentence == n)
        words = np.unique(h[at])
        out.setdefault(d, []).extend([(words, np.unique(other[at])), (words, np.unique(h[at & ~named]))])
    return out


def words_and_swaps(sample: DataFrame, groups=IDENTITY) -> DataFrame:
    """(y, pair, words, swapped): one row per document with its words, and
    one (``pair``) per counterfactual of a sentence that names a group."""
    terms, to = swap_table(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys = b.column(1).to_pylist()
            for s in tk.slices(b.column(0), tk.NON_ALNUM, tk.fold_latin):
                h = s.hashes()
                f = features(s, h)
                swaps = sentence_swaps(s, h, terms, to) if len(h) else {}
                rows = []
                for d in range(s.n_docs):
                    y = ys[s.first + d]
                    rows.append((y, False, np.unique(f[s.word_off[d]:s.word_off[d + 1]]), h[:0]))
                    rows += [(y, True, a, z) for a, z in swaps.get(d, ())]
                y, pair, words, swapped = zip(*rows)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y, pa.int32()), pa.array(pair),
                     pa.array([tk.signed(w) for w in words], longs),
                     pa.array([tk.signed(w) for w in swapped], longs)],
                    names=["y", "pair", "words", "swapped"])
    return sample.select("text", "y").mapInArrow(
        run, "y int, pair boolean, words array<bigint>, swapped array<bigint>")


def known_words(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """``rows`` with only the words of the vocabulary (sorted), as places."""
    def places(col: pa.Array) -> pa.Array:
        flat = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
        pos = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        hit = words[pos] == flat
        n = np.bincount(at[hit], minlength=len(col))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)),
                                        pa.array(pos[hit].astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), places(b.column(2)),
                                              places(b.column(3))],
                                             names=["y", "pair", "words", "swapped"])
    return rows.mapInArrow(run, "y int, pair boolean, words array<int>, swapped array<int>")


class Model:
    """Word hashes (sorted), their weights and the intercept."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(words)
        self.words, self.weights, self.bias = words[order], weights[order], bias


def entries(rows) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of lists of columns."""
    rows = [np.asarray(r, dtype=np.int64) for r in rows]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)


def fit_logistic(x, y: np.ndarray, diff, n_words: int, swap_penalty: float, l1: float,
                 steps: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on mean log loss + swap_penalty * mean
    squared score change + l1 * |w|. ``x``: (row, column); ``diff``: (row,
    column, sign, number of pairs)."""
    r, c = x
    n = len(y)
    dr, dc, ds, m = diff
    share = np.bincount(y, minlength=2) / n
    weight = np.where(y == 1, 0.5 / share[1], 0.5 / share[0]) / n
    # step bound: largest row norms of both parts
    size = np.bincount(r, minlength=n).astype(float) + 1
    bound = 0.25 * (weight * size).sum()
    if m:
        bound += 2 * swap_penalty * np.bincount(dr, weights=np.abs(ds), minlength=m).sum() / m
    w, b = np.zeros(n_words), 0.0
    v, vb, t = w.copy(), b, 1.0
    step = 8.0 / bound
    for _ in range(steps):
        z = np.bincount(r, weights=v[c], minlength=n) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gw = np.bincount(c, weights=g[r], minlength=n_words)
        if m:
            change = np.bincount(dr, weights=ds * v[dc], minlength=m)
            gw += 2 * swap_penalty / m * np.bincount(dc, weights=ds * change[dr], minlength=n_words)
        new = v - step * gw
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = vb - step * g.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, *, groups=IDENTITY,
        per_class: int = PER_CLASS, min_docs: int = MIN_DOCS, max_words: int = MAX_WORDS,
        swap_penalty: float = SWAP_PENALTY, l1: float = L1, steps: int = STEPS,
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of the label rows that ``train`` selects."""
    n0, n1 = class_sizes(labels, label, train)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(p / (1 - p))))
    sample = labelled_sample(docs, labels, label, train, per_class, id_col=id_col, text_col=text_col)
    rows = materialise(words_and_swaps(sample, groups), "toxicity-words")
    whole = rows.filter(~F.col("pair"))
    got = whole.agg(F.count("*").alias("n"), F.sum("y").alias("n1")).first()
    if not got.n or got.n1 in (0, got.n):                 # labelled documents are missing
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(n1 / n0)))
    # words whose class share is furthest from the sample's, in standard errors
    gap = F.abs(F.col("n1") / F.col("n") - F.lit(got.n1 / got.n)) * F.sqrt("n")
    top = (whole.select("y", F.explode("words").alias("w")).groupBy("w")
           .agg(F.count("*").alias("n"), F.sum("y").alias("n1")).filter(F.col("n") >= min_docs)
           .orderBy(gap.desc(), "w").limit(max_words).select("w").toPandas()["w"])
    terms, _ = swap_table(groups)
    words = np.unique(np.concatenate([top.to_numpy(np.int64).view(np.uint64), terms]))
    data = known_words(rows, words).toPandas()            # at most per_class documents a class
    pairs = data[data["pair"]]
    x = data[~data["pair"]]
    ar, ac = entries(pairs["words"])
    br, bc = entries(pairs["swapped"])
    diff = (np.concatenate([ar, br]), np.concatenate([ac, bc]),
            np.concatenate([np.ones(len(ar)), -np.ones(len(br))]), len(pairs))
    w, bias = fit_logistic(entries(x["words"]), x["y"].to_numpy(), diff, len(words),
                           swap_penalty, l1, steps)
    on = w != 0
    return Model(words[on], w[on], bias)


def score(docs: DataFrame, model: Model, *, keep: list[str] | None = None,
          text_col: str = "text") -> DataFrame:
    """Columns ``keep`` (default: all) and score, the probability of label 1.
    A column ``score`` of ``docs`` is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    body, = tk.unused([*keep, "score"], "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        bitmap = np.zeros(1 << 20, dtype=bool)
        bitmap[m.words >> np.uint64(44)] = True
        for b in batches:
            z = np.full(b.num_rows, m.bias)
            at_text = b.schema.get_field_index(body)
            for s in tk.slices(b.column(at_text), tk.NON_ALNUM, tk.fold_latin):
                f = features(s, s.hashes()).ravel()
                at = np.flatnonzero(bitmap[f >> np.uint64(44)])
                if not len(at):
                    continue
                pos = np.minimum(np.searchsorted(m.words, f[at]), len(m.words) - 1)
                hit = m.words[pos] == f[at]
                once = np.unique(s.doc[at[hit] // 2] * len(m.words) + pos[hit])
                z[s.first:s.first + s.n_docs] += np.bincount(
                    once // len(m.words), weights=m.weights[once % len(m.words)], minlength=s.n_docs)
            new = pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pa.RecordBatch.from_arrays(
                [new if f.name == "score" else c for f, c in zip(b.schema, b.columns)],
                names=b.schema.names)
    out = docs.select(*keep, F.lit(0.0).alias("score"), F.col(text_col).alias(body))
    return out.mapInArrow(run, out.schema).drop(body)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of a documents table, learned from
    the labels outside the held-out fifth."""
    model = fit(docs, labels, "toxic", crc_remainder("doc_id", 5) != 0)
    out = score(docs.withColumn("held_out", crc_remainder("doc_id", 5) == 0), model,
                keep=["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
