"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A document's features are indicators of hashed n-grams: 1- to 3-grams of its
bytes (any white space is a blank), 1- to 3-grams of its words' shapes (upper
case, symbols, digits, a repeat of the word before) and the share of its word
3-grams that repeat, in tenths. Each indicator is scaled by the log of its
class count ratio (naive Bayes), rows are scaled to unit length, and a linear
hinge-loss model is fitted by dual coordinate descent. Scores are the margins
through a logistic curve fitted on a part of the sample that the descent did
not see, at the class shares of all training labels.

Fitting uses a bounded sample: ``PER_CLASS`` labelled documents a class in the
order of an id hash, each as a bitmap of ``BUCKETS`` bits, so what reaches the
driver is at most 2 * PER_CLASS * BUCKETS / 8 bytes. The model is two arrays
of BUCKETS floats. Scoring is one narrow pass over the documents.

Defined results: null or empty text scores as a text without n-grams; without
both classes among the training labels every score is the share of label 1
(0.5 without labels); labels of missing documents and values other than 0 and
1 are not used; repeated rows give repeated results; an empty table gives
none. Other columns are not read.
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

BUCKETS = 1 << 16
PER_CLASS = 2000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 20
HOLD_OUT = 4            # every fourth sampled row calibrates

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[0x09:0x0E] = 0x20
# kind of each byte: 1 upper, 2 lower or beyond ASCII, 4 digit, 8 other
_KIND = np.full(256, 8, dtype=np.uint8)
_KIND[0x30:0x3A] = 4
_KIND[0x41:0x5B] = 1
_KIND[0x61:0x7B] = 2
_KIND[0x80:] = 2


def _bucket(h: np.ndarray) -> np.ndarray:
    return (tk.mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)


def slice_features(s: tk.Slice) -> Iterator[np.ndarray]:
    """Sorted distinct buckets of each document of a slice."""
    b = s.buf.astype(np.uint64)
    grams = []
    for k in (1, 2, 3):
        m = len(b) - k + 1
        h = np.full(max(m, 0), k, dtype=np.uint64)
        for t in range(k):
            h = (h << np.uint64(8)) | b[t:t + m]
        grams.append(_bucket(h) if m > 0 else np.zeros(0, np.int64))
    h = s.hashes()
    kinds = np.zeros(len(s), dtype=np.uint64)
    if len(s):
        bits = _KIND[s.buf]
        cum = [np.concatenate(([0], np.cumsum((bits & v) > 0))) for v in (1, 2, 4, 8)]
        n = [c[s.ends] - c[s.starts] for c in cum]
        other = np.minimum(n[3], 3)
        kinds = (np.minimum(n[0], 2) + 3 * np.minimum(n[1], 2) + 9 * np.minimum(n[2], 1)
                 + 18 * other).astype(np.uint64)
        again = np.zeros(len(s), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (s.doc[1:] == s.doc[:-1])
        kinds = kinds * np.uint64(2) + again.astype(np.uint64)
    shapes = [_bucket(tk.grams(kinds + np.uint64(1), k) if len(s) >= k else kinds[:0]) for k in (1, 2, 3)]
    triple = tk.grams(h, 3)
    seen = np.zeros(BUCKETS, dtype=bool)
    for d in range(s.n_docs):
        seen[:] = False
        lo, hi = s.offsets[d], s.offsets[d + 1]
        for k, g in enumerate(grams):
            seen[g[lo:max(lo, hi - k)]] = True
        i, j = s.word_off[d], s.word_off[d + 1]
        for k, g in enumerate(shapes):
            seen[g[i:max(i, j - k)]] = True
        t = triple[i:max(i, j - 2)]
        if len(t):
            share = 1 - len(np.unique(t)) / len(t)
            seen[_bucket(np.array([1000 + int(10 * share)], dtype=np.uint64) << np.uint64(32))] = True
        yield np.flatnonzero(seen)


def bitmaps(sample: DataFrame) -> DataFrame:
    """(y, bits): the packed indicator bitmap of each sampled text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tk.slices(b.column(0), tk.SPACES, _BLANK):
                bits = []
                for f in slice_features(s):
                    row = np.zeros(BUCKETS, dtype=bool)
                    row[f] = True
                    bits.append(np.packbits(row).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(s.first, s.n_docs), pa.array(bits, pa.binary())],
                    names=["y", "bits"])
    return sample.select("text", "y").mapInArrow(run, "y int, bits binary")


class Model:
    """Margin = sum(weight[f]) / sqrt(sum(square[f])) + bias over a text's
    features f; score = logistic(slope * margin + shift)."""

    def __init__(self, weight, square, bias: float, slope: float, shift: float):
        self.weight, self.square, self.bias = weight, square, bias
        self.slope, self.shift = slope, shift

    def margin(self, f: np.ndarray) -> float:
        norm = self.square[f].sum()
        return float(self.weight[f].sum() / np.sqrt(norm) + self.bias) if norm > 0 else self.bias

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def constant(share: float) -> Model:
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(p / (1 - p))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of (smoothed share of label 1 rows' indicators / label 0 rows')."""
    count = np.full((2, BUCKETS), SMOOTHING)
    for f, c in zip(rows, y):
        count[c, f] += 1
    share = count / count.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float,
            epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss. Row i is
    r[f] / |r[f]| plus a constant 1; its dual variable stays in [0, cost_i],
    where cost_i gives both classes the same total."""
    n = len(rows)
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(n)
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.bincount(y, minlength=2)
    limit = cost * n / 2 / share[y]
    scaled = [r[f] / max(np.sqrt((r[f] ** 2).sum()), 1e-12) for f in rows]
    diagonal = np.array([(x ** 2).sum() + 1 for x in scaled])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(n):
            g = sign[i] * (scaled[i] @ w[rows[i]] + bias) - 1
            new = min(max(alpha[i] - g / diagonal[i], 0.0), limit[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * scaled[i]
                bias += step
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic curve through (margin, label): Newton steps with a
    small ridge, so separable data stay finite."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = np.array([(weight * (p - y) * margins).sum() + 1e-3 * a, (weight * (p - y)).sum() + 1e-3 * b])
        q = weight * p * (1 - p)
        h = np.array([[(q * margins ** 2).sum() + 1e-3, (q * margins).sum()],
                      [(q * margins).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        size = max(1.0, np.abs(step).max() / 2)
        a, b = a - step[0] / size, b - step[1] / size
    return float(a), float(b)


def train(rows: list[np.ndarray], y: np.ndarray, n0: int, n1: int, *, cost: float = COST,
          epochs: int = EPOCHS) -> Model:
    """Fit on three of four rows (in the given order), calibrate on the rest
    at the class sizes ``n0`` and ``n1``."""
    rank = np.zeros(len(y), dtype=np.int64)      # place within the class
    for c in (0, 1):
        rank[y == c] = np.arange((y == c).sum())
    held = rank % HOLD_OUT == HOLD_OUT - 1
    if len(set(y[held])) < 2:                    # too few rows to set any aside
        held = np.zeros(len(y), dtype=bool)
    keep = np.flatnonzero(~held)
    part = [rows[i] for i in keep]
    r = log_count_ratio(part, y[keep])
    w, bias = descend(part, y[keep], r, cost, epochs)
    model = Model(r * w, r ** 2, bias, 1.0, 0.0)
    at = np.flatnonzero(held) if held.any() else keep
    size = np.array([n0, n1], dtype=float)
    weight = (size / np.bincount(y[at], minlength=2))[y[at]] / size.sum() * len(at)
    model.slope, model.shift = calibrate(np.array([model.margin(rows[i]) for i in at]), y[at], weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str, chosen: Column, *,
        per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of the label rows that ``chosen`` selects."""
    n0, n1 = class_sizes(labels, label, chosen)
    if not n0 or not n1:
        return constant(n1 / (n0 + n1) if n0 + n1 else 0.5)
    sample = labelled_sample(docs, labels, label, chosen, per_class, id_col=id_col, text_col=text_col)
    data = bitmaps(sample).toPandas()            # bounded: 2 * per_class bitmaps
    data = data.sort_values(["y", "bits"])       # any order of the tasks fits alike
    y = data["y"].to_numpy(dtype=np.int64)
    if len(set(y)) < 2:
        return constant(n1 / (n0 + n1))
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))) for x in data["bits"]]
    return train(rows, y, n0, n1)


def score(docs: DataFrame, model: Model, *, keep: list[str] | None = None,
          text_col: str = "text") -> DataFrame:
    """Columns ``keep`` (default: all) and score, the probability of label 1.
    A column ``score`` of ``docs`` is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    body, = tk.unused([*keep, "score"], "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            text = b.column(b.schema.get_field_index(body))
            margins = np.zeros(b.num_rows)
            for s in tk.slices(text, tk.SPACES, _BLANK):
                margins[s.first:s.first + s.n_docs] = [m.margin(f) for f in slice_features(s)]
            new = pa.array(m.probability(margins))
            yield pa.RecordBatch.from_arrays(
                [new if f.name == "score" else c for f, c in zip(b.schema, b.columns)],
                names=b.schema.names)
    out = docs.select(*keep, F.lit(0.0).alias("score"), F.col(text_col).alias(body))
    return out.mapInArrow(run, out.schema).drop(body)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of a documents table, learned from
    the labels outside the held-out quarter."""
    model = fit(docs, labels, "quality", crc_remainder("doc_id", 4) != 2)
    out = score(docs.withColumn("held_out", crc_remainder("doc_id", 4) == 2), model,
                keep=["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
