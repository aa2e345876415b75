"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Characters are folded to lower case, every other character than a letter is a
blank, runs of blanks are one. All 1-, 2- and 3-grams of a document are hashed
into ``BUCKETS`` counters. Fitting sums the counters of all labelled rows by
language: each task adds up its own rows and sends one row per language and
non-empty bucket. Scoring looks the n-grams up in the log-probability matrix,
a slice of documents at a time.

The matrix (languages x BUCKETS floats) is broadcast in blocks of at most
``BLOCK_LANGS`` languages; with more languages the documents pass block after
block, carrying the best language and the log of the summed likelihoods.

Defined results: bytes that are no UTF-8 are no letters, in their own text
only; null text and text without a letter is ``und`` with score 0;
rows without language do not train; without any training row every document is
``und``; equal likelihoods go to the smaller language name; repeated rows give
repeated results; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import tokens as tk
from sluice.llm.store import materialise

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
BLOCK_LANGS = 256
UNKNOWN = "und"
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)

_TABLES: dict[str, np.ndarray] = {}


def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, folded code point) of every code point."""
    if not _TABLES:
        n = 0x110000
        letter = np.fromiter((chr(i).isalpha() for i in range(n)), dtype=bool, count=n)
        fold = np.arange(n, dtype=np.uint32)
        for i in np.flatnonzero(letter).tolist():
            low = chr(i).lower()
            if len(low) == 1:
                fold[i] = ord(low)
        fold[~letter] = 0x20
        _TABLES["letter"], _TABLES["fold"] = letter, fold
    return _TABLES["letter"], _TABLES["fold"]


def gram_slices(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list]]:
    """Per slice of documents: first row, number of rows, whether each has a
    letter, and per n-gram order (document, bucket) of each n-gram."""
    letter, fold = char_tables()
    raw, off = tk.column_bytes(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + tk.SLICE_BYTES, "right")) - 1))
        code, size = code_points(raw[off[i]:off[j]], off[i:j + 1] - off[i])
        doc = np.repeat(np.arange(j - i), size)
        has = np.zeros(j - i, dtype=bool)
        has[doc[letter[code]]] = True
        c = fold[code]
        blank = c == 0x20
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1] & (doc[1:] == doc[:-1]))
        c, doc = c[keep], doc[keep]
        found = []
        for k in ORDERS:
            m = len(c) - k + 1
            if m <= 0:
                continue
            h = np.full(m, k, dtype=np.uint32)
            for t in range(k):
                h += c[t:m + t] * _MULT[t]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            inside = doc[:m] == doc[k - 1:]
            found.append((doc[:m][inside], (h[inside] & np.uint32(BUCKETS - 1)).astype(np.int64)))
        yield i, j - i, has, found
        i = j


def code_points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of consecutive texts, number of each text). Bytes that are
    no UTF-8 are read as U+FFFD in their own text, whatever stands beside it."""
    def points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)
    head = off[:-1][np.diff(off) > 0]
    if not ((buf[head] & 0xC0) == 0x80).any():      # else a character would cross two texts
        try:
            code = points(buf.tobytes().decode())
            return code, np.diff(np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[off])
        except UnicodeDecodeError:
            pass
    texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    return points("".join(texts)), np.array([len(t) for t in texts], dtype=np.int64)


def gram_counts(train: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over all rows; bucket -1 counts documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            which = np.array([number[x] for x in langs], dtype=np.int64)
            add = np.zeros(len(names) * (BUCKETS + 1), dtype=np.int64)
            np.add.at(add, which * (BUCKETS + 1) + BUCKETS, 1)
            for first, _, _, found in gram_slices(b.column(0)):
                for doc, bucket in found:
                    add += np.bincount(which[first + doc] * (BUCKETS + 1) + bucket,
                                       minlength=len(add))
            for x, i in number.items():
                part = add[i * (BUCKETS + 1):(i + 1) * (BUCKETS + 1)]
                total[x] = total[x] + part if x in total else part
        for x in sorted(total):
            at = np.flatnonzero(total[x])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(at), pa.string()),
                 pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)),
                 pa.array(total[x][at])], names=["lang", "bucket", "n"])
    rows = train.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return (rows.mapInArrow(run, "lang string, bucket int, n bigint")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


class Model:
    """Log-probability matrix of a block of languages."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, all_docs: float):
        self.langs = langs
        p = counts + SMOOTHING
        self.logp = np.ascontiguousarray((np.log(p) - np.log(p.sum(axis=1, keepdims=True)))
                                         .T.astype(np.float32))       # bucket x language
        self.prior = np.log(docs / all_docs)


def fit(train: DataFrame, text: str = "text", lang: str = "lang",
        block_langs: int = BLOCK_LANGS) -> list[Model]:
    """Naive Bayes over all rows of ``train`` that have a language."""
    counts = gram_counts(train.filter(F.col(lang).isNotNull()), text, lang)
    # one row per language and bucket; read a block of languages at a time
    counts = materialise(counts, "langid-counts")
    sizes = {r[0]: r[1] for r in counts.filter("bucket = -1").select("lang", "n").collect()}
    langs = sorted(sizes)
    total = float(sum(sizes.values()))
    models = []
    for i in range(0, len(langs), block_langs):
        block = langs[i:i + block_langs]
        m = np.zeros((len(block), BUCKETS))
        rows = counts.filter(F.col("bucket") >= 0).filter(F.col("lang").isin(block)).toPandas()
        place = {x: k for k, x in enumerate(block)}
        m[rows["lang"].map(place).to_numpy(dtype=np.int64), rows["bucket"].to_numpy()] = rows["n"]
        models.append(Model(block, m, np.array([sizes[x] for x in block], dtype=float), total))
    return models


def predict(docs: DataFrame, models: list[Model], *, keep: list[str] | None = None,
            text_col: str = "text") -> DataFrame:
    """Columns ``keep`` (default: all), then lang_pred and score, the posterior
    of the predicted language. Columns of these names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    text, best, top, every = names = tk.unused(keep, "text", "best", "top", "every")
    sc = docs.sparkSession.sparkContext
    out = docs.select(*keep, F.col(text_col).alias(text), F.lit(None).cast("string").alias(best),
                      F.lit(float("-inf")).alias(top), F.lit(float("-inf")).alias(every))
    schema = out.schema
    for m in models:
        out = out.mapInArrow(_scorer(sc.broadcast(m), names), schema)
    known = F.col(best).isNotNull()
    return out.select(*keep, F.when(known, F.col(best)).otherwise(UNKNOWN).alias("lang_pred"),
                      F.when(known, F.least(F.exp(F.col(top) - F.col(every)), F.lit(1.0)))
                      .otherwise(0.0).alias("score"))


def _scorer(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts, best, top, every = [b.column(b.num_columns - len(names) + i) for i in range(len(names))]
            best = best.to_pylist()
            top, every = [x.to_numpy(zero_copy_only=False).copy() for x in (top, every)]
            for first, n, has, found in gram_slices(texts):
                ll = np.tile(m.prior, (n, 1))
                for doc, bucket in found:
                    for k in range(len(m.langs)):
                        ll[:, k] += np.bincount(doc, weights=m.logp[bucket, k], minlength=n)
                k = ll.argmax(axis=1)
                high = ll[np.arange(n), k]
                lse = high + np.log(np.exp(ll - high[:, None]).sum(axis=1))
                rows = slice(first, first + n)
                for d in np.flatnonzero(has & (high > top[rows])).tolist():
                    best[first + d] = m.langs[k[d]]
                    top[first + d] = high[d]
                every[rows] = np.logaddexp(every[rows], lse)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-3], pa.array(best, pa.string()), pa.array(top), pa.array(every)],
                names=b.schema.names)
    return run


def crc_remainder(id_col: str, n: int) -> Column:
    """crc32 of an id as text, modulo ``n``; a null id reads as empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of a documents table, learned from
    its rows outside the held-out third."""
    held = crc_remainder("doc_id", 3) == 1
    models = fit(docs.filter(~held).select("text", "lang"))
    return predict(docs.withColumn("held_out", held), models, keep=["doc_id", "held_out"])
