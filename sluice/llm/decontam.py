"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are the runs of ASCII letters, digits and code points above 0x7F after
lower-casing A-Z. Every window of ``n`` consecutive words of an item is a test
n-gram; an item of fewer words, but not none, is one shorter n-gram. Documents
are scanned in one narrow pass without a shuffle: rolling window hashes are
looked up in a bitmap, survivors in the hash set, and each hit is verified on
the words themselves.

The benchmark's words are measured first. Up to ``block_bytes`` they travel
as one broadcast of about ten times that size in memory (``Grams``); a larger
benchmark is cut by item into blocks of at most about that size and the
documents pass block after block, ``CHAIN`` of them in a task and then through
a written table, so neither a broadcast nor a task's memory grows with the data.

Defined results: null text has no words and no hits; null item text gives no
n-gram; a null item id reads as the empty string; repeated items and rows give
repeated equal results; an empty benchmark flags nothing; other columns of
either input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import tokens as tk
from sluice.llm.store import materialise

WINDOW = 10
BLOCK_BYTES = 4 << 20
CHAIN = 4
SPANS = "array<struct<first:bigint,last:bigint>>"


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str,
                     block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The benchmark as frames (item, text) of at most about ``block_bytes``."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    if n == 1:
        return [items]
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [items.filter(block == i) for i in range(n)]


@dataclass
class Grams:
    """Test n-grams of one length in hash order: entry i has the words
    ``words[lo[i]:hi[i]]`` and the items ``owner[first[i]:first[i + 1]]``.
    Different n-grams of one hash are neighbours."""

    hashes: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    bits: int

    def bitmap(self) -> np.ndarray:
        m = np.zeros(1 << self.bits, dtype=bool)
        m[self.hashes >> np.uint64(64 - self.bits)] = True
        return m


class TestGrams:
    """Hash set of one block: the words of all items once, and per n-gram
    length the ``Grams``, about 60 bytes for each word of the block."""

    __test__ = False        # not a pytest class

    def __init__(self, rows: list[tuple[str, str]], n: int):
        self.items = sorted({r[0] for r in rows})
        place = {x: i for i, x in enumerate(self.items)}
        words = bytearray()
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for item, text in rows:
            for s in tk.slices(pa.array([text]), tk.NON_ALNUM, tk.LOWER):
                k = min(n, len(s))
                if not k:
                    continue
                own = s.words_of(0, len(s))
                stop = len(words) + np.cumsum([len(w) + 1 for w in own]) - 1
                start = stop - np.array([len(w) for w in own])
                words += b" ".join(own) + b" "
                h = tk.grams(s.hashes(), k)[:len(own) - k + 1]
                found.setdefault(k, []).append(
                    (h, start[:len(h)], stop[k - 1:], np.full(len(h), place[item], np.int32)))
        self.words = bytes(words)
        self.grams = {k: self._grams(*map(np.concatenate, zip(*v))) for k, v in found.items()}

    def _grams(self, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> Grams:
        order = np.lexsort((item, h))
        h, lo, hi, item = h[order], lo[order], hi[order], item[order]
        entry = np.append(True, h[1:] != h[:-1])
        odd = [i for i in np.flatnonzero(~entry).tolist()       # equal hashes, other words
               if self.words[lo[i]:hi[i]] != self.words[lo[i - 1]:hi[i - 1]]]
        entry[odd] = True
        number = np.cumsum(entry) - 1
        once = entry | np.append(True, item[1:] != item[:-1])   # an item counts once
        item, number = item[once], number[once]
        first = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number))
        return Grams(h[entry], lo[entry], hi[entry], first, item, max(16, int(8 * entry.sum()).bit_length()))


def find_hits(s: tk.Slice, tests: TestGrams, maps: dict[int, np.ndarray]):
    """(word mask of hits, {document: item numbers}) of one slice."""
    edge = np.zeros(len(s) + 1, dtype=np.int32)
    found: dict[int, set[int]] = {}
    h = s.hashes()
    room = s.room()
    for k, known in tests.grams.items():
        g = tk.grams(h, k)
        at = np.flatnonzero(maps[k][g >> np.uint64(64 - known.bits)])
        at = at[room[at] >= k]
        lo = np.searchsorted(known.hashes, g[at])
        hi = np.searchsorted(known.hashes, g[at], "right")
        some = hi > lo
        for i, j, end in zip(at[some].tolist(), lo[some].tolist(), hi[some].tolist()):
            words = b" ".join(s.words_of(i, i + k))
            for e in range(j, end):
                if tests.words[known.lo[e]:known.hi[e]] == words:       # verified on the words
                    edge[i] += 1
                    edge[i + k] -= 1
                    found.setdefault(int(s.doc[i]), set()).update(
                        known.owner[known.first[e]:known.first[e + 1]].tolist())
    return np.cumsum(edge[:-1]) > 0, found


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
         keep: list[str] | None = None, item_col: str = "item_id", item_text: str = "text",
         n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hits of every document: columns ``keep`` (default: all of ``docs``),
    then ``n_words``, ``hit_words``, ``hit_items`` (sorted item ids) and
    ``hit_spans`` (first and last hit word of each run, from 0).

    Columns of ``docs`` with one of these four names are replaced.
    """
    new = ["n_words", "hit_words", "hit_items", "hit_spans"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    sc = docs.sparkSession.sparkContext
    body, = tk.unused([*keep, *new], "body")
    out = docs.select(*keep, F.col(text_col).alias(body),
                      F.lit(0).cast("bigint").alias("n_words"),
                      F.lit(0).cast("bigint").alias("hit_words"),
                      F.array().cast("array<string>").alias("hit_items"),
                      F.array().cast(SPANS).alias("hit_spans"))
    schema = out.schema
    for i, block in enumerate(benchmark_blocks(benchmark, item_col, item_text, block_bytes)):
        if i and i % CHAIN == 0:
            out = materialise(out, "decontam-blocks")
        rows = [(r[0], r[1]) for r in block.collect()]      # bounded: at most a block
        out = out.mapInArrow(_scanner(sc.broadcast(TestGrams(rows, n)), body), schema)
    return out.drop(body)


def _scanner(shared, body: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        maps = {k: g.bitmap() for k, g in grams.grams.items()}
        for b in batches:
            text = b.column(b.schema.get_field_index(body))
            old_items = b.column(b.schema.get_field_index("hit_items"))
            old_spans = b.column(b.schema.get_field_index("hit_spans"))
            n_words = np.zeros(b.num_rows, dtype=np.int64)
            n_hits = np.zeros(b.num_rows, dtype=np.int64)
            items: dict[int, list[str]] = {}
            spans: dict[int, list[dict]] = {}
            for s in tk.slices(text, tk.NON_ALNUM, tk.LOWER):
                n_words[s.first:s.first + s.n_docs] = s.counts
                hit, found = find_hits(s, grams, maps)
                for d in range(s.n_docs):
                    row = s.first + d
                    before = old_spans[row].as_py() if len(old_spans[row]) else []
                    if d not in found and not before:
                        continue
                    lo, hi = s.word_off[d], s.word_off[d + 1]
                    mask = hit[lo:hi].copy()
                    for r in before:
                        mask[r["first"]:r["last"] + 1] = True
                    step = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
                    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
                    spans[row] = [{"first": int(x), "last": int(y)} for x, y in zip(first, last)]
                    n_hits[row] = int(mask.sum())
                    items[row] = sorted(set(old_items[row].as_py())
                                        | {grams.items[i] for i in found.get(d, ())})
            cols = []
            for f, c in zip(b.schema, b.columns):
                if f.name == "n_words":
                    c = pa.array(n_words)
                elif f.name == "hit_words":
                    c = pa.array(n_hits)
                elif f.name == "hit_items":
                    c = pa.array([items.get(i, []) for i in range(b.num_rows)], f.type)
                elif f.name == "hit_spans":
                    c = pa.array([spans.get(i, []) for i in range(b.num_rows)], f.type)
                cols.append(c)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents without any hit, with their columns."""
    cols = docs.columns
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"),
                         F.col(kw.pop("text_col", "text")).alias("body"))
    return (scan(tagged, benchmark, text_col="body", keep=["row"], **kw)
            .filter(F.col("hit_words") == 0).select("row.*"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of ``scan`` over a documents table (doc_id, text): doc_id,
    n_words, n_hit, n_items, items_sha256 (item ids joined by commas),
    contaminated."""
    hits = scan(docs, benchmark, keep=["doc_id"])
    return hits.select("doc_id", "n_words", F.col("hit_words").alias("n_hit"),
                       F.size("hit_items").cast("bigint").alias("n_items"),
                       F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
                       (F.col("hit_words") > 0).alias("contaminated"))
