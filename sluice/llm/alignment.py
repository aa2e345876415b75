"""Alignment of two tokenizers over the same text, in bytes.

A text with a space before it is encoded by a byte-level file of ``tokenizers``
(A) and, without that space, by a ``sentencepiece`` model that adds it (B). The
character offsets of A and the spans of B's pieces are coarse cuts: tokens that
share a character, and B's byte-fallback pieces, have no cut of their own.
Those are refined with the tokens' decoded bytes, and the bytes of all tokens
are held against the text.

Byte offsets where a token of A and one of B end cut both into groups. Every
end of either is the end of exactly one overlap of a token of A and one of B, so
the overlaps (links) are the merged ends.

Both tokenizers cut before a space that follows a character that is no white
space, whatever stands around it (A by its pattern, B because no piece has a
space after another character: ``Aligner`` looks this up in the vocabulary).
So a text is aligned stretch by stretch between such cuts, and a stretch that
was seen before is looked up in a bounded dictionary.

A first pass over the documents writes ids, groups and links; the links of an
id pair are summed over the corpus; a second pass over the written links adds
up what the counts say. The count table is broadcast if it has at most
``MAX_BROADCAST_PAIRS`` rows (12 bytes each), else it is joined.

Defined results: null and empty texts, texts that are no UTF-8 and texts whose
tokens' bytes differ from the text (one with U+2581, which B writes as a space)
have no tokens: zeros and ''. Strings of special tokens are plain text. A null
document id is kept; repeated rows count as often as they stand; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import tokens as tk
from sluice.llm.store import materialise
from sluice.llm.word_bpe import byte_symbols

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CACHED = 200_000                # stretches kept by a Python worker
CACHED_LINKS = 1 << 22          # links of them
BLOCK = 1 << 14                 # stretches aligned at a time
SLICE_BYTES = 1 << 20           # text of documents at a time
CACHED_CHARS = 64               # a longer one is not kept
RUN = 64                        # stretches that are encoded as one text
MAX_BROADCAST_PAIRS = 1 << 22
PARTIAL_PAIRS = 1 << 22         # id pairs that a counting task holds at a time
PART_BITS = 33
SPACE = "▁"                # B's sign for a space
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
LOOSE = re.compile(r"\s ")     # a cut of ' '.split that is none of ours


class Vocabulary:
    """Decoded bytes of every id: lengths, and one buffer with offsets."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.bytes = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        upto = np.cumsum(n)
        return self.bytes[np.arange(upto[-1] if len(n) else 0) + np.repeat(self.at[ids] - upto + n, n)]


class Aligner:
    def __init__(self, file_a: str, file_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs the tasks
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=file_b)
        plain = {c: b for b, c in enumerate(byte_symbols())}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.vocab_a = Vocabulary([bytes(plain[c] for c in x) if all(c in plain for c in x) else x.encode()
                                   for x in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.fallback = np.array([bool(BYTE.fullmatch(p)) for p in pieces])
        self.vocab_b = Vocabulary([bytes([int(p[3:5], 16)]) if f else p.replace(SPACE, " ").encode()
                                   for p, f in zip(pieces, self.fallback.tolist())])
        self.wide = max(len(names), len(pieces)) > 1 << 16
        self.shift = np.uint64(32) if self.wide else np.uint32(16)
        self.key = np.uint64 if self.wide else np.uint32
        # what an id adds to a group's text, open or closing it
        self.words = np.array([f"{i}{c}".encode() for n, ends in ((len(names), ",|"), (len(pieces), ",;"))
                               for i in range(n) for c in ends], dtype=object)
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.text: list[bytes] = []                 # the groups; b"" where the bytes differ
        self.n_a, self.n_b, self.n_groups = array("q"), array("q"), array("q")
        self.uses = np.zeros(1 << 16, np.int64)      # of each stretch; grows by doubling, like
        self.links = np.zeros(1 << 16, self.key)
        self.link_ends = array("q", [0])

    def make_room(self) -> None:
        """Forget the stretches that were used least, at least half of them."""
        uses = self.uses[:len(self.text)]
        least = max(2, int(np.partition(uses, len(uses) // 2)[len(uses) // 2]) + 1)
        kept = np.flatnonzero(uses >= least)
        code, text, ends, links = self.code, self.text, np.array(self.link_ends), self.links
        counts = [np.array(x)[kept] for x in (self.n_a, self.n_b, self.n_groups)]
        size = ends[kept + 1] - ends[kept]
        upto = np.cumsum(size)
        place = np.arange(upto[-1] if len(kept) else 0) + np.repeat(ends[kept] - upto + size, size)
        self.forget()
        new = np.full(len(text), -1)
        new[kept] = np.arange(len(kept))
        new = new.tolist()
        self.code = {x: new[c] for x, c in code.items() if new[c] >= 0}
        self.text = [text[i] for i in kept.tolist()]
        for mine, n in zip((self.n_a, self.n_b, self.n_groups), counts):
            mine.extend(n.tolist())
        self.link_ends.extend(upto.tolist())
        self.links = np.concatenate((links[place], self.links))
        self.uses = np.concatenate((uses[kept] // 2, self.uses))

    # -- runs of text ---------------------------------------------------------
    def ends_a(self, runs: list[str], chars: np.ndarray, char_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte ends) of A over the runs, which start at ``chars``:
        character offsets, and decoded bytes where tokens share a character."""
        found = self.a.encode_batch(runs, add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(e.ids for e in found)), dtype=np.int64)
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)),
                            dtype=np.int64, count=2 * len(ids))
        shift = np.repeat(chars, [len(e) for e in found])
        begin, end = spans[::2] + shift, spans[1::2] + shift
        shared = np.append(begin[1:] < end[:-1], False)[:len(ids)]
        return ids, refine(char_byte[end], shared, self.vocab_a.size[ids])

    def ends_b(self, runs: list[str], chars: np.ndarray, char_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte ends) of B over the runs, each without its first space:
        spans of the pieces, and decoded bytes for byte fallback."""
        found = [p.pieces for p in self.b.encode([x[1:] for x in runs], return_type="proto", num_threads=1)]
        sizes = np.array([len(p) for p in found], dtype=np.int64)
        both = np.fromiter(chain.from_iterable([(p.id, p.end) for f in found for p in f]), dtype=np.int64,
                           count=2 * int(sizes.sum()))
        ids, ends = both[::2], both[1::2] + 1
        last = ends[(np.cumsum(sizes) - 1)[sizes > 0]]
        if (last == np.array([len(x) for x in runs])[sizes > 0]).all():        # spans in characters
            ends = char_byte[ends + np.repeat(chars, sizes)]
        else:
            ends = ends + np.repeat(char_byte[chars], sizes)
        return ids, refine(ends, self.fallback[ids], self.vocab_b.size[ids])

    def align(self, stretches: list[str]) -> bool:
        """Align stretches that follow each other in one text and remember
        them. False, and nothing remembered, if the bytes differ."""
        runs = ["".join(stretches[i:i + RUN]) for i in range(0, len(stretches), RUN)]
        s = "".join(runs)
        raw = np.frombuffer(s.encode(), dtype=np.uint8)
        width = np.ones(len(s), np.int64) if len(raw) == len(s) else np.diff(np.append(
            np.flatnonzero((raw & 0xC0) != 0x80), len(raw)))
        char_byte = np.concatenate(([0], np.cumsum(width)))
        chars = np.cumsum([0, *map(len, runs[:-1])])
        ids_a, end_a = self.ends_a(runs, chars, char_byte)
        ids_b, end_b = self.ends_b(runs, chars, char_byte)
        for ids, ends, v in ((ids_a, end_a, self.vocab_a), (ids_b, end_b, self.vocab_b)):
            got = v.join(ids)
            if len(got) != len(raw) or not (got == raw).all() or not (np.cumsum(v.size[ids]) == ends).all():
                return False
        stop = char_byte[np.cumsum([len(x) for x in stretches])]
        is_b = np.zeros(len(raw) + 1, dtype=bool)
        is_b[end_b] = True
        shut_a = is_b[end_a]
        common = end_a[shut_a]
        shut_b = np.zeros(len(raw) + 1, dtype=bool)
        shut_b[common] = True
        shut_b = shut_b[end_b]
        if not np.isin(stop, common).all():
            return False
        either = is_b.copy()
        either[end_a] = True
        merged = np.flatnonzero(either)
        links = ((ids_a[np.searchsorted(end_a, merged)].astype(self.key) << self.shift)
                 | ids_b[np.searchsorted(end_b, merged)].astype(self.key))
        # the groups' text: ids of A in a group, then those of B
        upto_a = np.searchsorted(end_a, common, "right")
        upto_b = np.searchsorted(end_b, common, "right")
        size_a, size_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        word = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        word[np.arange(len(ids_a)) + np.repeat(upto_b - size_b, size_a)] = 2 * ids_a + shut_a
        word[np.arange(len(ids_b)) + np.repeat(upto_a, size_b)] = 2 * (len(self.vocab_a.size) + ids_b) + shut_b
        words = self.words[word].tolist()
        per = [np.searchsorted(e, stop, "right") for e in (end_a, end_b, common, merged)]
        cut = (per[0] + per[1]).tolist()
        at = 0
        for x, e in zip(stretches, cut):
            self.code[x] = len(self.text)
            self.text.append(b"".join(words[at:e]))
            at = e
        for store, p in zip((self.n_a, self.n_b, self.n_groups), per):
            store.extend(np.diff(p, prepend=0).tolist())
        at = self.link_ends[-1]
        if at + len(links) > len(self.links):
            self.links = np.concatenate((self.links, np.zeros(max(len(links), len(self.links)), self.key)))
        self.links[at:at + len(links)] = links
        self.link_ends.extend((at + per[3]).tolist())
        return True

    def unknown(self, stretch: str) -> None:
        """Remember a stretch without tokens."""
        self.code[stretch] = len(self.text)
        self.text.append(b"")
        for store in (self.n_a, self.n_b, self.n_groups):
            store.append(0)
        self.link_ends.append(self.link_ends[-1])

    def learn(self, stretches: list[str]) -> None:
        joined = [x for x in stretches if SPACE not in x and not x[-1].isspace()]
        for i in range(0, len(joined), BLOCK):
            block = joined[i:i + BLOCK]
            if not self.align(block):
                for x in block:
                    if not self.align([x]):
                        self.unknown(x)
        for x in stretches:
            if SPACE in x or (x[-1].isspace() and not self.align([x])):
                self.unknown(x)

    # -- documents ------------------------------------------------------------
    def cut(self, text: str) -> list[str]:
        """The stretches of a space and ``text``."""
        if not self.cuts:
            return [" " + text]
        found = [" " + x for x in text.split(" ")]
        if not (text[0].isspace() or text[-1].isspace() or LOOSE.search(text)):
            return found
        out: list[str] = []
        for x in found:
            if out and out[-1][-1].isspace():
                out[-1] += x
            else:
                out.append(x)
        if len(out) > 1 and out[-1].isspace():
            last = out.pop()
            out[-1] += last
        return out

    def documents(self, texts: list[str | None]):
        """Per text: n_a, n_b, n_groups, digest of the groups, links."""
        if len(self.code) > CACHED or self.link_ends[-1] > CACHED_LINKS:
            self.make_room()
        cuts = [self.cut(t) if t else [] for t in texts]
        new = {x for c in cuts for x in c}.difference(self.code)
        if new:
            self.learn(list(new))
        sums = np.stack([np.array(x) for x in (self.n_a, self.n_b, self.n_groups)])
        ends = np.array(self.link_ends)
        if len(self.text) > len(self.uses):
            self.uses = np.concatenate((self.uses, np.zeros(max(len(self.text), len(self.uses)), np.int64)))
        for c in cuts:
            at = [self.code[x] for x in c]
            groups = [self.text[i] for i in at]
            if not at or not all(groups):
                yield 0, 0, 0, "", b""
                continue
            k = np.array(at)
            np.add.at(self.uses, k, 1)
            n = ends[k + 1] - ends[k]
            upto = np.cumsum(n)
            links = self.links[np.arange(upto[-1]) + np.repeat(ends[k] - upto + n, n)]
            n_a, n_b, n_g = sums[:, k].sum(axis=1).tolist()
            yield n_a, n_b, n_g, hashlib.sha256(b"".join(groups)[:-1]).hexdigest(), links.tobytes()
        for x in [x for x in new if len(x) > CACHED_CHARS]:
            del self.code[x]


def refine(ends: np.ndarray, open_: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Coarse ends, and for every token without a cut of its own the end of the
    token before plus its decoded bytes."""
    if not open_.any():
        return ends
    run = np.cumsum(size)
    known = np.where(~open_, np.arange(len(ends)), -1)
    last = np.maximum.accumulate(known)             # the last coarse cut up to here
    base = np.where(last >= 0, ends[last] - run[last], 0)
    return np.where(open_, base + run, ends)


_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(file_a: str, file_b: str) -> Aligner:
    """The aligner of two files of ``public_tokenizers`` (or of two paths),
    once for each Python worker."""
    if (file_a, file_b) not in _LOADED:
        import public_tokenizers
        _LOADED[file_a, file_b] = Aligner(*[f if os.path.isabs(f) else public_tokenizers.path(f)
                                            for f in (file_a, file_b)])
    return _LOADED[file_a, file_b]


def slices(col: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts), about ``SLICE_BYTES`` at a time; None for bytes that
    are no UTF-8. Null reads as empty."""
    raw, off = tk.column_bytes(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1))
        texts: list[str | None] = []
        for a, b in zip(off[i:j].tolist(), off[i + 1:j + 1].tolist()):
            try:
                texts.append(raw[a:b].tobytes().decode())
            except UnicodeDecodeError:
                texts.append(None)
        yield i, texts
        i = j


def aligned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and ``links``
    (one number per link: id of A, then id of B) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << PART_BITS
        aligner = loaded(file_a, file_b)
        width = np.dtype(aligner.key).itemsize
        made = 0
        for b in batches:
            for first, texts in slices(b.column(1)):
                n_a, n_b, n_g, sha, links = map(list, zip(*aligner.documents(texts)))
                k = len(texts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(made, made + k) + part), b.column(0).slice(first, k),
                    pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_g, pa.int64()),
                    pa.array([len(x) // width for x in links], pa.int64()), pa.array(sha, pa.string()),
                    pa.array(links, pa.binary())],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
                made += k
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
             "groups_sha256 string, links binary")


def keys_of(links: bytes, n: int) -> np.ndarray:
    """The links as 64-bit keys: id of A in the upper half, id of B below."""
    if not n:
        return np.zeros(0, np.int64)
    if len(links) == 8 * n:
        return np.frombuffer(links, np.int64)
    x = np.frombuffer(links, np.uint32).astype(np.int64)
    return (x >> 16 << 32) | (x & 0xFFFF)


def pair_counts(rows: DataFrame, partial: int = PARTIAL_PAIRS) -> DataFrame:
    """(pair, n, best): links that hold an id pair, corpus-wide, and whether no
    other pair of its B id has more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])
        for b in batches:
            got = [keys_of(x, n) for x, n in zip(b.column(1).to_pylist(), b.column(0).to_pylist())]
            if got:
                k, c = np.unique(np.concatenate(got), return_counts=True)
                every, place = np.unique(np.concatenate((keys, k)), return_inverse=True)
                counts = np.bincount(place, np.concatenate((counts, c)), len(every)).astype(np.int64)
                keys = every
            if len(keys) > partial:
                yield out()
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys):
            yield out()
    pairs = (rows.select("n_links", "links").mapInArrow(run, "pair bigint, n bigint")
             .groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    pairs = materialise(pairs.withColumn("b", b), "alignment-pairs")
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))
    return pairs.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def scored_broadcast(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """n_best and count_sum of every row, from a broadcast count table."""
    table = counts.toPandas().sort_values("pair")
    shared = rows.sparkSession.sparkContext.broadcast(
        (table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))
    kept = [c for c in rows.columns if c not in ("row", "links")]
    frame = (rows.select(*kept, F.lit(0).cast("bigint").alias("n_best"), F.lit(0).cast("bigint").alias("count_sum"),
                         "links"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        at = kept.index("n_links")
        for b in batches:
            size = np.array(b.column(at).to_pylist(), dtype=np.int64)
            got = [keys_of(x, k) for x, k in zip(b.column(b.num_columns - 1).to_pylist(), size.tolist())]
            place = np.searchsorted(pair, np.concatenate(got) if got else np.zeros(0, np.int64))
            stop = np.cumsum(size)
            sums = [np.diff(np.concatenate(([0], np.cumsum(v[place])))[np.concatenate(([0], stop))])
                    for v in (best.astype(np.int64), n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], *[pa.array(v) for v in sums]],
                                             names=[*kept, "n_best", "count_sum"])
    return frame.mapInArrow(run, frame.drop("links").schema)


def scored_join(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join: one row per document and id pair, pre-aggregated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                k, c = np.unique(keys_of(x, n), return_counts=True)
                if len(k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), row, np.int64)), pa.array(k), pa.array(c.astype(np.int64))],
                        names=["row", "pair", "m"])
    links = rows.select("row", "n_links", "links").mapInArrow(run, "row bigint, pair bigint, m bigint")
    sums = (links.join(counts, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("m") * F.col("n")).alias("count_sum")))
    none = F.lit(0).cast("bigint")
    return (rows.drop("links").join(sums, "row", "left")
            .withColumn("n_best", F.coalesce("n_best", none)).withColumn("count_sum", F.coalesce("count_sum", none))
            .drop("row"))


def align(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", file_a: str = FILE_A,
          file_b: str = FILE_B, max_broadcast: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    rows = materialise(aligned(docs, id_col=id_col, text_col=text_col, file_a=file_a, file_b=file_b),
                       "alignment-rows")
    counts = materialise(pair_counts(rows), "alignment-counts")
    score = scored_broadcast if counts.count() <= max_broadcast else scored_join
    return score(rows, counts)
