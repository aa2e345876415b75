"""Substring de-duplication with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words of one document (words are separated
by 0x20 and 0x09-0x0D). Every word covered by a window whose word sequence
also starts earlier (smaller document id, or the same document and an earlier
start) is removed; windows are judged on the input.

1. Each document is cut into runs of windows that share a minimiser (the
   smallest hash among the window's ``GRAM``-word grams). Equal windows have
   equal minimisers, so a run's minimiser is its shard key. Minimisers of very
   many runs (a common line or passage) are counted first and left out: their
   windows become runs of one window with the hash of the whole window as key,
   so no shard depends on how common a passage is.
2. A window can repeat only if its minimising gram occurs twice. Runs whose
   key occurs once, with the gram once inside, are dropped (a count per key,
   summed before the shuffle, and a join).
3. Equal runs are one: their first place is kept, all windows of the others
   are repeats.
4. The words of first places are cut from the documents and sorted into
   shards by key. A task builds an FM-index (suffix order, BWT, wavelet
   matrix) over at most about ``SHARD_WORDS`` words of whole keys at a time
   and streams the runs' windows through backward search. A window that
   reaches full length with two or more suffixes is repeated; it is reported
   unless it is the earliest of them.
5. Repeated intervals are gathered by document and their words removed.

Only run keys and places are shuffled for every document; the text is
shuffled once, by document.

Defined results: null text has no words; rows that share a document id are
one document (equal places do not count as earlier); null ids are one id, the
smallest; repeated words and lines inside a document count like any other
repeat; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import tokens as tk
from sluice.llm.fm_index import FMIndex
from sluice.llm.store import materialise

WINDOW = 20
GRAM = 6
HOT = 2000              # runs of one minimiser beyond which windows are keyed whole
HOT_LOCAL = 16          # runs of one minimiser in one task that make it a candidate
MAX_HOT = 1 << 20       # bound of the broadcast list (the most frequent)
SHARD_WORDS = 400_000
_U = np.uint64


def sliding_minimum(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        g = np.minimum(g[:-have], g[have:])
        have *= 2
    rest = width - have
    return np.minimum(g[:len(g) - rest], g[rest:]) if rest else g


def window_minimisers(s: tk.Slice, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, minimiser) of every window of a slice."""
    at = np.flatnonzero(s.room() >= WINDOW)
    if not len(at):
        return at, np.zeros(0, dtype=_U)
    return at, sliding_minimum(tk.grams(h, GRAM), WINDOW - GRAM + 1)[at]


def near_repeats(g: np.ndarray) -> np.ndarray:
    """Running number of grams that recur within a window's grams. Occurrences
    inside one run follow each other at most that far apart."""
    again = np.zeros(len(g), dtype=bool)
    for t in range(1, WINDOW - GRAM + 2):
        again[:-t] |= g[:-t] == g[t:]
    return np.concatenate(([0], np.cumsum(again)))


def run_starts(at: np.ndarray, mini: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Indexes where a run begins: another minimiser, a gap, or a window that
    stands (or follows one that stands) alone."""
    new = np.ones(len(at), dtype=bool)
    new[1:] = (mini[1:] != mini[:-1]) | (at[1:] != at[:-1] + 1) | alone[1:] | alone[:-1]
    return np.flatnonzero(new)


def range_hashes(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of ``size`` word hashes from each ``first``."""
    p, q = tk._pow_tables(len(h) + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(h) + 1, dtype=_U)
        np.cumsum(h * p[:len(h)], out=acc[1:])
        return tk.mix((acc[first + size] - acc[first]) * q[first] + size.astype(_U))


def hot_minimisers(docs: DataFrame, text_col: str, hot: int = HOT,
                   hot_local: int = HOT_LOCAL) -> np.ndarray:
    """Sorted minimisers of at least ``hot`` runs. A task reports the
    minimisers of ``hot_local`` of its runs or more; one that no task reports
    has fewer runs than that a task. Which minimisers are listed decides how
    work is spread, not what is found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in batches:
            for s in tk.slices(b.column(0)):
                at, mini = window_minimisers(s, s.hashes())
                seen.append(mini[run_starts(at, mini, np.zeros(len(at), dtype=bool))])
        key, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, _U), return_counts=True)
        many = n >= hot_local
        yield pa.RecordBatch.from_arrays([pa.array(tk.signed(key[many])), pa.array(n[many])],
                                         names=["key", "n"])
    rows = (docs.select(text_col).mapInArrow(run, "key bigint, n bigint")
            .groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= hot)
            .orderBy(F.col("n").desc(), "key").limit(MAX_HOT).select("key").toPandas())
    return np.sort(rows["key"].to_numpy(np.int64).view(_U))


def window_runs(docs: DataFrame, id_col: str, text_col: str, hot: np.ndarray) -> DataFrame:
    """(doc, pos, n, key, seg, whole, times): runs of ``n`` windows from word
    ``pos`` with the hash ``seg`` of their words; ``whole``: keyed by all
    words; ``times``: 2 if the key's gram may occur twice in the run."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys = shared.value
        for b in batches:
            for s in tk.slices(b.column(1)):
                h = s.hashes()
                at, mini = window_minimisers(s, h)
                if not len(at):
                    continue
                alone = np.zeros(len(at), dtype=bool)
                if len(hot_keys):
                    place = np.minimum(np.searchsorted(hot_keys, mini), len(hot_keys) - 1)
                    alone = hot_keys[place] == mini
                i = run_starts(at, mini, alone)
                n = np.diff(np.append(i, len(at)))
                first, whole = at[i], alone[i]
                again = near_repeats(tk.grams(h, GRAM))
                twice = (again[first + n + WINDOW - GRAM] > again[first]) & ~whole
                seg = range_hashes(h, first, n + WINDOW - 1)
                key = mini[i]
                if whole.any():
                    key[whole] = range_hashes(tk.mix(h + _U(1)), first[whole], n[whole] + WINDOW - 1)
                d = s.doc[first]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(s.first + d)),
                     pa.array((first - s.word_off[d]).astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(tk.signed(key)), pa.array(tk.signed(seg)), pa.array(whole),
                     pa.array(1 + twice.astype(np.int64))],
                    names=["doc", "pos", "n", "key", "seg", "whole", "times"])
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType)]
                          + T._parse_datatype_string(
                              "pos int, n int, key bigint, seg bigint, whole boolean, times bigint").fields)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def cut_runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Text of the runs in ``cuts`` of each document of a batch."""
    cuts = b.column(b.schema.get_field_index("cuts"))
    counts = np.diff(cuts.offsets.to_numpy()) if len(cuts) else np.zeros(0, int)
    if cuts.null_count:
        counts = np.where(cuts.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    flat = cuts.flatten()
    pos, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    key, seg = flat.field(2), flat.field(3).to_numpy(zero_copy_only=False).view(_U)
    begin = np.concatenate(([0], np.cumsum(counts)))
    for s in tk.slices(b.column(1)):
        lo, hi = begin[s.first], begin[s.first + s.n_docs]
        if lo == hi:
            continue
        doc = np.repeat(np.arange(s.n_docs), counts[s.first:s.first + s.n_docs])
        first = s.word_off[doc] + pos[lo:hi]
        last = first + n[lo:hi] + WINDOW - 2
        # rows that share an id may have other texts: only the run's own words
        rows = np.flatnonzero(last < s.word_off[doc + 1])
        rows = rows[range_hashes(s.hashes(), first[rows], last[rows] - first[rows] + 1)
                    == seg[lo:hi][rows]]
        words = [s.buf[x:y].tobytes() for x, y in
                 zip(s.starts[first[rows]].tolist(), s.ends[last[rows]].tolist())]
        take = pa.array(rows + lo)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(s.first + doc[rows])), flat.field(0).take(take),
             flat.field(1).take(take), key.take(take), pa.array(words, pa.binary())],
            names=["doc", "pos", "n", "key", "words"])


def search_shard(rows: pa.Table) -> pa.RecordBatch:
    """Index the runs of a shard, sorted by (key, doc, pos), and report the
    repeated intervals of their windows as word ranges. Repeated rows of one
    place are one run."""
    rows = rows.combine_chunks()
    again = np.ones(rows.num_rows, dtype=bool)
    again[:1] = False
    for name in ("key", "pos", "doc"):
        c = rows[name]
        same = pc.fill_null(pc.equal(c.slice(1), c.slice(0, len(c) - 1)), False).to_numpy() \
            | (pc.is_null(c.slice(1)).to_numpy() & pc.is_null(c.slice(0, len(c) - 1)).to_numpy())
        again[1:] &= same
    text = rows["words"]
    again[again] = [text[i].as_py() == text[i - 1].as_py() for i in np.flatnonzero(again).tolist()]
    rows = rows.filter(pa.array(~again)).combine_chunks()
    s = next(iter(tk.slices(tk.as_text(rows["words"].combine_chunks()), limit=1 << 62)))
    n = rows["n"].to_numpy().astype(np.int64)
    symbols = np.unique(s.hashes(), return_inverse=True)[1] + 1       # 0 separates runs
    text = np.zeros(len(s) + s.n_docs, dtype=np.int64)
    text[np.arange(len(s)) + s.doc] = symbols
    index = FMIndex(text, int(symbols.max()) + 1 if len(symbols) else 1)
    run_at = s.word_off[:-1] + np.arange(s.n_docs)
    run = np.repeat(np.arange(s.n_docs), n)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = run_at[run] + offset
    found, lo, hi = index.matching(at, WINDOW)
    found = np.sort(found[index.earliest(lo, hi) < at[found]])
    gap = np.ones(len(found) + 1, dtype=bool)
    gap[1:-1] = (np.diff(found) != 1) | (run[found[1:]] != run[found[:-1]])
    first, last = found[gap[:-1]], found[gap[1:]] if len(found) else found
    pos = rows["pos"].to_numpy().astype(np.int64)[run[first]]
    return pa.RecordBatch.from_arrays(
        [rows["doc"].combine_chunks().take(pa.array(run[first])),
         pa.array((pos + offset[first]).astype(np.int32)),
         pa.array((pos + offset[last] + WINDOW - 1).astype(np.int32))], names=["doc", "first", "last"])


def search_shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    """Cut the sorted rows of a partition at key boundaries into shards."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        while b.num_rows:
            room = np.cumsum(b.column(2).to_numpy().astype(np.int64) + WINDOW)
            if size + room[-1] <= shard_words:
                held.append(b)
                size += int(room[-1])
                break
            key = b.column(3).to_numpy()
            old = held[-1].column(3)[-1].as_py() if held else None
            begins = np.flatnonzero(np.append(key[:1] != old if held else False, key[1:] != key[:-1]))
            ok = begins[(begins > 0) | bool(held)]
            full = ok[np.concatenate(([0], room))[ok] + size <= shard_words]
            if not len(ok):                     # one key so far: it stays together
                held.append(b)
                size += int(room[-1])
                break
            cut = int(full[-1]) if len(full) else int(ok[0])
            if cut:
                held.append(b.slice(0, cut))
            yield search_shard(pa.Table.from_batches(held))
            held, size, b = [], 0, b.slice(cut)
    if held:
        yield search_shard(pa.Table.from_batches(held))


def document_rows(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """(doc, text, row): ``row`` holds the columns ``carry``."""
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), row.alias("row"))


def repeated_intervals(docs: DataFrame, id_col: str, text_col: str, texts: DataFrame, hot: int = HOT,
                       hot_local: int = HOT_LOCAL, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc, first, last): word ranges covered by repeated windows. ``texts``:
    ``document_rows`` of ``docs``."""
    runs = window_runs(docs, id_col, text_col, hot_minimisers(docs, text_col, hot, hot_local))
    shared = runs.groupBy("key").agg(F.sum("times").alias("t")).filter("t > 1").drop("t")
    runs = materialise(runs.drop("times").join(shared, "key"), "dedup-runs")
    place = F.struct("doc", "pos")
    firsts = materialise(
        runs.groupBy("key", "seg", "whole").agg(F.min(place).alias("p"), F.max("n").alias("n"))
        .select("key", "seg", "whole", "p.doc", "p.pos", "n"), "dedup-firsts")
    cuts = (firsts.filter(~F.col("whole")).groupBy("doc")
            .agg(F.collect_list(F.struct("pos", "n", "key", "seg")).alias("cuts")))
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType)]
                          + T._parse_datatype_string("pos int, n int, key bigint, words binary").fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from cut_runs(b)
    found = (by_document(texts, cuts, "cuts").mapInArrow(cut, schema)
             .repartition("key").sortWithinPartitions("key", "doc", "pos")
             .mapInArrow(lambda batches: search_shards(batches, shard_words), T.StructType(
                 [schema.fields[0]] + T._parse_datatype_string("first int, last int").fields)))
    at = runs.alias("r").join(firsts.alias("f"), (F.col("r.key") == F.col("f.key"))
                              & (F.col("r.seg") == F.col("f.seg")) & (F.col("r.whole") == F.col("f.whole")))
    later = at.filter(~(F.col("r.doc").eqNullSafe(F.col("f.doc")) & (F.col("r.pos") == F.col("f.pos")))) \
        .select("r.doc", F.col("r.pos").alias("first"),
                (F.col("r.pos") + F.col("r.n") + (WINDOW - 2)).alias("last"))
    return found.unionByName(later)


def by_document(texts: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``texts`` (doc, text) with the list column of ``rows``; the text side
    is the same exchange wherever it is joined, and is not sorted."""
    other = rows.select(F.col("doc").alias("__doc"), name).hint("shuffle_hash")
    return texts.join(other, F.col("doc").eqNullSafe(F.col("__doc")), "left").drop("__doc")


def remove_words(b: pa.RecordBatch, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Remove the word ranges ``spans`` of each document of a batch."""
    spans = b.column(b.schema.get_field_index("spans"))
    counts = np.diff(spans.offsets.to_numpy()) if len(spans) else np.zeros(0, int)
    if spans.null_count:
        counts = np.where(spans.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    flat = spans.flatten()
    first, last = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    begin = np.concatenate(([0], np.cumsum(counts)))
    is_text = b.column(1).is_valid().to_numpy(zero_copy_only=False) & with_text
    for s in tk.slices(b.column(1)):
        lo, hi = begin[s.first], begin[s.first + s.n_docs]
        doc = np.repeat(np.arange(s.n_docs), counts[s.first:s.first + s.n_docs])
        edge = np.zeros(len(s) + 1, dtype=np.int64)
        end = np.minimum(s.word_off[doc] + last[lo:hi] + 1, s.word_off[doc + 1])
        start = np.minimum(s.word_off[doc] + first[lo:hi], end)
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
        gone = np.cumsum(edge[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[s.word_off[1:]] - total[s.word_off[:-1]]
        digests, kept = [], []
        for d in range(s.n_docs):
            i, j = s.word_off[d], s.word_off[d + 1]
            whole = s.buf[s.offsets[d]:s.offsets[d + 1]].tobytes()
            if removed[d]:
                keep = np.flatnonzero(~gone[i:j]) + i
                words = [s.buf[x:y].tobytes() for x, y in
                         zip(s.starts[keep].tolist(), s.ends[keep].tolist())]
                if with_text:
                    # a removed word goes with the blanks after it
                    nxt = np.append(s.starts[i + 1:j], s.offsets[d + 1])
                    head = s.buf[s.offsets[d]:s.starts[i]].tobytes()
                    whole = head + b"".join(s.buf[x:y].tobytes() for x, y in
                                            zip(s.starts[keep].tolist(), nxt[keep - i].tolist()))
            else:
                words = whole.split()          # the same separators
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            kept.append(whole if is_text[s.first + d] else None)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).slice(s.first, s.n_docs), b.column(2).slice(s.first, s.n_docs),
             pa.array(s.counts.astype(np.int64)), pa.array(removed.astype(np.int64)),
             pa.array(digests), tk.as_text(pa.array(kept, pa.binary()))],
            names=["doc", "row", "n_words", "n_removed", "kept_sha256", "kept_text"])


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     carry: list[str] | None = None, with_text: bool = True, **limits) -> DataFrame:
    """One row per document: doc (its id), row (a struct of the columns
    ``carry``; null without), n_words, n_removed, kept_sha256 (digest of the
    kept words joined by one blank) and kept_text: the text without the
    removed words, unchanged where nothing is removed (null if not asked
    for). ``limits``: ``hot``, ``hot_local`` and ``shard_words``, which do not
    change results."""
    texts = document_rows(docs, id_col, text_col, carry or [])
    spans = (repeated_intervals(docs, id_col, text_col, texts, **limits).groupBy("doc")
             .agg(F.collect_list(F.struct("first", "last")).alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from remove_words(b, with_text)
    schema = T.StructType([texts.schema["doc"], texts.schema["row"]]
                          + T._parse_datatype_string("n_words bigint, n_removed bigint, "
                                                     "kept_sha256 string, kept_text string").fields)
    return by_document(texts, spans, "spans").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated words removed from their text; documents
    of which no word is left go. A column ``n_chars`` follows the text; null
    text stays null."""
    cols = docs.columns
    out = dedup_substrings(docs, id_col=id_col, text_col=text_col,
                           carry=[c for c in cols if c not in (id_col, text_col)])
    changed = F.col("n_removed") > 0
    new = {id_col: F.col("doc"), text_col: F.col("kept_text")}
    if "n_chars" in cols:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(kind)).otherwise(F.col("row.n_chars"))
    return (out.filter(~changed | (F.col("n_removed") < F.col("n_words")))
            .select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in cols]))
