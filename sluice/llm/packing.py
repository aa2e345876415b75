"""Packing of token sequences into windows by a non-negative least squares plan.

1. Every document is encoded once (ids, then ``END``). Whole windows are cut
   off its front; the rest has a length class, ``length // UNIT``. The pieces
   are written with their part (the task) and their rank in (part, class).
2. ``combinations`` enumerates shallow combinations of classes that fill the
   window: at most three pieces for a window, or at most four pieces for a
   half, quarter, eighth or sixteenth of it, repeated. ``solve`` finds repeat
   counts by non-negative least squares against the histogram of classes,
   rounds them down and packs the residual histogram greedily, longest class
   first. Histogram and plan have a size bound: there are WINDOW / UNIT classes.
3. The n-th piece of a class takes the n-th place that the plan has for it.
   Lengths in a class differ by up to UNIT - 1, so a full sequence overflows a
   little: its last and longest piece is cut at the window.
4. What no place takes (the cut-off ends, very short pieces, residuals that
   fill no window) is laid end to end, longest class first, and cut at the
   windows. Only the very last sequence can be shorter than the window.

Ranks and running sums are per (class, part); a part is one task's rows, so a
class with a third of all rows is many groups. The ids are written once and
shuffled once (the join with their places).

Defined results: null text is empty text, which has the one id ``END``; a null
document id is kept; repeated rows are packed once each; an empty table gives
no rows; other columns are not read. Which document takes which place depends
on how the scan deals rows to tasks; every id is in exactly one piece anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.store import materialise
from sluice.llm.word_bpe import loaded, text_slices

WINDOW = 4096
UNIT = 16
END = 2
VOCABULARY = "word_bpe_49k.json"
DEPTHS = ((1, 3), (2, 4), (4, 4), (8, 4), (16, 4))    # repeats of a combination, its most pieces
PART_BITS = 33
WIDEN_ROWS = 512        # packed pieces widened at a time: at most 8 MB
PIECES = ("piece bigint, part int, doc_id {id}, start bigint, length int, doc_tokens bigint, "
          "class int, rank bigint, ids binary")


# ---- the plan: a histogram of classes to repeat counts -------------------

def partitions(total: int, depth: int) -> list[tuple[int, ...]]:
    """Ways to write ``total`` as a sum of at most ``depth`` rising parts."""
    def grow(left: int, least: int, depth: int):
        if depth and left >= least:
            yield (left,)
            if depth > 1:
                for a in range(least, left // 2 + 1):
                    for rest in grow(left - a, a, depth - 1):
                        yield (a, *rest)
    return list(grow(total, 1, depth))


def combinations(units: int) -> list[tuple[tuple[int, ...], int]]:
    """(parts in rising order, repeats) of every combination that fills a
    window of ``units`` units."""
    return [(p, times) for times, depth in DEPTHS if units % times == 0
            for p in partitions(units // times, depth)]


def nnls(places: np.ndarray, weights: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |A x - goal| by an active set; column k of A has
    ``weights[k]`` at rows ``places[k]`` (a place equal to the number of rows
    is none)."""
    rows, cols = len(goal), len(places)
    x = np.zeros(cols)
    active: list[int] = []

    known: dict[int, np.ndarray] = {}

    def dense(ks: list[int]) -> np.ndarray:
        for k in ks:
            if k not in known:
                known[k] = np.bincount(places[k], weights[k], rows + 1)[:rows]
        return np.column_stack([known[k] for k in ks])

    tolerance = 1e-9 * max(1.0, float(np.abs(goal).max(initial=0.0)))
    for _ in range(4 * rows):
        residual = goal - (dense(active) @ x[active] if active else 0.0)
        gain = (np.append(residual, 0.0)[places] * weights).sum(axis=1)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if not cols or gain[best] <= tolerance:
            break
        active.append(best)
        while True:
            a = dense(active)
            gram = a.T @ a
            gram[np.diag_indices_from(gram)] *= 1 + 1e-12
            try:
                z = np.linalg.solve(gram, a.T @ goal)
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(a, goal, rcond=None)[0]
            if (z > 0).all():
                x[active] = z
                break
            now = x[active]
            low = z <= 0
            step = float(np.min(now[low] / np.maximum(now[low] - z[low], 1e-300)))
            x[active] = now + step * (z - now)
            gone = [k for k, v, bad in zip(active, x[active], low) if bad and v <= 1e-12]
            x[gone] = 0.0
            active = [k for k in active if k not in set(gone)]
            if not gone or not active:
                break
    return x


def solve(histogram: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Plan of a histogram of classes 0 .. units: (pieces of each class in one
    sequence, number of sequences). Takes no more pieces than there are; class
    0 is never placed."""
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []
    if left[units]:
        plan.append(({units: 1}, int(left[units])))
        left[units] = 0
    left[0] = 0

    def take(pieces: dict[int, int], most: int | None = None) -> None:
        n = min(int(left[g]) // m for g, m in pieces.items())
        n = n if most is None else min(n, most)
        if n > 0:
            plan.append((pieces, n))
            for g, m in pieces.items():
                left[g] -= m * n

    total = int(left.sum())
    if total:
        combos = [c for c in combinations(units) if all(left[g] for g in c[0])]
        if combos:
            deep = max(len(p) for p, _ in combos)
            places = np.array([p + (units + 1,) * (deep - len(p)) for p, _ in combos])
            weights = np.array([[float(times)] * deep for _, times in combos])
            x = nnls(places, weights, left / total) * total
            order = sorted(np.flatnonzero(x >= 1), key=lambda k: (-x[k], k))
            for k in order:
                parts, times = combos[k]
                take({g: parts.count(g) * times for g in parts}, int(x[k]))
    for first in range(units - 1, 0, -1):           # the residual histogram, greedily
        while left[first]:
            pieces, room = {first: 1}, units - first
            while room:
                fits = [g for g in range(min(room, units - 1), 0, -1) if left[g] > pieces.get(g, 0)]
                if not fits:
                    break
                g = fits[0]
                m = min(room // g, int(left[g]) - pieces.get(g, 0))
                pieces[g] = pieces.get(g, 0) + m
                room -= g * m
            if room:
                break                               # fills no window: laid end to end later
            take(pieces)
    return plan


def plan_rows(plan: list[tuple[dict[int, int], int]]) -> tuple[list[tuple], int]:
    """(class, first rank, rank after the last, first sequence, pieces of the
    class in a sequence, position of the first) and the number of sequences.
    In a sequence the classes rise."""
    rows, used, base = [], {}, 0
    for pieces, n in plan:
        at = 0
        for g in sorted(pieces):
            m = pieces[g]
            start = used.get(g, 0)
            rows.append((g, start, start + m * n, base, m, at))
            used[g] = start + m * n
            at += m
        base += n
    return rows, base


# ---- Spark ---------------------------------------------------------------

def encoded(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            vocabulary: str = VOCABULARY, end: int = END, window: int = WINDOW,
            unit: int = UNIT) -> DataFrame:
    """Pieces of every document: whole windows off its front, then the rest.
    ``ids`` holds 16-bit numbers (32-bit where the vocabulary needs them)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        bpe = loaded(vocabulary)
        kind = id_type(bpe.tokenizer.get_vocab_size())
        seen = np.zeros(window // unit + 1, dtype=np.int64)     # pieces of each class so far
        made = 0
        for b in batches:
            for first, texts in text_slices(b.column(1)):
                ids, n = bpe.encode(texts)
                stop = np.cumsum(n)
                ids = np.insert(ids, stop, end).astype(kind)    # one more id after each text
                n = n + 1
                begin = np.cumsum(n) - n
                parts = -(-n // window)
                doc = np.repeat(np.arange(len(n)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(n[doc] - start, window)
                cls = length // unit
                rank = np.empty(len(cls), np.int64)
                by = np.argsort(cls, kind="stable")
                count = np.bincount(cls, minlength=len(seen))
                rank[by] = np.arange(len(cls)) - np.repeat(np.cumsum(count) - count, count)
                rank += seen[cls]
                seen += count
                raw = ids.tobytes()
                lo = (begin[doc] + start) * ids.itemsize
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(made, made + len(doc)) + (part << PART_BITS)),
                    pa.array(np.full(len(doc), part, np.int32)),
                    b.column(0).take(pa.array(first + doc)),
                    pa.array(start), pa.array(length.astype(np.int32)), pa.array(n[doc]),
                    pa.array(cls.astype(np.int32)), pa.array(rank),
                    pa.array([raw[a:a + k] for a, k in zip(lo.tolist(), (length * ids.itemsize).tolist())],
                             pa.binary())],
                    names=["piece", "part", "doc_id", "start", "length", "doc_tokens", "class",
                           "rank", "ids"])
                made += len(doc)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, PIECES.format(id=kind))


def id_type(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def running(rows: DataFrame, value: str, name: str) -> tuple[DataFrame, dict[int, int]]:
    """Sum of ``value`` over the parts before, by (class, part), as ``name``;
    and the sum of each class. A window sees one row per part of its class."""
    sums = materialise(rows.groupBy("class", "part").agg(F.sum(value).alias("v")), f"packing-{name}")
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("class", "part", F.coalesce(F.sum("v").over(before), F.lit(0)).alias(name))
    totals = {r[0]: r[1] for r in sums.groupBy("class").agg(F.sum("v")).collect()}
    return base, totals


def laid_out(pieces: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """(piece, cut, taken, sequence_id, offset): ``taken`` ids of the piece from
    its ``cut``-th on stand in that sequence from that offset on."""
    spark = pieces.sparkSession
    narrow = pieces.select("piece", "part", "class", "rank", F.col("length").cast("bigint").alias("length"))
    base, totals = running(narrow.withColumn("one", F.lit(1).cast("bigint")), "one", "before")
    histogram = np.zeros(window // unit + 1, dtype=np.int64)
    for g, n in totals.items():
        histogram[g] = n
    rows, sequences = plan_rows(solve(histogram))
    plan = spark.createDataFrame(rows, "class int, lo bigint, hi bigint, first bigint, each int, at int")
    n = F.col("rank") + F.col("before")
    placed = (narrow.join(base, ["class", "part"]).select("piece", "part", "class", "length", n.alias("n"))
              .alias("p").join(F.broadcast(plan).alias("q"),
                               F.expr("p.class = q.class AND p.n >= q.lo AND p.n < q.hi"), "left")
              .select("piece", "part", "length", "lo", "each",
                      F.expr("first + (n - lo) div each").alias("sequence_id"),
                      F.expr("at + (n - lo) % each").alias("place")))
    placed = materialise(placed.drop("lo", "each"), "packing-places")
    order = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = materialise(
        placed.filter("sequence_id IS NOT NULL")
        .withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
        .withColumn("taken", F.greatest(F.least(F.col("length"), window - F.col("offset")), F.lit(0)))
        .select("piece", "part", "length", "sequence_id", "offset", "taken"), "packing-full")
    rest = (placed.filter("sequence_id IS NULL").select("piece", "part", F.lit(0).cast("bigint").alias("cut"), "length")
            .unionByName(inside.filter("taken < length")
                         .selectExpr("piece", "part", "taken AS cut", "length - taken AS length"))
            .withColumn("class", (F.col("length") / unit).cast("int")))
    ends = end_to_end(spark, rest, window, sequences)
    return (inside.filter("taken > 0").selectExpr("piece", "0L AS cut", "taken", "sequence_id", "offset")
            .unionByName(ends))


def end_to_end(spark: SparkSession, rest: DataFrame, window: int, first: int) -> DataFrame:
    """The rest in one line, longest class first, cut at the windows."""
    base, totals = running(rest, "length", "before")
    starts, at = [], 0
    for g in sorted(totals, reverse=True):
        starts.append((g, at))
        at += totals[g]
    starts = spark.createDataFrame(starts, "class int, head bigint")
    order = (Window.partitionBy("class", "part").orderBy("piece", "cut")
             .rowsBetween(Window.unboundedPreceding, -1))
    line = (rest.withColumn("inner", F.coalesce(F.sum("length").over(order), F.lit(0)))
            .join(base, ["class", "part"]).join(F.broadcast(starts), "class")
            .withColumn("lo", F.col("head") + F.col("before") + F.col("inner"))
            .withColumn("hi", F.col("lo") + F.col("length")))
    w = F.lit(window).cast("bigint")
    cells = line.select("piece", "cut", "lo", "hi", F.explode(F.expr(
        f"sequence(lo div {window}, (hi - 1) div {window})")).alias("cell"))
    from_, to = F.greatest("lo", F.col("cell") * w), F.least("hi", (F.col("cell") + 1) * w)
    return cells.select("piece", (F.col("cut") + from_ - F.col("lo")).alias("cut"), (to - from_).alias("taken"),
                        (F.col("cell") + first).alias("sequence_id"), (from_ % w).alias("offset"))


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         vocabulary: str = VOCABULARY, end: int = END, window: int = WINDOW,
         unit: int = UNIT) -> DataFrame:
    """One row per packed piece: doc_id, start, length, doc_tokens, sequence_id,
    offset and ``ids`` (little-endian unsigned 32-bit numbers)."""
    pieces = materialise(encoded(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary,
                                 end=end, window=window, unit=unit), "packing-pieces")
    places = laid_out(pieces, window, unit)
    size = F.expr("octet_length(ids) div length")
    cut = (pieces.select("piece", "doc_id", "start", "doc_tokens", "ids", size.cast("int").alias("size"))
           .join(places, "piece")
           .select("doc_id", (F.col("start") + F.col("cut")).alias("start"), F.col("taken").alias("length"),
                   "doc_tokens", "sequence_id", "offset",
                   F.substring("ids", (F.col("cut") * F.col("size") + 1).cast("int"),
                               (F.col("taken") * F.col("size")).cast("int")).alias("ids")))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, WIDEN_ROWS):
                some = b.slice(i, WIDEN_ROWS)
                at = some.schema.get_field_index("ids")
                n = some.column(some.schema.get_field_index("length")).to_numpy()
                yield some.set_column(at, "ids", wide_ids(some.column(at), n))
    return cut.mapInArrow(widen, cut.schema)


def wide_ids(col: pa.Array, length: np.ndarray) -> pa.Array:
    """A column of 16- or 32-bit numbers (all rows alike), ``length`` in each
    row, as 32-bit numbers."""
    raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8)
    if len(raw) != 4 * int(length.sum()):
        raw = raw.view("<u2").astype("<u4").view(np.uint8)
    ends = np.concatenate(([0], np.cumsum(4 * length))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def checksums(packed: DataFrame) -> DataFrame:
    """The packed pieces with the crc32 of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, pieces): the training sequences, at most a window of
    ids each, with the start of every piece for attention masks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in x), "<u4").astype(np.int32)
                   for x in b.column(1).to_pylist()]
            offs = [[p["offset"] for p in x] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(offs, pa.list_(pa.int64()))],
                names=["sequence_id", "ids", "pieces"])
    rows = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.mapInArrow(run, "sequence_id bigint, ids array<int>, pieces array<bigint>")


__all__ = ["checksums", "encoded", "end_to_end", "laid_out", "nnls", "pack", "partitions", "plan_rows",
           "sequences", "solve"]
