"""Retrieval: metadata filter (PF1), exact kNN join (J2), similar chunks (J4),
ranking (W4/T1), rerank (W5), paging (T2), top sources (T3), result projection
(PF11) and previews (PF12). Approximate kNN (J3) is in ``vector_index``.

Exact kNN plan: a query set of at most ``MAX_QUERY_BYTES`` is broadcast and the
corpus is scanned in place: a task scores its Arrow batches with one matrix
product each and keeps the k best chunks of every query (``TopK``); only those
leave the task, and a window with a group limit merges them. No corpus vector
is shuffled. Larger query sets meet the corpus block by block: both sides are
hashed into blocks of bounded size (equi-join on the pair of block numbers).
Texts are joined to the k winners only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ------------------------------------------------------------------ PF1 ---
def metadata_filter(filters: dict[str, Any] | None, schema: T.StructType | None = None) -> Column | None:
    """Fold a filter dict into one Column (None = no filter).

    string -> equal; number (bool counts as a number, but compares as a bool
    with a boolean column of ``schema``) -> equal; list -> OR of
    its string members (dropped when it has none); other values ignored; all
    conditions ANDed. Plain columns, so Parquet receives the predicates.
    """
    cond = None
    for key, value in (filters or {}).items():
        c = None
        if isinstance(value, str):
            c = F.col(key) == F.lit(value)
        elif isinstance(value, bool):
            is_bool = schema is not None and key in schema.names \
                and isinstance(schema[key].dataType, T.BooleanType)
            c = F.col(key) == F.lit(value if is_bool else int(value))
        elif isinstance(value, (int, float)):
            c = F.col(key) == F.lit(value)
        elif isinstance(value, list):
            members = [v for v in value if isinstance(v, str)]
            if members:
                c = F.col(key).isin(members)
        if c is not None:
            cond = c if cond is None else (cond & c)
    return cond


def apply_filter(df: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    cond = metadata_filter(filters, df.schema)
    return df if cond is None else df.filter(cond)


# ------------------------------------------------------------------- J2 ---
MAX_QUERY_BYTES = 64 << 20      # query vectors (as doubles) that are broadcast
BLOCK_QUERIES = 1024            # queries of one matrix product
BLOCK_SCORES = 1 << 20          # scores of one matrix product
BLOCK_CHUNKS = 16384            # chunks of one block, where blocks meet


def unit_rows(m) -> np.ndarray:
    """Rows scaled to length one; a zero vector becomes NaN."""
    m = np.asarray(m, dtype=np.float64)
    n = np.linalg.norm(m, axis=1)
    n[n == 0] = np.nan
    return m / n[:, None]


def certainties(queries: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """(1 + cos) / 2 of unit rows; -inf where one is no unit row."""
    s = queries @ chunks.T
    s += 1.0
    s /= 2.0
    s[np.isnan(s)] = -np.inf
    return s


class TopK:
    """The k best (score, id) of each of ``n`` queries so far, by (score
    descending, id)."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.id: np.ndarray | None = None
        self.least = np.full(n, -np.inf)        # a score below is none of the k best

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score``: one row for each query of ``rows``, one column per id."""
        if score.shape[1] > self.k and np.isneginf(self.least[rows]).any():
            kth = np.partition(score, score.shape[1] - self.k, axis=1)[:, -self.k]
            least = np.maximum(self.least[rows], kth)
        else:
            least = self.least[rows]
        i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
        if not len(i):
            return
        row, value, new = rows[i], score[i, j], ids[j]
        if self.id is not None:
            touched = np.zeros(self.n, dtype=bool)
            touched[row] = True
            old = touched[self.row]
            row = np.concatenate((row, self.row[old]))
            value = np.concatenate((value, self.score[old]))
            new = np.concatenate((new, self.id[old]))
            rest = self.row[~old], self.score[~old], self.id[~old]
        order = np.lexsort((new, -value, row))
        row, value, new = row[order], value[order], new[order]
        begin = np.searchsorted(row, row, "left")
        place = np.arange(len(row)) - begin
        kept = place < self.k
        full = place == self.k - 1
        self.least[row[full]] = value[full]
        row, value, new = row[kept], value[kept], new[kept]
        if self.id is not None:
            row, value, new = (np.concatenate(x) for x in zip((row, value, new), rest))
        self.row, self.score, self.id = row, value, new


class QuerySet:
    """Queries of one dimension: ids, unit vectors, and the cells each asks
    (none: all)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, probes: np.ndarray | None = None):
        self.ids, self.unit, self.probes = ids, unit_rows(vectors), probes

    def score(self, rows: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        return certainties(self.unit[rows], chunks)


def query_sets(rows: list[tuple]) -> dict[int, QuerySet]:
    """(id, vector) rows by dimension; a vector with nulls has no neighbours."""
    by: dict[int, list[tuple]] = {}
    for i, v in rows:
        if v and None not in v:
            by.setdefault(len(v), []).append((i, v))
    return {d: QuerySet(np.array([i for i, _ in x]), np.array([v for _, v in x], dtype=np.float64))
            for d, x in by.items()}


def vector_groups(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) of a list column, by length."""
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        part = col if len(at) == len(col) else col.take(pa.array(at))
        yield d, at, part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def score_blocks(n_queries: int, n_chunks: int) -> Iterator[tuple[slice, slice]]:
    """Slices of queries and chunks of at most ``BLOCK_QUERIES`` queries and
    ``BLOCK_SCORES`` scores, so that the memory of a product does not grow."""
    wide = max(1, BLOCK_SCORES // max(1, min(n_queries, BLOCK_QUERIES)))
    for j in range(0, n_chunks, wide):
        for i in range(0, n_queries, BLOCK_QUERIES):
            yield slice(i, min(i + BLOCK_QUERIES, n_queries)), slice(j, min(j + wide, n_chunks))


def scan_topk(corpus: DataFrame, queries, k: int, *, cid: str, cvec: str, query_type: T.DataType,
              exclude_self: bool = False, cell: str | None = None) -> DataFrame:
    """(query_id, <cid>, similarity_score): the k best chunks that each task
    found for each query of the broadcast ``queries``, a {dimension: QuerySet}.
    With ``cell`` a chunk meets only the queries that ask its cell."""
    out = T.StructType([T.StructField("query_id", query_type),
                        T.StructField(cid, corpus.schema[cid].dataType),
                        T.StructField("similarity_score", T.DoubleType())])
    kinds = [pa_type(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = queries.value
        best = {d: TopK(len(s.ids), k) for d, s in sets.items()}
        for b in batches:
            ids = np.array(b.column(0).to_pylist())
            cells = b.column(2).to_numpy(zero_copy_only=False) if cell else None
            for d, at, m in vector_groups(b.column(1)):
                if d not in sets:
                    continue
                m, s = unit_rows(m), sets[d]
                for c in np.unique(cells[at]) if cell else [None]:
                    here = np.arange(len(at)) if c is None else np.flatnonzero(cells[at] == c)
                    asked = np.arange(len(s.ids)) if c is None else np.flatnonzero((s.probes == c).any(axis=1))
                    for rows, cols in score_blocks(len(asked), len(here)):
                        rows, cols = asked[rows], here[cols]
                        score = s.score(rows, m[cols])
                        if exclude_self:
                            score[s.ids[rows][:, None] == ids[at[cols]][None, :]] = -np.inf
                        best[d].add(rows, score, ids[at[cols]])
        for d, top in best.items():
            if top.id is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets[d].ids[top.row].tolist(), kinds[0]), pa.array(top.id.tolist(), kinds[1]),
                     pa.array(top.score)], names=out.names)
    return corpus.select(cid, cvec, *([cell] if cell else [])).mapInArrow(run, out)


def pa_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(t)


def _score_blocks(k: int, qid: str, cid: str, exclude_self: bool):
    """cogroup body: the k best chunks of a block for each query of a block,
    by (score descending, chunk id)."""
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(cid, kind="stable")
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": q[qid][:0], cid: c[cid][:0],
                                 "similarity_score": np.zeros(0)})
        asked, chunks = unit_rows(np.stack(q["_v"])), unit_rows(np.stack(c["_v"]))
        q_ids, c_ids, found = q[qid].to_numpy(), c[cid].to_numpy(), []
        some = max(1, BLOCK_SCORES // len(c))
        for i in range(0, len(q), some):
            score = certainties(asked[i:i + some], chunks)
            if exclude_self:
                score[q_ids[i:i + some, None] == c_ids[None, :]] = -np.inf
            np.negative(score, out=score)
            best = np.argsort(score, axis=1, kind="stable")[:, :k]      # ties: chunk order
            value = -np.take_along_axis(score, best, axis=1)
            row, col = np.nonzero(np.isfinite(value))
            found.append((q_ids[i + row], c_ids[best[row, col]], value[row, col]))
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(("query_id", cid, "similarity_score"), zip(*found))})
    return run


def best_per_query(scored: DataFrame, k: int, cid: str) -> DataFrame:
    """Rank 1..k by (score descending, chunk id)."""
    w = W.partitionBy("query_id").orderBy(F.col("similarity_score").desc(), F.col(cid))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int = 10, *,
             qid: str = "query_id", qvec: str = "embedding",
             cid: str = "chunk_id", cvec: str = "embedding",
             payload: list[str] | None = None, texts: DataFrame | None = None,
             filters: dict[str, Any] | None = None,
             exclude_self: bool = False, max_broadcast: int = MAX_QUERY_BYTES,
             block_queries: int = BLOCK_QUERIES, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """J2 exact k nearest chunks per query by certainty (1+cos)/2.

    Returns (query_id, <cid>, similarity_score, rank, *payload); rank is
    1..k by (score desc, chunk id asc) -- W4/T1. Queries without a vector and
    zero vectors have no neighbours. ``texts`` holds the payload by <cid>
    (default: ``corpus``).
    """
    corpus = apply_filter(corpus, filters)
    q = queries.select(F.col(qid).alias("query_id"), F.col(qvec).alias("_v")).filter(F.col("_v").isNotNull())
    size = q.agg(F.sum(F.size("_v") * 8 + F.coalesce(F.octet_length(F.col("query_id").cast("string")), F.lit(0)))
                 ).first()[0] or 0
    if size <= max_broadcast:
        sets = query_sets([tuple(r) for r in q.collect()])
        scored = scan_topk(corpus, q.sparkSession.sparkContext.broadcast(sets), k, cid=cid, cvec=cvec,
                           query_type=queries.schema[qid].dataType, exclude_self=exclude_self)
    else:
        scored = block_topk(q, corpus, k, cid, cvec, exclude_self, block_queries, block_chunks)
    best = best_per_query(scored, k, cid)
    if payload:
        best = best.join((corpus if texts is None else texts).select(cid, *payload), cid, "left").select(
            "query_id", cid, "similarity_score", "rank", *payload)
    return best


def block_topk(q: DataFrame, corpus: DataFrame, k: int, cid: str, cvec: str, exclude_self: bool,
               block_queries: int, block_chunks: int) -> DataFrame:
    """``scan_topk`` for any number of queries: block meets block."""
    c = corpus.select(cid, F.col(cvec).alias("_v")).filter(F.col("_v").isNotNull())
    n_q = max(1, math.ceil(q.count() / block_queries))
    n_c = max(1, math.ceil(c.count() / block_chunks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    out = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType),
                        T.StructField(cid, corpus.schema[cid].dataType),
                        T.StructField("similarity_score", T.DoubleType())])
    q = q.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("_c", every(n_c))
    c = c.withColumn("_c", F.pmod(F.xxhash64(cid), F.lit(n_c)).cast("int")).withColumn("_q", every(n_q))
    return q.groupBy("_q", "_c").cogroup(c.groupBy("_q", "_c")).applyInPandas(
        _score_blocks(k, "query_id", cid, exclude_self), out)


def similar_chunks(chunks: DataFrame, k: int = 5, *, queries: DataFrame | None = None,
                   cid: str = "chunk_id", cvec: str = "embedding",
                   payload: list[str] | None = None) -> DataFrame:
    """K nearest *other* chunks of every chunk of ``queries`` (default:
    of all chunks)."""
    q = (chunks if queries is None else queries).select(F.col(cid).alias("query_id"),
                                                        F.col(cvec).alias("qv"))
    return knn_join(q, chunks, k, qid="query_id", qvec="qv", cid=cid, cvec=cvec,
                    payload=payload, exclude_self=True)


# ------------------------------------------------------------------- W5 ---
def rerank(hits: DataFrame, content_col: str = "content",
           score_col: str = "similarity_score", rank_col: str = "rank", model=None) -> DataFrame:
    """Score *= 0.8 + 0.2 * min(len/500, 1), or the factor that ``model``
    (a U3 hook from content to double) gives; new ranks by the new score, ties
    keep the old order."""
    size = F.coalesce(F.length(content_col), F.lit(0))
    factor = F.lit(0.8) + F.lit(0.2) * F.least(size / 500.0, F.lit(1.0))
    if model is not None:
        factor = model(F.col(content_col))
    w = W.partitionBy("query_id").orderBy(F.col(score_col).desc(), F.col("_old_rank"))
    return (hits.withColumnRenamed(rank_col, "_old_rank")
            .withColumn("vector_score", F.col(score_col))
            .withColumn(score_col, F.col(score_col) * factor)
            .withColumn(rank_col, F.row_number().over(w))
            .drop("_old_rank"))


# ------------------------------------------------------------------- T2 ---
def search_page(queries: DataFrame, corpus: DataFrame, *, limit: int = 5,
                offset: int = 0, threshold: float = 0.7, do_rerank: bool = True,
                filters: dict[str, Any] | None = None, qid: str = "query_id",
                qvec: str = "embedding", cid: str = "chunk_id", cvec: str = "embedding",
                content_col: str = "content", payload: list[str] | None = None,
                texts: DataFrame | None = None) -> DataFrame:
    """Fetch limit+offset, rerank, keep score >= threshold, then the page
    [offset, offset+limit) of the survivors; total_results = survivors.

    Works for many queries at once: positions come from a per-query window
    instead of OFFSET."""
    payload = list(dict.fromkeys([content_col, *(payload or [])]))
    hits = knn_join(queries, corpus, limit + offset, qid=qid, qvec=qvec, cid=cid,
                    cvec=cvec, payload=payload, texts=texts, filters=filters)
    return page_hits(hits, limit=limit, offset=offset, threshold=threshold,
                     do_rerank=do_rerank, content_col=content_col)


def page_hits(hits: DataFrame, *, limit: int = 5, offset: int = 0, threshold: float = 0.7,
              do_rerank: bool = True, content_col: str = "content") -> DataFrame:
    """T2 on fetched hits (query_id, rank, similarity_score, content)."""
    if do_rerank:
        hits = rerank(hits, content_col)
    else:
        hits = hits.withColumn("vector_score", F.col("similarity_score"))
    kept = hits.filter(F.col("similarity_score") >= threshold)
    w = W.partitionBy("query_id").orderBy("rank")
    return (kept.withColumn("position", F.row_number().over(w))
            .withColumn("total_results", F.count("*").over(W.partitionBy("query_id")))
            .filter((F.col("position") > offset) & (F.col("position") <= offset + limit)))


# --------------------------------------------------------- T3, PF11, PF12 ---
def top_sources(hits: DataFrame, n: int = 3, content_col: str = "content") -> DataFrame:
    """T3 + PF12: first n hits with a 200-char preview ('...' always added)."""
    return (hits.filter(F.col("rank") <= n)
            .withColumn("preview", F.concat(F.substring(F.coalesce(F.col(content_col), F.lit("")), 1, 200),
                                             F.lit("..."))))


def result_projection(hits: DataFrame) -> DataFrame:
    """PF11: hit -> metadata struct(title, chunk_index, document_type, file_path, rank)."""
    def opt(c, t="string"):
        return F.col(c) if c in hits.columns else F.lit(None).cast(t)
    return hits.withColumn("metadata", F.struct(
        opt("title").alias("title"), opt("chunk_index", "int").alias("chunk_index"),
        opt("document_type").alias("document_type"), opt("file_path").alias("file_path"),
        F.col("rank").alias("rank")))


def recall_at_k(approx: DataFrame, exact: DataFrame, cid: str = "chunk_id") -> DataFrame:
    """Share of exact hits found by the approximate join."""
    a = approx.select("query_id", cid).withColumn("found", F.lit(1))
    return (exact.select("query_id", cid).join(a, ["query_id", cid], "left")
            .agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall")))
