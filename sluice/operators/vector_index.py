"""Approximate kNN (J3) by trained coarse cells.

``train`` runs k-means on unit vectors of a bounded sample: the ``SAMPLE`` chunks
with the smallest md5 of their id, at most ``CELLS`` cells. Every chunk is
assigned to the cell of its nearest centre, and the corpus is written once by
cell: a folder per cell, cells with more than ``CELL_ROWS`` chunks as several
files. A query asks the cells of its nearest centres. How many is measured on
the sample: the fewest with which ``ASKERS`` sample chunks find the share
``RECALL`` of their neighbours in the sample.

A search reads the folders of asked cells only and scores them like the exact
join (broadcast queries, partial top-k); ``touched_share`` counts the pairs of a
query and a chunk that it scores, against all pairs.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import retrieval as rt
from sluice.session import scratch_path

SAMPLE = 20_000         # chunks that the cells are trained on
CELLS = 1024            # cells at most
ROWS_PER_CELL = 8       # sample chunks per cell at least, on average
ROUNDS = 6              # rounds of k-means
ASKERS = 200            # sample chunks that measure the recall
NEIGHBOURS = 10
RECALL = 0.95
CELL_ROWS = 1_000_000   # chunks of one file


@dataclass
class CellIndex:
    """Centres (unit rows), cells a query asks, the written chunks and their
    number by cell."""

    centres: np.ndarray
    probes: int
    chunks: DataFrame | None
    sizes: dict[int, int]
    cid: str


def kmeans(unit: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit rows by largest cosine (ties: the first centre), from
    the first ``cells`` rows; an empty cell keeps its centre."""
    centres = unit[:cells].copy()
    for _ in range(rounds):
        near = nearest(unit, centres, 1)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, near, unit)
        norm = np.linalg.norm(total, axis=1)
        moved = norm > 0
        centres[moved] = total[moved] / norm[moved, None]
    return centres


def nearest(unit: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` centres of largest cosine of every row, best first."""
    out = [np.argsort(-(unit[i:i + 4096] @ centres.T), axis=1, kind="stable")[:, :n]
           for i in range(0, len(unit), 4096)]
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def probes_for(unit: np.ndarray, centres: np.ndarray, recall: float = RECALL) -> int:
    """Cells to ask so that the first ``ASKERS`` rows find the share ``recall``
    of their neighbours among all rows."""
    askers = unit[:ASKERS]
    near = np.argsort(-(askers @ unit.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    order = nearest(askers, centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(askers), 0), axis=1)
    home = nearest(unit, centres, 1)[:, 0]
    need = np.sort(np.take_along_axis(place, home[near], axis=1).ravel()) + 1
    return int(need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)])


def train(corpus: DataFrame, *, cid: str = "chunk_id", cvec: str = "embedding",
          recall: float = RECALL) -> tuple[np.ndarray, int]:
    """(centres, cells to ask) from the sample; vectors of the sample's most
    frequent length count, zero vectors and vectors with nulls do not."""
    rows = (corpus.filter(F.col(cvec).isNotNull()).select(F.col(cid).cast("string").alias("id"), F.col(cvec).alias("v"))
            .orderBy(F.md5("id"), "id").limit(SAMPLE).collect())
    rows = [r.v for r in rows if len(r.v) and None not in r.v and any(r.v)]
    if not rows:
        return np.zeros((0, 0)), 0
    lengths, count = np.unique([len(v) for v in rows], return_counts=True)
    d = int(lengths[count.argmax()])
    unit = rt.unit_rows(np.array([v for v in rows if len(v) == d], dtype=np.float64))
    centres = kmeans(unit, max(1, min(CELLS, len(unit) // ROWS_PER_CELL)))
    return centres, probes_for(unit, centres, recall)


def assigned(corpus: DataFrame, centres: np.ndarray, cid: str, cvec: str) -> DataFrame:
    """(<cid>, <cvec>, cell) of every chunk with a vector; a vector of another
    length than the centres', a zero vector and one with nulls is in cell -1."""
    shared = corpus.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        c = shared.value
        out = np.full(len(v), -1, dtype=np.int32)
        ok = np.array([len(x) == c.shape[1] and len(x) > 0 for x in v], dtype=bool)
        at = np.flatnonzero(ok)
        if len(at):
            m = np.stack([np.asarray(v.iloc[i], dtype=np.float64) for i in at])
            fine = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
            out[at[fine]] = nearest(rt.unit_rows(m[fine]), c, 1)[:, 0]
        return pd.Series(out)
    return corpus.filter(F.col(cvec).isNotNull()).select(cid, cvec, cell(F.col(cvec)).alias("cell"))


def build(corpus: DataFrame, *, cid: str = "chunk_id", cvec: str = "embedding", recall: float = RECALL,
          cell_rows: int = CELL_ROWS) -> CellIndex:
    """Train the cells and write every chunk by cell."""
    spark = corpus.sparkSession
    centres, probes = train(corpus, cid=cid, cvec=cvec, recall=recall)
    if not len(centres):
        return CellIndex(centres, 0, None, {}, cid)
    rows = assigned(corpus, centres, cid, cvec)
    sizes = {r[0]: r[1] for r in rows.groupBy("cell").count().collect()}        # at most CELLS + 1 rows
    files = F.create_map(*[F.lit(int(x)) for c, n in sizes.items() for x in (c, -(-n // cell_rows))])
    split = F.pmod(F.xxhash64(cid), F.element_at(files, F.col("cell")))
    path = scratch_path(spark, f"cells-{uuid.uuid4().hex}")
    rows.repartition("cell", split).write.option("maxRecordsPerFile", cell_rows).partitionBy("cell").parquet(path)
    schema = rows.schema
    return CellIndex(centres, probes, spark.read.schema(schema).parquet(path), sizes, cid)


def search(index: CellIndex, queries: DataFrame, k: int = 10, *, qid: str = "query_id",
           qvec: str = "embedding", cvec: str = "embedding", probes: int | None = None,
           max_broadcast: int = rt.MAX_QUERY_BYTES) -> tuple[DataFrame, int]:
    """(hits with the J2 columns, number of scored pairs). Query sets over
    ``max_broadcast`` are searched in parts of that size, one after the other."""
    spark = queries.sparkSession
    n = index.probes if probes is None else min(probes, len(index.centres))
    kind = queries.schema[qid].dataType
    d = index.centres.shape[1] if len(index.centres) else 0
    q = queries.select(F.col(qid).alias("query_id"), F.col(qvec).alias("v")).filter(F.size("v") == d)
    row_bytes = 8 * (d + n) + 64
    parts = max(1, math.ceil(q.count() * row_bytes / max(1, max_broadcast))) if n else 0
    hits, pairs = [], 0
    for p in range(parts):
        mine = q if parts == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p)
        sets = rt.query_sets([tuple(r) for r in mine.collect()])
        if d not in sets:
            continue
        s = sets[d]
        s.probes = nearest(np.nan_to_num(s.unit), index.centres, n)
        asked, times = np.unique(s.probes, return_counts=True)
        pairs += sum(index.sizes.get(c, 0) * t for c, t in zip(asked.tolist(), times.tolist()))
        found = rt.scan_topk(index.chunks.filter(F.col("cell").isin(asked.tolist())),
                             spark.sparkContext.broadcast({d: s}), k, cid=index.cid, cvec=cvec,
                             query_type=kind, cell="cell")
        hits.append(rt.best_per_query(found, k, index.cid))
    if not hits:
        none = "string" if index.chunks is None else index.chunks.schema[index.cid].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind.simpleString()}, {index.cid} {none}, "
                                         "similarity_score double, rank int"), 0
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out, pairs


def knn_approx(queries: DataFrame, corpus: DataFrame, k: int = 10, *, qid: str = "query_id",
               qvec: str = "embedding", cid: str = "chunk_id", cvec: str = "embedding",
               recall: float = RECALL) -> DataFrame:
    """J3 in one call: cells of ``corpus``, then the search."""
    index = build(corpus, cid=cid, cvec=cvec, recall=recall)
    return search(index, queries, k, qid=qid, qvec=qvec, cvec=cvec)[0]


def touched_share(index: CellIndex, n_queries: int, pairs: int) -> float:
    """Scored pairs over all pairs of a query and a chunk."""
    return pairs / max(1, n_queries * sum(index.sizes.values()))
