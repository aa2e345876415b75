"""Whitening of embeddings: principal components by spectral divide and conquer.

Three passes over the vectors, each a sum over tasks: number and sums, the
centred products, the products of the whitened values. Nothing but sums of
d and d x d numbers (d: the dimension) leaves the tasks; Spark adds them up.

``spectrum`` finds the components of the covariance on the driver: the
polar factor U of the covariance shifted by the mean eigenvalue (``polar``:
QR-based dynamically weighted Halley steps) gives the projector (U + I) / 2 on
the components above the shift. An orthonormal basis of its range and of the
complement splits the matrix in two, and both halves are split again, until
they are numbers or multiples of the identity. Only halves that can hold one
of the first ``top`` components are split. The factors (d x top numbers) are
broadcast for the whitening itself.

Defined results: rows whose vector is null, empty or holds null or non-finite
entries are dropped; so are vectors of another length than the most frequent
one (of equally frequent ones, the shorter). Components whose eigenvalue is no
more than rounding beside the largest are none: vectors that are all the same,
a single vector and an empty table give no rows. Repeated rows count as often
as they stand. A null id is kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 8
EPS = float(np.finfo(np.float64).eps)


# ---- spectral divide and conquer on the d x d covariance ------------------

def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix: the matrix sign, where no
    eigenvalue is zero."""
    n = len(a)
    scale = float(np.linalg.norm(a))
    if not scale:
        return np.eye(n)
    x, low, one = a / scale, EPS, np.eye(n)
    for _ in range(20):
        d = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * np.sqrt(1 + d)), 0.0))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        before = x
        if r > 100:                 # badly conditioned: by QR
            f = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))[0]
            x = (q / r) * x + (p - q / r) / np.sqrt(r) * f[:n] @ f[n:].T
        else:
            z = one + r * (x.T @ x)
            x = (q / r) * x + (p - q / r) * np.linalg.solve(z, x.T).T
        x = (x + x.T) / 2
        low = min(low * (p + q * low ** 2) / (1 + r * low ** 2), 1.0)
        if low > 1 - 1e-14 and np.linalg.norm(x - before) <= 1e-13 * np.sqrt(n):
            break
        low = min(low, 1 - EPS)
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift;
    None if no shift parts the matrix."""
    n = len(a)
    mean = float(np.trace(a)) / n
    spread = float(np.linalg.norm(a - mean * np.eye(n))) / np.sqrt(n)
    start = np.random.default_rng(n).standard_normal((n, n))
    for step in (0.0, 0.11, -0.13, 0.29, -0.31, 0.53, -0.57):
        u = polar(a - (mean + step * spread) * np.eye(n))
        k = int(round((np.trace(u) + n) / 2))
        p = (u + np.eye(n)) / 2
        if not 0 < k < n or np.linalg.norm(p @ p - p) > 1e-10 * n:
            continue
        q = np.linalg.qr(p @ start[:, :k], mode="complete")[0]
        for _ in range(3):          # subspace iterations with the projector
            q = np.linalg.qr(p @ q[:, :k], mode="complete")[0]
            if np.linalg.norm(q[:, k:].T @ a @ q[:, :k]) <= 10 * n * EPS * np.linalg.norm(a):
                break
        else:
            continue
        return q[:, :k], q[:, k:]
    return None


def spectrum(a: np.ndarray, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` largest eigenvalues of a symmetric matrix, falling, and their
    unit eigenvectors as columns; the largest entry of each is positive."""
    a = (a + a.T) / 2
    top = len(a) if top is None else min(top, len(a))
    whole = float(np.linalg.norm(a))
    todo, done = [np.eye(len(a))], []
    count = 0
    while todo and count < top:
        basis = todo.pop()          # the halves above come first
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        n = len(part)
        flat = np.linalg.norm(part - np.trace(part) / n * np.eye(n)) <= 4 * EPS * whole * np.sqrt(n)
        halves = None if n == 1 or flat else split(part)
        if halves is None:
            done.append(basis)
            count += n
        else:
            todo += [basis @ halves[1], basis @ halves[0]]
    vectors = np.linalg.qr(np.hstack(done))[0] if done else np.zeros((len(a), 0))
    values = np.einsum("ik,ij,jk->k", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")[:top]
    vectors = vectors[:, order]
    peak = np.abs(vectors).argmax(axis=0)
    return values[order], vectors * np.sign(vectors[peak, np.arange(len(order))])


# ---- sums over tasks -------------------------------------------------------

def usable(vec: Column) -> Column:
    """True where a vector has entries, all of them finite numbers."""
    odd = F.exists(vec, lambda c: c.isNull() | F.isnan(c.cast("double"))
                   | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return F.coalesce((F.size(vec) > 0) & ~odd, F.lit(False))


def matrix(col: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``d`` numbers."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def summed(rows: DataFrame, part) -> dict[int, np.ndarray]:
    """Sum over all rows of ``part(matrix) -> matrix``, row by row of the small
    matrix; ``rows`` has the one column of vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                add = part(b.column(0))
                total = add if total is None else total + add
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))],
                names=["i", "v"])
    found = (rows.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
             .groupBy("i", "j").agg(F.sum("v").alias("v"))
             .groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("v")).collect())
    return {r.i: np.array([x.v for x in r.v]) for r in found}


@dataclass
class Whitening:
    """Fitted factors: n vectors, their sums, eigenvalues (falling) and
    components (columns), the covariance's trace, and the largest entry of the
    whitened covariance minus the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def dimension(rows: DataFrame, vec_col: str) -> int | None:
    """The most frequent length of the usable vectors."""
    top = (rows.filter(usable(F.col(vec_col))).groupBy(F.size(vec_col).alias("d")).count()
           .orderBy(F.desc("count"), "d").limit(1).collect())
    return top[0].d if top else None


def fit(rows: DataFrame, vec_col: str, top: int = TOP) -> Whitening | None:
    """Whitening over all usable vectors of ``rows``; None without any."""
    d = dimension(rows, vec_col)
    if d is None:
        return None
    vecs = rows.filter(usable(F.col(vec_col)) & (F.size(vec_col) == d)).select(F.col(vec_col).alias("vec"))

    def first(col: pa.Array) -> np.ndarray:
        m = matrix(col, d)
        return np.append(m.sum(axis=0), float(len(m)))[None, :]
    head = summed(vecs, first)[0]
    n, sums = int(head[-1]), head[:-1]
    centre = vecs.sparkSession.sparkContext.broadcast(sums / n)

    def products(col: pa.Array) -> np.ndarray:
        y = matrix(col, d) - centre.value
        return y.T @ y
    rows_of = summed(vecs, products)
    cov = np.array([rows_of[i] for i in range(d)]) / n
    values, vectors = spectrum(cov, top)
    real = values > 10 * d * EPS * max(float(values.max(initial=0.0)), 0.0)
    model = Whitening(n, sums, values[real], vectors[:, real], float(np.trace(cov)))
    if not len(model.values):
        return model
    shared = vecs.sparkSession.sparkContext.broadcast(model)

    def whitened(col: pa.Array) -> np.ndarray:
        w = shared.value.apply(matrix(col, d))
        return np.vstack([w.T @ w, w.sum(axis=0)])
    got = summed(vecs, whitened)
    k = len(model.values)
    mean = got[k] / n
    again = np.array([got[i] for i in range(k)]) / n - np.outer(mean, mean)
    model.error = float(np.abs(again - np.eye(k)).max())
    return model


def transform(rows: DataFrame, model: Whitening | None, vec_col: str, out_col: str = "whitened") -> DataFrame:
    """``rows`` that are usable and of the fitted length, with their whitened
    vector (one number for each component); a column of that name is replaced."""
    kept = [c for c in rows.columns if c != out_col]
    if model is None:
        return rows.limit(0).select(*kept, F.array().cast("array<double>").alias(out_col))
    d = len(model.sums)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = kept.index(vec_col)
    frame = (rows.filter(usable(F.col(vec_col)) & (F.size(vec_col) == d)).select(*kept)
             .withColumn(out_col, F.array().cast("array<double>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = shared.value.apply(matrix(b.column(at), d)) if b.num_rows else np.zeros((0, 0))
            k = w.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k),
                                             pa.array(np.ascontiguousarray(w).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=b.schema.names)
    return frame.mapInArrow(run, frame.schema)


def whitened_components(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding",
                        top: int = TOP) -> DataFrame:
    """One row per vector and component, over vectors rounded down to 1/1024:
    vec_id, component, n, deviation, whitened, explained, identity_error.

    An entry c becomes floor(1024 c) + 100000 (1024 c is held within +-1e15);
    ``deviation``, the sum of (n x - S)^2, is null beyond 64 bits.
    """
    def cell(c: Column) -> Column:
        big = F.lit(1e15)
        return F.floor(F.greatest(F.least(c.cast("double") * 1024, big), -big)) + F.lit(100000).cast("bigint")
    rows = (vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"))
            .filter(usable(F.col("vec"))).select("vec_id", F.transform("vec", cell).alias("x")))
    model = fit(rows, "x", top)
    schema = ("component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    if model is None or not len(model.values):
        none = rows.limit(0).select("vec_id")
        return none.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in
                                       (x.split() for x in schema.split(", "))])
    s = F.array(*[F.lit(int(v)) for v in model.sums]).cast("array<bigint>")
    off = F.zip_with("x", s, lambda x, t: F.try_subtract(F.try_multiply(F.lit(model.n).cast("bigint"), x), t))
    deviation = F.aggregate(off, F.lit(0).cast("bigint"), lambda t, y: F.try_add(t, F.try_multiply(y, y)))
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return (transform(rows, model, "x")
            .select("vec_id", deviation.alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"),
                    "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained"),
                    F.lit(model.error).alias("identity_error")))
