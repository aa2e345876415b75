"""Whitening against numpy's eigensolver and exact integer sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, component string"


@pytest.fixture(scope="module")
def frame(spark):
    from sluice.session import ship_package
    ship_package(spark)

    def run(rows, schema=SCHEMA):
        df = spark.createDataFrame([(*r, "x") for r in rows], schema)
        return df.repartition(3) if rows else df
    return run


def usable(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, top):
    """{(vec_id, component): (n, deviation, whitened, explained)} with numpy."""
    kept = [(i, np.float32(v).astype(float)) for i, v in rows if v is not None and usable(v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    m = np.array(x, float)
    centred = m - np.array(s) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for (i, _), r, c in zip(kept, x, centred):
        deviation = sum((n * a - b) ** 2 for a, b in zip(r, s))
        for k in range(min(top, d)):
            out[i, k + 1] = (n, deviation, float(c @ u[:, k]) / math.sqrt(e[k]), e[k] / e.sum())
    return out


def check(df, want):
    got = {(r.vec_id, r.component): r for r in df.collect()}
    assert got.keys() == want.keys()
    signs = {}
    for key, (n, deviation, value, explained) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-8)
        assert abs(r.whitened) == pytest.approx(abs(value), rel=1e-6, abs=1e-6)
        if abs(value) > 1e-3:       # either sign, the same for all rows
            signs.setdefault(key[1], set()).add(r.whitened * value > 0)
        assert 0 <= r.identity_error <= 1e-4
    assert all(len(v) == 1 for v in signs.values())


def vectors(n, d, seed=5):
    r = np.random.default_rng(seed)
    m = r.standard_normal((n, d)) * np.linspace(1.0, 0.2, d) @ r.standard_normal((d, d))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(m)]


def test_against_brute_force(frame):
    rows = vectors(120, 12)
    rows += [(900, rows[3][1]), (901, rows[3][1])]                  # repeated vectors
    odd = [(-1, None), (-2, []), (-3, [None] * 12), (-4, [math.nan] + [0.0] * 11),
           (-5, [math.inf] + [0.0] * 11), (-6, [-math.inf] + [0.0] * 11)]
    check(wh.whitened_components(frame(rows + odd)), brute(rows, 8))


def test_fewer_dimensions_than_components(frame):
    rows = vectors(40, 3)
    check(wh.whitened_components(frame(rows)), brute(rows, 3))


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    check(wh.whitened_components(df), brute(rows, 8))


def test_tables_without_components(frame):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [0.5, 0.25]) for i in range(6)]):
        df = wh.whitened_components(frame(rows))
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                              "identity_error"]
        assert df.count() == 0


def test_constant_dimension_and_rare_lengths(frame):
    rows = [(i, [*v, 0.75]) for i, v in vectors(50, 4)]
    got = wh.whitened_components(frame(rows + [(99, [1.0, 2.0])]))
    assert got.filter("vec_id = 99").count() == 0
    assert got.agg(F.max("component")).first()[0] == 4     # the constant one is no component


def test_transform_keeps_columns(frame):
    df = frame(vectors(60, 5))
    model = wh.fit(df, "embedding", 2)
    out = wh.transform(df, model, "embedding", out_col="component")     # replaces the clashing one
    assert out.columns == ["vec_id", "embedding", "component"]
    w = np.array([r.component for r in out.collect()])
    assert w.shape == (60, 2)
    assert np.abs(w.T @ w / 60 - np.eye(2)).max() < 1e-9
    assert wh.transform(df, None, "embedding").count() == 0


@pytest.mark.parametrize("values", [
    [5.0, 3.0, 2.0, 1.0, 0.5], [4.0, 4.0, 4.0, 1.0], [7.0] * 6, [1.0, 0.0, 0.0], [1e8, 1.0, 1e-6],
    [3.0, 3.0 - 1e-9, 3.0 - 2e-9, 1.0], list(np.geomspace(1e6, 1e-2, 40)), [0.0, 0.0], [2.0]])
def test_spectrum_of_known_eigenvalues(values):
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))[0]
    a = q @ np.diag(values) @ q.T
    for top in (n, max(1, n // 2)):
        e, u = wh.spectrum(a, top)
        assert len(e) >= min(top, n)
        assert np.allclose(e[:top], sorted(values, reverse=True)[:top], rtol=1e-12, atol=1e-13 * max(values))
        assert np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-12)
        assert np.linalg.norm(a @ u - u * e) <= 1e-12 * n * max(1.0, np.linalg.norm(a))


def test_polar_factor_is_the_sign():
    for seed in range(5):
        m = np.random.default_rng(seed).standard_normal((9, 9))
        a = m + m.T
        e, v = np.linalg.eigh(a)
        assert np.allclose(wh.polar(a), v @ np.diag(np.sign(e)) @ v.T, atol=1e-10)
