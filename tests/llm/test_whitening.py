"""Operator 11."""

import math
from fractions import Fraction

import numpy as np
import pytest

from emberlane.llm import whitening


def check_rows(rows, vectors):
    """Rows of the query against numpy over the distinct integer vectors."""
    x = {i: np.array([math.floor(256 * float(c)) for c in v], object) for i, v in vectors.items()}
    distinct = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, sums = len(distinct), distinct.sum(axis=0)
    y = (distinct - sums / n).astype(float)
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert {(r.vec_id, r.component) for r in rows} == {(i, c) for i in x for c in range(1, min(4, y.shape[1]) + 1)}
    signs = {}
    for r in rows:
        k = r.component - 1
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - sums) ** 2).sum())
        want = float((x[r.vec_id] - sums / n).astype(float) @ axes[:, k] / math.sqrt(values[k]))
        sign = signs.setdefault(k, math.copysign(1, want * r.whitened) if abs(want) > 1e-6 else None)
        assert abs(r.whitened - (sign or 1) * want) < 1e-8
        assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_op11_against_numpy(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    check_rows(whitening.op11_embedding_whitening(spark, sf_dir).collect(), vectors)


def flat(spark, rows):
    """The rows as the query gives them."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string")
    out = whitening.whiten(df).collect()
    return {r.vec_id: r for r in out}, out


def test_odd_vectors(spark):
    rnd = np.random.default_rng(11)
    good = {i: rnd.normal(size=6).astype(np.float32).tolist() for i in range(40)}
    rows = [(i, v, "x") for i, v in good.items()] + [(i, good[0], "x") for i in range(100, 200)]
    bad = [(300, None, "x"), (301, [], "x"), (302, [float("nan")] * 6, "x"), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (304, [float("inf")] * 6, "x")]
    got, out = flat(spark, rows + bad + [(0, good[0], "x")])
    assert len(out) == 141 and set(got) == set(good) | set(range(100, 200)) and got[0].n == 40
    again, _ = flat(spark, rows)
    assert {i: (r.whitened, r.deviation) for i, r in got.items()} == {i: (r.whitened, r.deviation) for i, r in again.items()}
    assert flat(spark, [r for r in bad])[1] == []
    assert flat(spark, [])[1] == []
    with pytest.raises(ValueError):
        flat(spark, rows + [(1000, [1.0], "x")])
    # one vector has no variance; two of one entry have one component
    got, _ = flat(spark, [(1, [0.5, -0.5], "x")])
    assert got[1].whitened == [None, None] and got[1].deviation == 0 and got[1].explained == [None, None]
    got, _ = flat(spark, [(1, [0.5], "x"), (2, [-0.5], "x")])
    assert sorted(r.whitened[0] for r in got.values()) == [-1.0, 1.0] and got[1].identity_error == 0
    # sums beyond a bigint stay exact, deviations beyond it are null
    got, _ = flat(spark, [(1, [1e16], "x"), (2, [1e15], "x"), (3, [3e16], "x")])
    assert got[1].deviation is None and all(r.n == 3 for r in got.values())


def exact(m):
    return [[Fraction(float(c)) for c in row] for row in m]


@pytest.mark.parametrize("values", [[9, 5, 3, 1, 0.5], [4, 4, 4, 1, 1], [1 + 1e-9, 1, 1 - 1e-9, 1e-3, 1e-3 + 1e-12], [7, 0, 0, 0, 0], [2, 2, 2, 2, 2]])
def test_corrected_eigenvectors(values):
    """Orthogonal to double precision, with small residuals, clustered eigenvalues included."""
    rnd = np.random.default_rng(5)
    q, _ = np.linalg.qr(rnd.normal(size=(5, 5)))
    m = q @ np.diag(values) @ q.T
    m = (m + m.T) / 2
    got, x = whitening.eigen(exact(m))
    assert np.all(np.diff(got) <= 1e-15)
    assert np.abs(x.T @ x - np.eye(5)).max() < 1e-15
    assert np.abs(m @ x - x * got).max() < 2e-15 * max(values)
    assert np.abs(got - np.sort(values)[::-1]).max() < 5e-15 * max(values)


def test_eigenvectors_of_a_large_spectrum():
    rnd = np.random.default_rng(6)
    y = rnd.normal(size=(300, 64)) * np.geomspace(1, 1e-3, 64)
    m = y.T @ y
    m = (m + m.T) / 2
    got, x = whitening.eigen(exact(m))
    assert np.abs(x.T @ x - np.eye(64)).max() < 2e-15
    assert np.abs(m @ x - x * got).max() < 4e-15 * np.abs(m).max() * 8
