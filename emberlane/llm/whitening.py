"""Operator 11: whitening of embeddings by principal components to double precision.

Sums and products over the distinct vectors are of integers and exact: each task makes the
matrix of its own rows, centred at the rounded mean, and rows of these matrices are added
by Spark, so any order and any retry gives the same covariance. Its eigenvectors come in
float32 from one small decomposition on the driver and are then corrected in extended
precision by the iteration of Ogita and Aishima: with R = I - X'X and S = X'VX an eigenvalue
is s_ii / (1 - r_ii), and X is multiplied by I + E with e_ij = (s_ij + l_j r_ij) / (l_j - l_i),
which squares the error. Eigenvalues too close for that division form clusters; within one
e_ij = r_ij / 2, and the basis of the cluster is then turned by the eigenvectors of its own
small matrix V - mean, whose eigenvalues are apart relative to their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm.common import materialize, table

#: Entries become floor(SCALE * c); components that are returned.
SCALE, COMPONENTS = 256, 4
#: Most rows that a task multiplies at a time; integers up to here are exact in a double.
ROWS, EXACT = 4096, 1 << 53
#: Most corrections of the eigenvectors; each squares the error, so about three change something.
ITERATIONS = 8
#: Eigenvalues within this part of the largest entry are one cluster.
CLOSE = 1e-6


@dataclass(frozen=True)
class Fit:
    """n distinct vectors, their exact sums, and eigenvectors (columns) by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def trace(self) -> float:
        return float(self.values.sum())

    @property
    def width(self) -> int:
        """Components that are returned: COMPONENTS, or fewer where vectors are shorter."""
        return min(COMPONENTS, len(self.sums))


def integer_rows(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x): floor(SCALE * c) of the entries as bigint, without rows whose vector is null, empty, or holds a null or non-finite entry."""
    c = F.col(vector)
    sound = F.coalesce(F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False)) & (F.size(c) > 0)
    return vectors.where(sound).select(F.col(key), F.transform(c, lambda e: F.floor(SCALE * e.cast("double")).cast("bigint")).alias("x"))


def _matrix(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _added(rows: DataFrame) -> dict[int, list[int]]:
    """Sums of the rows (i, values) by i: d rows of d exact integers, whatever the number of tasks."""
    cells = rows.select("i", F.posexplode("values").alias("j", "v")).groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out: dict[int, dict[int, int]] = {}
    for r in cells.collect():
        out.setdefault(r.i, {})[r.j] = int(r.v)
    return {i: [v[j] for j in range(len(v))] for i, v in out.items()}


def _rows(total: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([[str(v) for v in row] for row in total], pa.list_(pa.string()))], names=["i", "values"])


def moments(distinct: DataFrame, width: int) -> tuple[int, list[int], list[list[Fraction]]]:
    """Number of rows (x), their exact sums, and their exact covariance."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.slice(at, ROWS), 0, width)
                # halves keep each sum within 64 bits
                total += np.array([len(x), *((int(h) << 32) + int(l) for h, l in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)))], object)
        yield _rows([total.tolist()])

    n, *total = _added(distinct.mapInArrow(sums, "i int, values array<string>"))[0]
    centre = [int(Fraction(2 * s + n, 2 * n).__floor__()) for s in total]
    middle = np.array(centre, np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.slice(at, ROWS), 0, width)
                y = x - middle if abs(x.astype(float)).max() < EXACT else x.astype(object) - middle
                if len(y) * int(max(abs(int(y.max())), abs(int(y.min())))) ** 2 < EXACT:
                    y = y.astype(float)
                    out += (y.T @ y).astype(np.int64).astype(object)
                else:
                    y = y.astype(object)
                    out += y.T @ y
        yield _rows(out.tolist())

    cells = _added(distinct.mapInArrow(products, "i int, values array<string>"))
    off = [Fraction(s, n) - c for s, c in zip(total, centre)]
    return n, total, [[Fraction(cells[i][j], n) - off[i] * off[j] for j in range(width)] for i in range(width)]


def _extended(v: Fraction) -> np.longdouble:
    """The nearest extended number but for its last bits: a double and the double nearest to what it leaves."""
    high = float(v)
    return np.longdouble(high) + np.longdouble(float(v - Fraction(high)))


def clusters(values: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(from, to) of runs of sorted eigenvalues whose neighbours differ by at most ``least``."""
    cuts = [0, *(np.flatnonzero(np.abs(np.diff(values)) > least) + 1).tolist(), len(values)]
    return list(zip(cuts, cuts[1:]))


def refine(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of v (symmetric, extended) from approximate vectors x, corrected until they stand still."""
    x = x.astype(np.longdouble)
    one = np.eye(len(v), dtype=np.longdouble)
    scale, before = np.longdouble(np.abs(v).max()) or np.longdouble(1), np.inf
    for step in range(ITERATIONS):
        r, s = one - x.T @ x, x.T @ (v @ x)
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
        rest = s - np.diag(values)
        # below this distance the division would enlarge the rounding of s and r
        close = max(float(scale) * CLOSE, 2 * (np.linalg.norm(rest.astype(float)) + float(scale) * np.linalg.norm(r.astype(float))))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= close
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ e
        size = float(np.abs(e).max())
        for a, b in clusters(values, close):
            if b - a > 1:
                x[:, a:b] = _turned(v, x[:, a:b], values[a:b].mean())
        if step > 1 and size >= before / 2:
            break
        before = size
    x = _orthogonal(_orthogonal(x))
    values = ((v @ x) * x).sum(axis=0) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def _orthogonal(x: np.ndarray) -> np.ndarray:
    """One step towards the nearest orthonormal columns; it squares the error."""
    return x @ (1.5 * np.eye(x.shape[1], dtype=np.longdouble) - 0.5 * (x.T @ x))


def _turned(v: np.ndarray, x: np.ndarray, mean: np.longdouble) -> np.ndarray:
    """The basis x of a cluster, turned to the eigenvectors of its own small matrix v - mean."""
    x = _orthogonal(x)
    small = x.T @ (v @ x - mean * x)
    _, turn = np.linalg.eigh(((small + small.T) / 2).astype(float))
    return x @ turn[:, ::-1].astype(np.longdouble)


def eigen(covariance: list[list[Fraction]]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of an exact covariance, each with its entry of largest size positive."""
    v = np.array([[_extended(c) for c in row] for row in covariance], np.longdouble)
    scale = np.abs(v).max() or np.longdouble(1)
    _, start = np.linalg.eigh((v / scale).astype(np.float32))
    values, x = refine(v / scale, start[:, ::-1])
    x = (x / np.sqrt((x * x).sum(axis=0))).astype(float)
    x *= np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(x))])
    return (values * scale).astype(float), x


def fit(distinct: DataFrame, width: int) -> Fit:
    """Model of the rows (x) of ``width`` bigints, each counted once."""
    n, sums, covariance = moments(distinct, width)
    values, vectors = eigen(covariance)
    return Fit(n, tuple(sums), values, vectors)


def projected(x: np.ndarray, model: Fit) -> np.ndarray:
    """x - S/n on the returned components over the root of their eigenvalues; null (nan) where an eigenvalue is nothing but rounding."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    part = np.array([float(Fraction(s % model.n, model.n)) for s in model.sums])
    e = model.values[:model.width]
    flat = e <= 1e-12 * max(model.trace, 0)
    z = ((x - whole).astype(float) - part) @ model.vectors[:, :model.width]
    return np.where(flat, np.nan, z / np.sqrt(np.where(flat, 1, e)))


def _deviations(x: np.ndarray, model: Fit) -> list[int | None]:
    """Sum over entries of (n x - S)^2, exact; null beyond a bigint."""
    s = np.array(model.sums, object)
    most = model.n * max(int(x.max()), -int(x.min()), 1) + max(map(abs, model.sums), default=0)
    if most < 1 << 62 and most * most * len(model.sums) < 1 << 63:
        y = x * model.n - s.astype(np.int64)
        return (y * y).sum(axis=1).tolist()
    y = x.astype(object) * model.n - s
    return [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1)]


def identity_error(distinct: DataFrame, model: Fit) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity, measured by a pass over them; components without variance are left out."""
    k = model.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = projected(_matrix(batch, 0, len(model.sums)), model)
            yield pa.RecordBatch.from_arrays([pa.array(z[:, i]) for i in range(k)], names=[f"z{i}" for i in range(k)])

    live = [i for i in range(k) if model.values[i] > 1e-12 * max(model.trace, 0)]
    z = distinct.mapInArrow(run, ", ".join(f"z{i} double" for i in range(k)))
    pairs = [(i, j) for i in live for j in live if i <= j]
    if not pairs:
        return 0.0
    cov = z.agg(*(F.covar_pop(f"z{i}", f"z{j}") for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))


def whiten(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x, n, deviation, whitened, explained, identity_error) of each row with a sound vector.

    whitened and explained are arrays, an entry for each of the first COMPONENTS components
    (fewer where vectors are shorter). Rows whose vector is null, empty or holds a null or
    non-finite entry go; repeated rows stay, and count once in the fit. A component without
    variance has a null whitened. deviation is null where it exceeds a bigint; entries beyond
    a bigint become its ends. All vectors
    must have one length: others raise a ValueError. Without a row there are none.
    """
    rows = materialize(integer_rows(vectors, vector=vector, key=key), name="integers")
    width, most = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    name = rows.schema[0]
    kind = f"`{key}` {name.dataType.simpleString()}, x array<bigint>, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    if width is None:
        return vectors.sparkSession.createDataFrame([], kind)
    if width != most:
        raise ValueError(f"vectors have {width} to {most} entries")
    distinct = materialize(rows.select("x").distinct(), name="distinct")
    model = fit(distinct, width)
    error = identity_error(distinct, model)
    explained = [float(v) / model.trace if model.trace else None for v in model.values[:model.width]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part, 1, width)
                z = projected(x, model)
                lists = pd.Series(list(z)).map(lambda v: [None if e != e else e for e in v.tolist()])
                columns = [part.column(0), part.column(1), pa.array([model.n] * len(x), pa.int64()), pa.array(_deviations(x, model), pa.int64()), pa.array(lists, pa.list_(pa.float64())), pa.array([explained] * len(x), pa.list_(pa.float64())), pa.array([error] * len(x))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "x", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, kind)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "e")
    return rows.select("vec_id", "n", "deviation", "identity_error", each).select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("e.whitened").alias("whitened"), F.col("e.explained").alias("explained"), "identity_error")


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
#: Eigenvectors have no SQL; tests hold the rows against a decomposition in numpy.
ORACLE: dict[str, str] = {}
