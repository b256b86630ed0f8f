"""Whitening of embeddings: leading principal components by block Jacobi-Davidson.

The covariance V is never formed. It is known by its products with a few columns at a
time: every task centres its chunks of the stored fit list and multiplies twice, and
Spark adds the partial products. An outer step takes the Ritz pairs of the subspace
(Rayleigh-Ritz), locks leading pairs whose residuals are at double precision, and
extends the subspace by corrections t of the others, from

    (I - QQ')(V - theta I)(I - QQ') t = -r,   Q: locked vectors and current Ritz vectors,

solved by a few steps of MINRES, all columns together, so that one step is one
distributed product. The first steps, whose Ritz values are too far off to be shifts,
take the residual itself. The driver holds columns of the length of a vector, at most
`SUBSPACE` of them, and no rows.

The fit list is each distinct integer vector once. Sums over it are exact integers.

Components x become floor(256 x). Defined cases: vectors that are null or hold null or
non-finite components are dropped; shorter vectors are filled with zeros up to the
longest, as an empty one is; a null vec_id and repeated rows each give their rows; the
deviation is null where it doesn't fit a long; components without variance are left
out, so equal vectors alone, one vector or an empty table give no rows; components of
equal variance are any orthonormal ones; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import materialize
from opsframe.llm.exact_topk import usable

SCALE = 256
GUARDS = 2
SUBSPACE = 40
INNER = 6
#: Outer steps after which a spectrum is given up on; a few are needed.
STEPS = 200

EPS = float(np.finfo(np.float64).eps)
_LONG = np.iinfo(np.int64).max
Product = Callable[[np.ndarray], np.ndarray]


def integers(lists: pa.Array, dims: int) -> np.ndarray:
    """Floored vectors, filled with zeros to dims."""
    flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), np.int64)
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def fit_list(vectors: DataFrame, dims: int) -> DataFrame:
    """(x binary): each distinct integer vector once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in integers(batch.column(0), dims)], pa.binary())], ["x"])

    return vectors.select("embedding").mapInArrow(run, "x binary").distinct()


def _chunks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        yield np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, dims)


def added(fits: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all chunks of part(chunk), doubles of one size: a row a task and slot, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in _chunks(batches, dims):
            total += part(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["slot", "value"])

    rows = fits.mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for slot, value in rows:
        out[slot] = value
    return out


def exact_sums(fits: DataFrame, dims: int) -> tuple[int, list[int], list[int]]:
    """Number of vectors, and per dimension the sums of components and of their squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * dims + 1, object)
        for x in _chunks(batches, dims):
            wide = x.astype(object) if int(np.abs(x).max(initial=0)) ** 2 * len(x) > _LONG else x
            total += np.array([len(x), *wide.sum(0).tolist(), *(wide**2).sum(0).tolist()], object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["slot", "value"])

    rows = {r["slot"]: int(r["value"]) for r in fits.mapInArrow(run, "slot long, value decimal(38,0)").groupBy("slot").agg(F.sum("value").alias("value")).collect()}
    return rows.get(0, 0), [rows.get(1 + i, 0) for i in range(dims)], [rows.get(1 + dims + i, 0) for i in range(dims)]


def orthonormal(columns: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns of the same span, orthogonal to those given; what those hold already goes."""
    norms = np.linalg.norm(columns, axis=0)
    columns = columns[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        for basis in against:
            columns = columns - basis @ (basis.T @ columns)
        norms = np.linalg.norm(columns, axis=0)
        columns = columns[:, norms > 1e-8] / norms[norms > 1e-8]
    if not columns.shape[1]:
        return columns
    q, r = np.linalg.qr(columns)
    q = q[:, np.abs(np.diag(r)) > 1e-8]
    for basis in against:
        q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0]


def minres(apply: Product, rhs: np.ndarray, steps: int, least: float = 0.05) -> np.ndarray:
    """x of least residual in `steps` Krylov steps of a symmetric operator, every column for itself."""
    x, older, old = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    beta = start = np.linalg.norm(rhs, axis=0)
    before, v = np.zeros_like(rhs), rhs / np.where(beta > 0, beta, 1)
    left, cos, sin, cos_old, sin_old = beta.copy(), *(np.full(len(beta), c) for c in (1.0, 0.0, 1.0, 0.0))
    beta = np.zeros_like(start)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * before
        following = np.linalg.norm(p, axis=0)
        # rotate the new column (beta, alpha, following) of the tridiagonal matrix to (third, second, first)
        third, middle = sin_old * beta, cos_old * beta
        second, first = cos * middle + sin * alpha, cos * alpha - sin * middle
        length = np.maximum(np.hypot(first, following), EPS)
        cos_old, sin_old, cos, sin = cos, sin, first / length, following / length
        older, old = old, (v - second * old - third * older) / length
        x = x + cos * left * old
        left = -sin * left
        before, v, beta = v, p / np.where(following > EPS, following, 1), following
        if (np.abs(left) <= least * start).all():
            break
    return x


def jacobi_davidson(product: Product, dims: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their vectors, of the symmetric operator behind product."""
    wanted = min(wanted, dims)
    block = min(dims, wanted + GUARDS)
    values, locked = [], np.zeros((dims, 0))
    basis = orthonormal(np.random.default_rng(seed).standard_normal((dims, block)))
    image = product(basis)
    scale = 0.0
    for _ in range(STEPS):
        small = basis.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, turned = basis @ s, image @ s
        scale = max(scale, abs(theta[0]))
        residual = turned - ritz * theta
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        done = 0
        while len(values) + done < wanted and done < len(theta) and norms[done] <= 16 * EPS * np.sqrt(dims) * scale:
            done += 1
        values += theta[:done].tolist()
        locked = np.hstack((locked, ritz[:, :done]))
        if len(values) == wanted:
            return np.array(values), locked
        theta, ritz, turned, residual, norms = theta[done:], ritz[:, done:], turned[:, done:], residual[:, done:], norms[done:]
        active = slice(0, min(len(theta), block - min(len(values), block - 1)))
        if ritz.shape[1] + block > min(SUBSPACE, dims - len(values)) and ritz.shape[1] > 2 * block:
            ritz = orthonormal(ritz[:, : 2 * block], locked)
            turned = product(ritz)
        near = norms[active] < 0.1 * np.abs(theta[active])
        step = -residual[:, active]
        if near.all() and near.size:
            around = np.hstack((locked, ritz[:, active]))
            outside = lambda y: y - around @ (around.T @ y)
            shift = theta[active]
            step = minres(lambda y: outside(product(outside(y)) - shift * y), outside(step), INNER)
        more = orthonormal(step, locked, ritz)
        if not more.shape[1] and ritz.shape[1] + len(values) < dims:
            more = orthonormal(np.random.default_rng(seed + len(values) + 1).standard_normal((dims, 1)), locked, ritz)
        if more.shape[1]:
            basis, image = np.hstack((ritz, more)), np.hstack((turned, product(more)))
        else:
            basis = orthonormal(ritz, locked)
            image = product(basis)
    raise ArithmeticError("the residuals don't reach double precision")


def principal_components(fits: DataFrame, dims: int, n: int, sums: list[int], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (dims x wanted) of the fit list's covariance."""
    mean = np.array([float(Fraction(s, n)) for s in sums])

    def product(columns: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ columns)

        return added(fits, dims, part, columns.size).reshape(columns.shape) / n

    return jacobi_davidson(product, dims, wanted)


def identity_error(fits: DataFrame, dims: int, n: int, mean: np.ndarray, project: np.ndarray) -> float:
    k = project.shape[1]

    def part(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ project
        return np.vstack((white.T @ white, white.sum(0)))

    total = added(fits, dims, part, (k + 1) * k).reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if most**2 * max(1, x.shape[1]) <= _LONG:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(1).tolist()
    found = ((n * x.astype(object) - sums) ** 2).sum(1)
    return [int(v) if v <= _LONG else None for v in found]


def whiten(spark: SparkSession, vectors: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error: a row a vector and component."""
    good = vectors.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    dims = good.agg(F.max(F.size("embedding"))).head()[0] or 0
    fits = materialize(spark, fit_list(good, dims), "fit_list") if dims else None
    n, sums, squares = exact_sums(fits, dims) if dims else (0, [], [])
    trace = sum((Fraction(n * q - s * s, n * n) for s, q in zip(sums, squares)), Fraction(0))
    if trace:
        values, axes = principal_components(fits, dims, n, sums, components)
        real = values > 16 * EPS * dims * values[0]
        values, axes = values[real], axes[:, real]
        mean, project = np.array([float(Fraction(s, n)) for s in sums]), axes / np.sqrt(values)
        error = identity_error(fits, dims, n, mean, project)
        explained = [float(v / float(trace)) for v in values]
    else:
        values, mean, project, error, explained = np.zeros(0), np.zeros(dims), np.zeros((dims, 0)), 0.0, []
    k, total = len(values), np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), dims)
            m = len(x)
            deviation = pa.array(deviations(x, n, total) if k else [None] * m, pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), deviation.take(each),
                    pa.array(((x - mean) @ project).ravel()), pa.array(np.tile(np.array(explained), m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return good.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
