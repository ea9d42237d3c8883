"""Whitening of embeddings by their leading components.

Tasks sum the centred outer products of their rows; partial matrices are added row by row in two
rounds, so that no task gets the matrices of all others. The driver holds one matrix of the
embedding's dimensions, whatever the number of rows: Householder reflections make it tridiagonal,
Sturm counts bisect the leading eigenvalues, inverse iteration finds their vectors (vectors of close
eigenvalues are made orthogonal in every round), and the components go out with the projection.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: An entry c becomes floor(SCALE * c).
SCALE = 256
COMPONENTS = 4
#: Entries of 2**53 / SCALE and more have no exact long in double arithmetic.
LARGEST = float(2**53 // SCALE)
#: Groups of the first round when partial sums are added.
FIRST_ROUND = 64
#: Eigenvalues closer than this, against the norm of the matrix, form a cluster; components below the
#: second are noise of the arithmetic.
CLUSTER, NOISE = 1e-3, 1e-12


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit Householder vectors of a symmetric matrix."""
    a = np.array(matrix, dtype=float)
    reflectors = []
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        alpha = -math.copysign(float(np.linalg.norm(u)), u[0])
        u[0] -= alpha
        length = float(np.linalg.norm(u))
        u = u / length if length else u
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        q = 2 * (p - (u @ p) * u)
        rest -= np.outer(u, q) + np.outer(q, u)
        if length:
            a[k + 1, k] = alpha
        reflectors.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each x: negative terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    below, q = np.zeros(np.shape(x), dtype=int), np.ones(np.shape(x))
    for d, e in zip(diagonal, np.concatenate([[0.0], off])):
        q = d - x - e**2 / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection inside the Gershgorin discs."""
    reach = np.abs(np.concatenate([off, [0]])) + np.abs(np.concatenate([[0], off]))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    rank = len(diagonal) - 1 - np.arange(k)
    high = high + np.spacing(np.abs(high))
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        above = sturm(diagonal, off, middle) > rank
        low, high = np.where(above, low, middle), np.where(above, middle, high)


def _solver(diagonal: np.ndarray, off: np.ndarray, x: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solve (T - x) y = b by elimination with row exchanges; a vanished pivot is replaced by rounding noise."""
    n = len(diagonal)
    least = max(float(np.abs(diagonal).max()), float(np.abs(off).max()) if n > 1 else 0.0, np.finfo(float).tiny) * np.finfo(float).eps
    d, u, w = (diagonal - x).tolist(), [*off.tolist(), 0.0], [0.0] * n
    factor, swapped = [0.0] * n, [False] * n
    for i in range(n - 1):
        below = float(off[i])
        if abs(below) > abs(d[i]):
            swapped[i] = True
            factor[i] = d[i] / below
            d[i], u[i], w[i], d[i + 1], u[i + 1] = below, d[i + 1], u[i + 1], u[i] - factor[i] * d[i + 1], -factor[i] * u[i + 1]
        else:
            d[i] = d[i] if abs(d[i]) > least else least
            factor[i] = below / d[i]
            d[i + 1] -= factor[i] * u[i]
    d[-1] = d[-1] if abs(d[-1]) > least else least

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.tolist()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i] - factor[i] * y[i + 1]
            else:
                y[i + 1] -= factor[i] * y[i]
        for i in range(n - 1, -1, -1):
            s = y[i] - (u[i] * y[i + 1] if i + 1 < n else 0.0) - (w[i] * y[i + 2] if i + 2 < n else 0.0)
            y[i] = s / d[i]
        return np.array(y)

    return solve


def components(matrix: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows."""
    n = len(matrix)
    k = min(k, n)
    size = float(np.abs(matrix).max()) if n else 0.0
    if not size:
        return np.zeros(k), np.eye(n)[:k]
    diagonal, off, reflectors = tridiagonal(matrix / size)
    values = leading(diagonal, off, k)
    norm = float(np.abs(diagonal).max() + 2 * (np.abs(off).max() if n > 1 else 0))
    draws = np.random.default_rng(1)
    vectors: list[np.ndarray] = []
    shift = math.inf
    for i, value in enumerate(values):
        cluster = [v for v, e in zip(vectors, values) if e - value < CLUSTER * norm]
        shift = min(float(value), shift - 10 * np.finfo(float).eps * norm)
        solve = _solver(diagonal, off, shift)
        v = draws.standard_normal(n)
        for _ in range(5):
            v = solve(v / np.linalg.norm(v))
            v /= np.abs(v).max()
            for other in cluster * 2:
                v = v - (other @ v) * other
        vectors.append(v / np.linalg.norm(v))
    out = np.array(vectors)
    for j in range(len(reflectors) - 1, -1, -1):
        u = reflectors[j]
        out[:, j + 1 :] -= 2 * np.outer(out[:, j + 1 :] @ u, u)
    # Rayleigh quotients on the matrix itself.
    return np.einsum("ij,jk,ik->i", out, matrix, out), out


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x (array of longs) of the rows that can be read.

    Rows whose vector is null or empty, holds null or non-finite entries or such of ``LARGEST`` and
    more in size are dropped.
    """
    fine = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))
    return embeddings.filter("embedding is not null").filter(fine & (F.size("embedding") > 0)).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(fit: DataFrame, d: int) -> list[int]:
    """Sum per dimension as exact numbers: high and low parts are added apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            high += (x >> 27).sum(axis=0)
            low += (x & ((1 << 27) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "i bigint, high bigint, low bigint").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    sums = [0] * d
    for row in parts.collect():  # one row per dimension
        sums[row.i] = (row.high << 27) + row.low
    return sums


def _second_moments(fit: DataFrame, size: int, view: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the outer products of the rows as ``view`` gives them: a matrix of size x size.

    Every task emits the rows of its matrix; rows of the same number are added in two rounds, in the order of tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = view(_matrix(batch.column(0)))
            total += x.T @ x
        task = np.full(size, TaskContext.get().partitionId(), dtype=np.int64)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * size, pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(task), rows], names=["i", "task", "row"])

    def add(group: pa.Table) -> pa.Table:
        order = group.sort_by("task")
        total = np.array(order.column("row").to_pylist()).sum(axis=0)
        return pa.table({"i": order.column("i")[:1], "task": order.column("task")[:1], "row": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema = "i bigint, task bigint, row array<double>"
    parts = fit.select("x").mapInArrow(run, schema)
    parts = parts.groupBy("i", F.pmod("task", F.lit(FIRST_ROUND)).alias("_first")).applyInArrow(lambda _, group: add(group), schema)
    out = np.zeros((size, size))
    for row in parts.groupBy("i").applyInArrow(add, schema).collect():  # one row per dimension
        out[row.i] = row.row
    return (out + out.T) / 2


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """One row per readable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    The fit list holds each distinct vector once. Of vectors of several lengths those of the most
    frequent one (the longest of ties) are read. Components whose eigenvalue vanishes against the trace
    have no scale and are left out; so an empty table, or one distinct vector, gives no rows. deviation
    is null where it is no long. Equal rows give equal rows; other columns are left aside.
    """
    spark = embeddings.sparkSession
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    read = stored(vectors(embeddings), "vectors")
    lengths = read.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths.d
    read = read.filter(F.size("x") == d)
    fit = stored(read.select("x").distinct(), "fit")
    n = fit.count()
    sums = _sums(fit, d)
    # The mean is a whole part and a fraction: differences of large numbers stay exact.
    whole, left = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64)
    fraction = left / n

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - fraction

    covariance = _second_moments(fit, d, centred) / n
    trace = float(np.trace(covariance))
    values, axes = components(covariance, k)
    some = values > NOISE * trace
    values, axes = values[some], axes[some]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    axes = axes / np.sqrt(values)[:, None]
    explained = values / trace
    moments = _second_moments(fit, k, lambda x: centred(x) @ axes.T) / n
    error = float(np.abs(moments - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            rows = len(x)
            far = x - whole
            if float(n) ** 2 * d * (float(np.abs(far).max()) + 1) ** 2 < 2**62:
                deviation = ((n * far - left) ** 2).sum(axis=1).tolist()
            else:
                exact = ((n * far.astype(object) - left.astype(object)) ** 2).sum(axis=1)
                deviation = [int(v) if v < 2**63 else None for v in exact]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)), pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array((centred(x) @ axes.T).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return read.select("vec_id", "x").mapInArrow(run, schema)
