"""Embedding whitening: leading components of the covariance by spectrum slicing.

Rows pass three times: exact integer sums, the centred covariance (d x d partial sums of each task), and
the covariance of what was whitened. The d x d eigenproblem is the driver's; nothing of the size of the
table leaves the tasks.

An LDLᵀ factorisation of the covariance less a shift has as many negative pivots as there are eigenvalues
below the shift. These counts bisect the spectrum until an interval holds one eigenvalue; Rayleigh
quotient iteration then converges cubically inside it, and two more counts close around the result
certify its number. Eigenvalues that no shift separates are taken as one cluster with any orthonormal basis.

Rows whose vector is null or empty, or holds a null or non-finite entry, go. So do vectors whose length
is not the most frequent one (the longer of equally frequent ones). Repeated rows and ids, and null ids,
count as they stand. Components without variance don't exist: they get no row. An empty table gives an
empty result. Scaled entries beyond 2^62 saturate; a deviation beyond 64 bits is null. Input columns other
than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SCALE, OFFSET = 64.0, 1_000_000
COMPONENTS = 32
EPSILON = np.finfo(float).eps
SLICE_ROWS = 8_192
LIMIT = 2.0**62


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues below the shift: negative pivots of LDLᵀ with symmetric pivoting in blocks of one or two."""
    a = matrix - shift * np.eye(len(matrix))
    negative, k, n = 0, 0, len(a)
    bound = (1 + np.sqrt(17)) / 8
    while k < n:
        size, pivot = 1, k
        column = np.abs(a[k + 1 :, k])
        if len(column) and (largest := column.max()) > 0 and abs(a[k, k]) < bound * largest:
            r = k + 1 + int(column.argmax())
            others = np.abs(a[r, k:])
            others[r - k] = 0
            if abs(a[k, k]) * others.max() < bound * largest**2:
                pivot, size = (r, 1) if abs(a[r, r]) >= bound * others.max() else (r, 2)
        at = k + size - 1
        if pivot != at:
            a[[at, pivot], k:] = a[[pivot, at], k:]
            a[k:, [at, pivot]] = a[k:, [pivot, at]]
        if size == 1:
            d = a[k, k] or EPSILON * np.abs(matrix).max() or EPSILON
            negative += bool(d < 0)
            left = a[k + 1 :, k] / d
            a[k + 1 :, k + 1 :] -= np.outer(left, a[k + 1 :, k])
        else:
            block = a[k : k + 2, k : k + 2]
            determinant = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            negative += 1 if determinant < 0 else 2 * bool(block[0, 0] < 0)
            left = a[k + 2 :, k : k + 2] @ np.linalg.inv(block)
            a[k + 2 :, k + 2 :] -= left @ a[k + 2 :, k : k + 2].T
        k += size
    return negative


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as rows; fewer if variance ends before."""
    d = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    if norm == 0:
        return np.empty(0), np.empty((0, d))
    least = 4 * d * EPSILON * norm
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = d - inertia(matrix, shift)
        return counts[shift]

    wanted = min(count, above(least))
    values, vectors = [], np.empty((0, d))
    while len(values) < wanted:
        taken = len(values)
        # The tightest known interval that holds eigenvalue number taken + 1.
        low = max(s for s in [least, *counts] if s >= least and above(s) > taken)
        high = min([s for s in counts if s > low and above(s) <= taken], default=norm * (1 + 8 * d * EPSILON))
        while above(low) - taken > 1 and high - low > least:
            middle = (low + high) / 2
            if above(middle) > taken:
                low = middle
            else:
                high = middle
        held = min(above(low) - taken, wanted - taken)
        found, basis = (
            _rayleigh(matrix, low, high, taken, above, vectors, least) if held == 1 else _cluster(matrix, (low + high) / 2, held, vectors)
        )
        values.extend(found)
        vectors = np.vstack([vectors, basis])
    return np.array(values), vectors


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    shifted = matrix - shift * np.eye(len(matrix))
    try:
        solved = np.linalg.solve(shifted, right)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        solved = np.linalg.solve(shifted + EPSILON * np.abs(matrix).max() * np.eye(len(matrix)), right)
    return solved


def _orthogonal(block: np.ndarray, to: np.ndarray) -> np.ndarray:
    for _ in range(2):
        block = block - to.T @ (to @ block)
    return block


def _start(d: int, columns: int) -> np.ndarray:
    return np.random.default_rng(d).standard_normal((d, columns))


def _rayleigh(matrix, low, high, taken, above, vectors, least) -> tuple[list[float], np.ndarray]:
    """The one eigenpair of an interval, certified by the counts on both sides of it."""
    while True:
        middle = (low + high) / 2
        v = _start(len(matrix), 1)
        for _ in range(2):  # inverse iteration puts the quotient near the middle
            v = _orthogonal(_solved(matrix, middle, v), vectors)
            v /= np.linalg.norm(v)
        for _ in range(12):
            value = float((v.T @ matrix @ v)[0, 0])
            if np.linalg.norm(matrix @ v - value * v) <= least / 16:
                break
            if not low <= value <= high:
                break
            v = _orthogonal(_solved(matrix, value, v), vectors)
            v /= np.linalg.norm(v)
        value = float((v.T @ matrix @ v)[0, 0])
        if above(value - least) == taken + 1 and above(value + least) == taken:
            return [value], v.T
        if high - low <= least:
            return [value], v.T
        if above(middle) > taken:
            low = middle
        else:
            high = middle


def _cluster(matrix, middle, held, vectors) -> tuple[list[float], np.ndarray]:
    """Eigenvalues closer than the precision: an orthonormal basis by inverse iteration of a block."""
    block = _start(len(matrix), held)
    for _ in range(4):
        block = np.linalg.qr(_orthogonal(_solved(matrix, middle, block), vectors))[0]
    quotients = np.einsum("ij,ij->j", block, matrix @ block)
    order = np.argsort(-quotients, kind="stable")
    return quotients[order].tolist(), block.T[order]


def scaled(values: pa.Array, d: int) -> np.ndarray:
    """floor(64 c) of lists of equal length, as rows."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.clip(np.floor(SCALE * flat), -LIMIT, LIMIT).astype(np.int64).reshape(-1, d)


def deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact. The offset cancels, so it takes y for x and its sums for S."""
    bound = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0)
    if bound * bound * len(sums) < 1 << 63:
        return ((n * y - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in y.tolist()]
    return [x if x < 1 << 63 else None for x in exact]


def centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, rounded once where 64 bits hold n x - S."""
    bound = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0)
    if bound < 1 << 53:
        return (n * y - np.array(sums, np.int64)) / n
    return np.array([[float(Decimal(n * v - s) / n) for v, s in zip(row, sums)] for row in y.tolist()]).reshape(y.shape)


def _slices(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield part, scaled(part.column(column), d)


def _by_row(partials: DataFrame) -> dict[int, np.ndarray]:
    """Sum of each task's d x d matrix, row by row: d rows come to the driver."""
    rows = partials.select("row", F.posexplode("sums").alias("at", "sum")).groupBy("row", "at").agg(F.sum("sum").alias("sum"))
    rows = rows.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "sum"))).alias("sums"))
    return {r["row"]: np.array([x["sum"] for x in r["sums"]]) for r in rows.collect()}


def usable(frame: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows whose vector is complete, finite and of the usual length, and that length (0 if there are none)."""
    column = F.col(f"`{vector}`").cast("array<double>")
    whole = frame.where(
        column.isNotNull() & (F.size(column) > 0)
        & F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    lengths = whole.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return whole.where(F.size(column) == d), d


def whitened(frame: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component, numbered from 1 by falling eigenvalue.

    Columns: the id, component, n, deviation, whitened, eigenvalue, explained, identity_error; see the module.
    """
    rows, d = usable(frame, vector)
    identity = f"`{vector_id}`"
    rows = rows.select(F.col(identity).alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, y in _slices(batches, 0, d):
            n += len(y)
            # Halves of 32 bits can't overflow in a slice.
            high, low = (y >> 32).sum(axis=0).tolist(), (y & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low)]
        yield pa.record_batch({"n": pa.array([n], pa.int64()), "sums": pa.array([[str(t) for t in total]], pa.list_(pa.string()))})

    partial = rows.select("v").mapInArrow(sums_of, "n long, sums array<string>")
    at = partial.select("n", F.posexplode("sums").alias("at", "sum")).groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")
    ).orderBy("at").collect()
    n, sums = (at[0]["n"], [int(r["sum"]) for r in at]) if at else (0, [])

    def covariance_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for _, y in _slices(batches, 0, d):
            z = centred(y, n, sums)
            total += z.T @ z
        yield pa.record_batch({"row": pa.array(range(d), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    if n:
        parts = _by_row(rows.select("v").mapInArrow(covariance_of, "row int, sums array<double>"))
        covariance = np.array([parts[i] for i in range(d)]) / n
        covariance = (covariance + covariance.T) / 2
    else:
        covariance = np.zeros((0, 0))
    values, vectors = leading_components(covariance, components)
    k, trace = len(values), float(np.trace(covariance))
    turn = (vectors / np.sqrt(values)[:, None]).T if k else np.empty((d, 0))

    def spread_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums and, centred on the mean of all (zero but for rounding), products.
        total = np.zeros((k + 1, k))
        for _, y in _slices(batches, 0, d):
            w = centred(y, n, sums) @ turn
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.record_batch({"row": pa.array(range(k + 1), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    error = None
    if k:
        parts = _by_row(rows.select("v").mapInArrow(spread_of, "row int, sums array<double>"))
        mean = parts[k] / n
        error = float(np.abs(np.array([parts[i] for i in range(k)]) / n - np.outer(mean, mean) - np.eye(k)).max())

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y in _slices(batches, 1, d):
            of = np.repeat(np.arange(len(y)), k)
            rank = np.tile(np.arange(k), len(y))
            w = centred(y, n, sums) @ turn
            yield pa.record_batch({
                "id": part.column(0).take(pa.array(of)), "component": pa.array(rank + 1, pa.int32()),
                "n": pa.array(np.full(len(of), n), pa.int64()),
                "deviation": pa.array(deviations(y, n, sums), pa.int64()).take(pa.array(of)),
                "whitened": w.reshape(-1), "eigenvalue": values[rank], "explained": values[rank] / trace if k else values[rank],
                "identity_error": pa.array([error] * len(of), pa.float64()),
            })

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(
        whiten, f"id {kind}, component int, n long, deviation long, whitened double, eigenvalue double, explained double, identity_error double"
    )
    return made.withColumnRenamed("id", vector_id)
