"""Whitening of embeddings: a distributed covariance, its leading eigenvectors, a broadcast projection.

Entry c of a vector becomes the integer x = floor(scale * c) + shift. One pass adds up the
vectors, a second one the products of x less the whole part of its dimension's mean: integers,
so all sums are exact and do not depend on the order of tasks; what is left of the mean (below
one unit) comes off in rational arithmetic. Only the d x d matrix reaches the driver. There
Householder reflections make it tridiagonal, Sturm counts bisect for the leading eigenvalues,
and inverse iteration with reorthogonalised clusters gives the vectors, which travel to the
tasks as a d x k matrix. A third pass measures the covariance of the whitened values.

Rows whose vector is null or holds null or non-finite entries are dropped. Repeated rows and
rows without vec_id count like others. Shorter vectors are padded with zeros. Directions
without variance (below ``RANK`` of the largest) have no components; so one vector alone, equal
vectors and an empty table give no rows. ``deviation`` is null where it passes a long;
``distance``, the squared distance from the mean, always has a value. Entries beyond 2^62 after
scaling have no long x and raise. Columns besides vec_id and embedding don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.sums import matrix_sum

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
RANK = 1e-10  # of the largest eigenvalue
_BITS = 31  # long sums travel as two longs
_EPS = np.finfo(float).eps


class Fit(NamedTuple):
    n: int  # vectors
    sums: list[int]  # of each dimension's x
    values: np.ndarray  # leading eigenvalues, falling
    components: np.ndarray  # d x k
    trace: float


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix."""
    a, n = a.copy(), len(a)
    reflectors: list[np.ndarray | None] = []
    off = np.zeros(max(n - 1, 0))
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        if not np.any(x[1:]):
            off[k] = x[0]
            reflectors.append(None)
            continue
        off[k] = -np.copysign(np.linalg.norm(x), x[0])
        x[0] -= off[k]
        v = x / np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        reflectors.append(v)
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return np.diag(a).copy(), off, reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eigenvalues of the tridiagonal matrix below each point: negative pivots of T - point."""
    tiny = np.finfo(float).tiny * max(1.0, float((off**2).max(initial=0.0)))
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off, strict=True):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - at - e * e / pivot
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, bisected until the interval is a rounding error wide."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[1:] += np.abs(off)
    reach[:-1] += np.abs(off)
    width = max(np.abs(diagonal).max() + reach.max(), np.finfo(float).tiny)
    low, high = np.full(k, (diagonal - reach).min() - _EPS * width), np.full(k, (diagonal + reach).max() + _EPS * width)
    wanted = n - np.arange(k)  # so many eigenvalues lie at or below the one sought
    for _ in range(2000):
        middle = (low + high) / 2
        if np.all((high - low <= _EPS * np.maximum(np.abs(low), np.abs(high))) | (middle <= low) | (middle >= high) | (high - low <= _EPS * _EPS * width)):
            break
        enough = sturm_counts(diagonal, off, middle) >= wanted
        high, low = np.where(enough, middle, high), np.where(enough, low, middle)
    return (low + high) / 2


def _factored(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray):
    """LU factors with row exchanges of T - shift, for all shifts at once."""
    n, k = len(diagonal), len(shifts)
    least = _EPS * max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    d = diagonal[:, None] - shifts[None, :]
    upper = np.repeat(np.append(off, 0.0)[:, None], k, axis=1)
    second, factor, exchanged = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k), bool)
    for i in range(n - 1):
        below = np.full(k, off[i])
        swap = np.abs(below) > np.abs(d[i])
        pivot = np.where(swap, below, np.where(np.abs(d[i]) < least, least, d[i]))
        factor[i] = np.where(swap, d[i], below) / pivot
        next_d, next_upper = d[i + 1].copy(), upper[i + 1].copy()
        d[i + 1] = np.where(swap, upper[i] - factor[i] * next_d, next_d - factor[i] * upper[i])
        upper[i + 1] = np.where(swap, -factor[i] * next_upper, next_upper)
        second[i] = np.where(swap, next_upper, 0.0)
        upper[i] = np.where(swap, next_d, upper[i])
        d[i], exchanged[i] = pivot, swap
    d[n - 1] = np.where(np.abs(d[n - 1]) < least, least, d[n - 1])
    return d, upper, second, factor, exchanged


def _solved(factors, right: np.ndarray) -> np.ndarray:
    d, upper, second, factor, exchanged = factors
    n, y = len(d), right.copy()
    for i in range(n - 1):
        here, there = np.where(exchanged[i], y[i + 1], y[i]), np.where(exchanged[i], y[i], y[i + 1])
        y[i], y[i + 1] = here, there - factor[i] * here
    y[n - 1] /= d[n - 1]
    if n > 1:
        y[n - 2] = (y[n - 2] - upper[n - 2] * y[n - 1]) / d[n - 2]
    for i in range(n - 3, -1, -1):
        y[i] = (y[i] - upper[i] * y[i + 1] - second[i] * y[i + 2]) / d[i]
    return y


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Orthonormal eigenvectors by inverse iteration; values closer than 1e-3 of the norm are one cluster."""
    n, k = len(diagonal), len(values)
    norm = max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    shifts = values.copy()
    for i in range(1, k):  # equal values need shifts of their own
        shifts[i] = min(shifts[i], shifts[i - 1] - 10 * _EPS * norm)
    first = np.concatenate([[True], values[:-1] - values[1:] > 1e-3 * norm])
    begins = np.maximum.accumulate(np.where(first, np.arange(k), 0))
    factors = _factored(diagonal, off, shifts)
    y = np.random.default_rng(5).uniform(-1, 1, (n, k))
    for _ in range(rounds):
        y /= np.abs(y).max(axis=0)
        y = _solved(factors, y)
        y /= np.abs(y).max(axis=0)
        for j in range(k):
            for _ in range(2):
                before = y[:, begins[j] : j]
                y[:, j] -= before @ (before.T @ y[:, j])
            y[:, j] /= np.linalg.norm(y[:, j])
    return y


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    size = np.abs(matrix).max(initial=0.0)
    if not size:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, reflectors = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, k)
    vectors = leading_vectors(diagonal, off, values)
    for i in range(len(reflectors) - 1, -1, -1):
        v = reflectors[i]
        if v is not None:
            vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    return values * size, vectors


def usable_entries(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that take part, their lengths, and floor(scale * c) of all their entries in a row."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    row = np.repeat(np.arange(len(column)), lengths)
    usable = pc.is_valid(column).to_numpy(zero_copy_only=False)
    usable[row[~np.isfinite(flat)]] = False
    entries = np.floor(flat[usable[row]] * scale)
    if np.abs(entries).max(initial=0.0) >= 2.0**62:
        raise ValueError("an entry passes 2^62 after scaling")
    at = np.flatnonzero(usable)
    return at, lengths[at], entries.astype(np.int64)


def centred(lengths: np.ndarray, entries: np.ndarray, whole: np.ndarray, shift: int) -> np.ndarray:
    """A row of integers per vector: x less the whole part of the mean."""
    out = np.zeros((len(lengths), len(whole)), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(entries)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = entries
    return out + (shift - whole)


def _parts(numbers) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of integers of any size."""
    numbers = np.asarray(numbers)
    return (numbers >> _BITS).astype(np.int64), (numbers & ((1 << _BITS) - 1)).astype(np.int64)


def products(y: np.ndarray) -> np.ndarray:
    """The exact matrix y^T y."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * max(len(y), 1) < 2**53:
        return (y.T.astype(float) @ y.astype(float)).astype(np.int64)
    exact = y.astype(object)
    return exact.T @ exact


def _sums(vectors: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of x in each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((3, 1), np.int64)  # high and low parts by dimension; the number of vectors
        for batch in batches:
            at, lengths, entries = usable_entries(batch.column("embedding"), scale)
            place = np.arange(len(entries)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            more = int(lengths.max(initial=0)) - total.shape[1]
            total = np.pad(total, ((0, 0), (0, max(more, 0))))
            for line, part in enumerate(_parts(entries)):
                np.add.at(total[line], place, part)
            total[2, 0] += len(at)
        return total

    total = matrix_sum(vectors.select("embedding"), add)
    if total is None or not total[2, 0]:
        return 0, []
    n = int(total[2, 0])
    # shorter vectors have zeros there: x is the shift alone
    return n, [(high << _BITS) + low + n * shift for high, low in zip(total[0].tolist(), total[1].tolist(), strict=True)]


def covariance(vectors: DataFrame, n: int, sums: list[int], scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """The covariance of x with divisor n, each entry the nearest double to the exact one."""
    d = len(sums)
    whole = np.array([s // n for s in sums], np.int64)

    upper = np.triu_indices(d)

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, len(upper[0])), np.int64)
        for batch in batches:
            _, lengths, entries = usable_entries(batch.column("embedding"), scale)
            total += np.stack(_parts(products(centred(lengths, entries, whole, shift))[upper]))
        return total

    high, low = matrix_sum(vectors.select("embedding"), add).tolist()
    rest = [s - n * m for s, m in zip(sums, whole.tolist(), strict=True)]
    out = np.zeros((d, d))
    for i, j, h, s in zip(*(x.tolist() for x in upper), high, low, strict=True):
        out[i, j] = out[j, i] = (n * ((h << _BITS) + s) - rest[i] * rest[j]) / (n * n)
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Fit | None:
    """The leading components of all usable vectors; None if there are none with variance."""
    n, sums = _sums(vectors, scale, shift)
    if not n or not sums:
        return None
    matrix = covariance(vectors, n, sums, scale, shift)
    values, found = leading_eigenpairs(matrix, min(components, len(sums)))
    keep = values > max(RANK * values[0], 0.0)
    return Fit(n, sums, values[keep], found[:, keep], float(np.trace(matrix))) if keep.any() else None


def _projector(fitted: Fit, shift: int, scale: int):
    whole = np.array([s // fitted.n for s in fitted.sums], np.int64)
    rest = np.array([s % fitted.n for s in fitted.sums], object)
    part = np.array([r / fitted.n for r in rest.tolist()])
    matrix = fitted.components / np.sqrt(fitted.values)

    def project(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, integers less the whole part of the mean, doubles less the mean, whitened values."""
        at, lengths, entries = usable_entries(column, scale)
        y = centred(lengths, entries, whole, shift)
        exact = y - part
        return at, y, exact, exact @ matrix

    return project, rest


def identity_error(vectors: DataFrame, fitted: Fit, scale: int = SCALE, shift: int = SHIFT) -> float:
    """The largest absolute entry of the whitened values' covariance less the identity."""
    project, _ = _projector(fitted, shift, scale)
    k = len(fitted.values)

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = project(batch.column("embedding"))[3]  # centred: the mean of x came off before
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        return total

    total = matrix_sum(vectors.select("embedding"), add, float) / fitted.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, distance`` of all usable rows."""
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, distance double"
    )
    fitted = fit(vectors, components, scale, shift)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, fitted, scale, shift)
    project, rest = _projector(fitted, shift, scale)
    k, n, names = len(fitted.values), fitted.n, [c.split()[0] for c in schema.split(", ")]
    explained = fitted.values / fitted.trace

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, y, exact, w = project(batch.column("embedding"))
            if not len(at):
                continue
            largest = n * (int(np.abs(y).max(initial=0)) + 1)
            if y.shape[1] * largest * largest < 2**63:
                deviation = ((n * y - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = ((n * y.astype(object) - rest) ** 2).sum(axis=1).tolist()
                deviation = [v if v < 2**63 else None for v in deviation]
            rows = np.repeat(np.arange(len(at)), k)
            number = np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(at[rows])), pa.array(number), pa.array(np.full(len(rows), n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(rows)), pa.array(w.ravel()), pa.array(explained[number - 1]),
                    pa.array(np.full(len(rows), error)), pa.array((exact**2).sum(axis=1)[rows]),
                ],
                names,
            )

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(emit, schema)
