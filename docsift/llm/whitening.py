"""Whitening of vectors by principal components from cyclic Jacobi rotations.

Vectors become integers, and each distinct one counts once in the fit.  Sums come
first; then every task centres its rows and multiplies them, the tasks' scatter
matrices are added up row by row, and the driver gets one matrix of the vectors'
length.  It rotates pairs of dimensions, one pair after the other, until every
off-diagonal entry is lost in rounding against its two diagonal ones.  Small eigenvalues
come out as accurate, relative to themselves, as large ones.  The sorted and scaled
components are broadcast and applied where the rows are.

Centring is by the whole number next to the mean, so products and their sums are
whole numbers and exact in doubles up to 2^53; what is left of the mean is taken
off in whole-number arithmetic on the driver.

Defined results: a vector that is null, or holds a null or a number that is not
finite, takes no part; vectors are fitted with those of their own length, and empty
ones give no rows; repeated rows and ids are rows of their own; a component whose
variance is zero up to rounding cannot be whitened, so its ``whitened`` is null, as is
``identity_error`` where there is no other; signs make a component's largest entry
positive; components whose eigenvalues are equal are in any order; scaled components
beyond 2^60 and deviations beyond 64 bits are held at the ends of these ranges; extra columns,
whatever their names, play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm._spark import partitions, staged
from docsift.llm.vafile import usable

SCALE, ORIGIN = 64, 1_000_000
COMPONENTS = 16
_EDGE = float(1 << 60)
#: Doubles are exact whole numbers up to here.
_EXACT = 1 << 53
#: Numbers that a task holds for the lengths it has met, before it sends them.
HELD = 1 << 22


def fixed(vector: F.Column) -> F.Column:
    """floor(64 * c) + 1000000 for each component c."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(_EDGE)), F.lit(-_EDGE))).cast("long") + ORIGIN)


def jacobi(v: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, of a symmetric matrix without negative eigenvalues."""
    a, d = np.array(v, np.float64), len(v)
    u = np.eye(d)
    eps = np.finfo(np.float64).eps
    least = eps * eps * abs(np.trace(a))
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= max(eps * np.sqrt(abs(a[p, p] * a[q, q])), least):
                    continue
                turned = True
                tau = (a[q, q] - a[p, p]) / (2 * off)
                # the smaller of the two angles
                t = (1.0 if tau >= 0 else -1.0) / (abs(tau) + np.hypot(1.0, tau))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                x, y = a[p].copy(), a[q].copy()
                new_p, new_q = c * x - s * y, s * x + c * y
                new_p[p], new_q[q] = x[p] - t * off, y[q] + t * off
                new_p[q] = new_q[p] = 0.0
                a[p], a[q] = new_p, new_q
                a[:, p], a[:, q] = new_p, new_q
                x, y = u[:, p].copy(), u[:, q].copy()
                u[:, p], u[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    return e[order], u[:, order]


def _matrices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """The batch, a length in it, the places of its rows of that length, and their components."""
    for b in batches:
        lists = b.column(column)
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        dims = np.diff(ends)
        for d in np.unique(dims[dims > 0]):
            at = np.flatnonzero(dims == d)
            yield b, int(d), at, values[ends[at][:, None] + np.arange(d)]


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Length to the number of distinct vectors and their exact sums."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, d, at, x in _matrices(batches, "x"):
            small = int(np.abs(x).max()) * len(x) < 1 << 62
            total = x.sum(axis=0).tolist() if small else [sum(col) for col in x.T.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), pa.array([str(t) for t in (len(at), *total)])], ["dim", "i", "total"])

    parts = fit.select("x").mapInArrow(rows, "dim int, i int, total string")
    found: dict[int, dict[int, int]] = {}
    # a number for each dimension
    for r in parts.groupBy("dim", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        found.setdefault(r["dim"], {})[r["i"]] = int(r["total"])
    return {d: (t[-1], [t[i] for i in range(d)]) for d, t in found.items()}


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Length to the matrix whose rows (dim, i, row as packed doubles) are added up, a task for some rows' numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.empty(0)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([total.tobytes()])], ["dim", "i", "row"])

        for b in batches:
            for d, i, row in zip(*[b.column(c).to_pylist() for c in ("dim", "i", "row")]):
                if now != (d, i):
                    if now is not None:
                        yield done()
                    now, total = (d, i), np.zeros(len(row) // 8)
                total += np.frombuffer(row, np.float64)
        if now is not None:
            yield done()

    dealt = parts.repartition(partitions(parts.sparkSession), "dim", "i").sortWithinPartitions("dim", "i", "row")
    out: dict[int, list] = {}
    for r in sorted(dealt.mapInArrow(add, "dim int, i int, row binary").collect()):  # one matrix for each length
        out.setdefault(r["dim"], []).append(np.frombuffer(r["row"], np.float64))
    return {d: np.vstack(rows) for d, rows in out.items()}


def _scatter(rows: np.ndarray) -> np.ndarray:
    """Sum of the rows' outer products, so many at a time that whole numbers stay exact."""
    most = float(np.abs(rows).max(initial=0.0))
    step = max(1, min(len(rows), int(_EXACT / (most * most)))) if most else len(rows)
    total = np.zeros((rows.shape[1], rows.shape[1]))
    for at in range(0, len(rows), step):
        total += rows[at : at + step].T @ rows[at : at + step]
    return total


def _scatters(fit: DataFrame, prepared) -> DataFrame:
    """dim, i, row: each task's sums of outer products of what ``prepared(dim)`` makes of rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for d, m in held.items():
                n = len(m)
                yield pa.RecordBatch.from_arrays([pa.array([d] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], ["dim", "i", "row"])
            held.clear()

        for _, d, _at, x in _matrices(batches, "x"):
            m = _scatter(prepared(d)(x))
            held[d] = held[d] + m if d in held else m
            if sum(m.size for m in held.values()) > HELD:
                yield from sent()
        yield from sent()

    return fit.select("x").mapInArrow(rows, "dim int, i int, row binary")


class Whitening:
    """The components of vectors of one length."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray, centre: list[int], most: int):
        self.n, self.centre = n, np.array(centre, np.int64)
        self.rest = [s - n * c for s, c in zip(sums, centre)]  # n times what the centre lacks of the mean
        self.shift = np.array([r / n for r in self.rest])
        exact = [[(n * int(z) - a * b) / (n * n) for z, b in zip(row, self.rest)] for row, a in zip(scatter, self.rest)]
        v = np.array(exact)
        values, vectors = jacobi(v)
        self.values, vectors = values[:most], vectors[:, :most]
        largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
        vectors = vectors * np.where(largest < 0, -1.0, 1.0)
        trace = np.trace(v)
        #: Components whose variance is more than rounding.
        self.sound = self.values > len(v) * np.finfo(np.float64).eps * max(values[0], 0.0)
        self.matrix = vectors / np.sqrt(np.where(self.sound, self.values, 1.0))
        self.explained = np.where(self.sound, self.values, 0.0) / trace if trace > 0 else np.zeros(len(self.values))
        self.identity_error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.shift) @ self.matrix

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S) squared, exactly."""
        z = x - self.centre
        most = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, self.rest))
        if most * most * len(self.rest) < 1 << 63:
            return ((self.n * z - np.array(self.rest, np.int64)) ** 2).sum(axis=1)
        return np.array([min((1 << 63) - 1, sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest))) for row in z.tolist()], np.int64)


def fitted(vectors: DataFrame, most: int = COMPONENTS) -> dict[int, Whitening]:
    """Length to its components, of distinct vectors ``x``."""
    fit = staged(vectors.select("x").distinct(), "fit")
    sums = _sums(fit)
    centres = {d: [(2 * s + n) // (2 * n) for s in total] for d, (n, total) in sums.items()}
    at = {d: np.array(c, np.int64) for d, c in centres.items()}
    scatter = _added(_scatters(fit, lambda d: lambda x: (x - at[d]).astype(np.float64)))
    found = {d: Whitening(n, total, scatter[d], centres[d], most) for d, (n, total) in sums.items()}
    held = vectors.sparkSession.sparkContext.broadcast(found)
    # whitened rows are centred, so the sums of their products are covariances
    spread = _added(_scatters(fit, lambda d: held.value[d].whitened))
    for d, w in found.items():
        off = np.abs(spread[d] / w.n - np.eye(len(w.values)))[np.ix_(w.sound, w.sound)]
        w.identity_error = float(off.max()) if off.size else None
    return found


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: up to ``most`` rows for each usable row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")).where(usable(F.col("embedding").cast("array<double>")))
    rows = rows.select("vec_id", fixed(F.col("embedding")).alias("x"))
    # a matrix of a vector's length by ``most`` for each length
    held = vectors.sparkSession.sparkContext.broadcast(fitted(rows, most))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, d, at, x in _matrices(batches, "x"):
            w = held.value[d]
            k, m = len(w.values), len(at)
            ids = b.column("vec_id").take(pa.array(np.repeat(at, k)))
            y = w.whitened(x).reshape(-1)
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, w.n), pa.int64()),
                pa.array(np.repeat(w.deviation(x), k), pa.int64()),
                pa.array(y, mask=np.tile(~w.sound, m)),
                pa.array(np.tile(w.explained, m)),
                pa.array([w.identity_error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
