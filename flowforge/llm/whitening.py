"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then
one-sided Jacobi on the triangular factor.

1. Every entry c becomes the whole number ``floor(scale * c) + shift``.
2. A pass sums counts and entries; a second pass sums the products of entries
   centred at the rounded mean.  Both are whole numbers, added exactly in any
   order, so the fit does not depend on how the rows are partitioned.  A task
   sends one row per pair of dimensions, combined before the shuffle.
3. The covariance V (divisor n, a matrix of dimensions x dimensions whatever the
   number of rows) follows exactly.  Pivoted Cholesky gives ``V = L L'`` with the
   largest remaining variance first and stops where nothing is left: dimensions
   that others determine add no column.
4. Rotations of pairs of columns make those of L orthogonal.  Their squared
   norms are the eigenvalues of V; the columns, divided by their norms, are the
   components.
5. ``transform`` projects every centred vector on the components and divides by
   the standard deviation; ``identity_error`` measures on the transformed rows
   themselves how far their covariance is from the identity.

Defined results: vectors that are null, empty or hold null or non-finite entries
are left out, of the fit and of the result.  Repeated ids and null ids are rows of
their own.  An empty table gives an empty result.  Only directions of positive
variance are components: of n equal vectors there is none, so no row.  A
deviation beyond 64 bits is null.  Vectors of different lengths, and entries
beyond 2**62, raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowforge.llm.common import prepare

#: Whole numbers up to here are exact as doubles, and so are their sums.
EXACT = 1 << 53
#: Rows that a task holds as a matrix at once.
ROWS = 4096
#: Rounds over all pairs of columns; about ten are needed.
SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """What a fit found: ``components`` has a column for each component."""

    n: int
    scale: float
    shift: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    @property
    def center(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """n times the mean's distance from ``center``."""
        return [s - self.n * c for s, c in zip(self.sums, self.center, strict=True)]


def _matrices(batches: Iterator[pa.RecordBatch], scale: float, shift: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, whole entries) of the vectors that take part, by their length."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids, lists = part.column(0), part.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            sizes[~np.asarray(lists.is_valid())] = 0
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)
            starts = np.cumsum(sizes) - sizes
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            fits = (sizes > 0) & (bad[starts + sizes] == bad[starts])
            for size in np.unique(sizes[fits]):
                rows = np.flatnonzero(fits & (sizes == size))
                x = np.floor(values[starts[rows][:, None] + np.arange(size)] * scale)
                if np.abs(x).max() >= 2.0 ** 62 - abs(shift):
                    raise ArithmeticError("an entry of a vector is beyond 62 bits")
                yield ids.take(pa.array(rows)), x.astype(np.int64) + shift


def _entries(found: dict[tuple[int, int], int]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                                       pa.array([str(v) for v in found.values()], pa.string())], names=["i", "j", "v"])


def _sums(scale: float, shift: int):
    """Rows (length, -1, count) and (length, dimension, sum) of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for _, x in _matrices(batches, scale, shift):
            small = int(np.abs(x).max()) < 2 ** 62 // len(x)
            sums = (x if small else x.astype(object)).sum(axis=0)
            size = x.shape[1]
            total[size, -1] = total.get((size, -1), 0) + len(x)
            for j, v in enumerate(sums):
                total[size, j] = total.get((size, j), 0) + int(v)
        yield _entries(total)
    return run


def products(y: np.ndarray) -> np.ndarray:
    """``y' y`` of whole numbers, exactly, as Python integers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < EXACT:
        z = y.astype(np.float64)
        return np.rint(z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def _scatter(scale: float, shift: int, center: list[int]):
    """Rows (i, j, sum of products) of each task, i <= j."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, scale, shift):
            here = products(x - np.array(center, np.int64))
            total = here if total is None else total + here
        if total is not None:
            yield _entries({(i, j): int(total[i, j]) for i in range(len(center)) for j in range(i, len(center))})
    return run


def _added(rows: DataFrame, run) -> dict[tuple[int, int], int]:
    """The tasks' entries summed by place; as many as a matrix has."""
    parts = rows.mapInArrow(run, "i int, j int, v string")
    return {(r.i, r.j): int(r.v) for r in parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with ``v = L L'``: rows in the order of ``v``, a column for each pivot,
    the largest remaining diagonal entry first."""
    left, rest = np.zeros((len(v), 0)), v.diagonal().copy()
    least = len(v) * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    done = np.zeros(len(v), bool)
    while not done.all():
        p = int(np.argmax(np.where(done, -np.inf, rest)))
        if rest[p] <= least:
            break
        column = (v[:, p] - left @ left[p]) / np.sqrt(rest[p])
        column[done] = 0.0
        column[p] = np.sqrt(rest[p])
        done[p] = True
        rest = rest - column * column
        left = np.column_stack([left, column])
    return left


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns, in rounds of pairs that share no column."""
    ring = list(range(n + n % 2))
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:len(ring) // 2], reversed(ring[len(ring) // 2:]), strict=True) if a < n and b < n]
        out.append((np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components) of ``left left'``, the largest first: rotations
    of pairs of columns until all are orthogonal to double precision."""
    a = left.copy()
    plan = rounds(a.shape[1])
    for _ in range(SWEEPS):
        turned = 0
        for p, q in plan:
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            go = np.abs(xy) > 2 * np.finfo(float).eps * np.sqrt(xx * yy)
            if not go.any():
                continue
            turned += int(go.sum())
            p, q, x, y, xx, yy, xy = p[go], q[go], x[:, go], y[:, go], xx[go], yy[go], xy[go]
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    values = (a * a).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    values, a = values[order], a[:, order] / np.sqrt(values[order])
    sign = np.sign(a[np.argmax(np.abs(a), axis=0), np.arange(a.shape[1])]) if a.size else 1.0
    return values, a * sign


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def fit(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32,
        scale: float = 64, shift: int = 1_000_000) -> Whitening | None:
    """The whitening of all vectors of ``table``; None if none takes part."""
    prepare(table.sparkSession)
    rows = _vectors(table, id_col, vector_col)
    found = _added(rows, _sums(scale, shift))
    sizes = {i for i, _ in found}
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    if not sizes:
        return None
    d = sizes.pop()
    n, sums = found[d, -1], tuple(found[d, j] for j in range(d))
    model = Whitening(n, scale, shift, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    scatter, rest = _added(rows, _scatter(scale, shift, model.center)), model.rest
    v = np.array([[(n * scatter[min(i, j), max(i, j)] - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = one_sided_jacobi(pivoted_cholesky(v))
    return Whitening(n, scale, shift, sums, vectors[:, :components], values[:components], values[:components] / v.trace())


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened values of rows of whole entries."""
    y = (x - np.array(model.center, np.int64)).astype(np.float64)
    mean = np.array([r / model.n for r in model.rest])
    return (y - mean) @ (model.components / np.sqrt(model.variances))


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums over the dimensions of ``(n x - sum)**2``, exactly."""
    y = x - np.array(model.center, np.int64)
    if float(np.abs(y).max(initial=0)) + 1 < (2.0 ** 31 - 1) / (model.n * np.sqrt(y.shape[1])):
        z = y * model.n - np.array(model.rest, np.int64)
        return (z * z).sum(axis=1).tolist()
    z = y.astype(object) * model.n - np.array(model.rest, object)
    return [s if s < 1 << 63 else None for s in (z * z).sum(axis=1)]


def transform(table: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, deviation, whitened (array, a value for each component)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, model.scale, model.shift):
            z = project(x, model)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(deviations(x, model), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return _vectors(table, id_col, vector_col).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(table: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The largest absolute entry of (covariance of the whitened rows, minus the
    identity), measured by a pass over all rows."""
    k = len(model.variances)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, x in _matrices(batches, model.scale, model.shift):
            z = project(x, model)
            total += np.vstack([z.T @ z, z.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    parts = _vectors(table, id_col, vector_col).mapInArrow(run, "i int, j int, v double")
    total = np.zeros((k + 1, k))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened_components(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """Fit on all vectors and one row for each vector and component: vec_id,
    component (from 1), n, deviation, whitened, explained, identity_error."""
    model = fit(table, id_col, vector_col, components)
    if model is None:
        return table.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(table, model, id_col, vector_col)
    shares = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    return (transform(table, model, id_col, vector_col).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")))
