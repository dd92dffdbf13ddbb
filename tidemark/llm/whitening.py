"""Whitening of embeddings by incremental eigendecomposition.

Every usable vector becomes whole numbers, floor(scale * component); the fit list holds each distinct one once. A task
goes through its part of the list and keeps the spectrum of what it has seen: count, mean, and eigenvectors and
eigenvalues of the centred scatter. A vector x changes the scatter by the rank-one term n / (n + 1) * (x - mean)(x - mean)',
whose effect on the spectrum follows from the roots of the secular equation; entries of the term that are negligible and
eigenvalues that coincide are deflated first, and the vectors are rebuilt from the roots found, so they stay orthonormal.
Spectra of tasks are combined in a tree of the same rank-one changes: one for each scaled eigenvector of the other side
and one for the distance of the means. The basis that remains has the full dimension; its Rayleigh-Ritz refinement, the
covariance in that basis summed over all tasks and diagonalised, gives the eigenpairs to double precision.

Only spectra (dimension squared, whatever the number of vectors) and sums of that size reach the driver.

Defined cases: null vectors and vectors with null or non-finite components are left out; vectors of different lengths
are whitened apart, each length by its own fit list, and empty vectors have no components; repeated vectors count once in
the fit and each get their rows; a component whose eigenvalue is zero to rounding (fewer distinct vectors than
components, or one vector) cannot be whitened and has no rows; of equal eigenvalues any orthonormal pair of vectors is
right, the same one for all rows; a null vec_id is carried along; a deviation beyond a long is null; components beyond
a long are cut to it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

SCALE = 256
COMPONENTS = 4
#: Vectors whose rank-one changes one task applies, and spectra that one task combines.
TASK_ROWS = 4096
FAN_IN = 8
#: Steps of the root finder; it converges in about five, the rest are halvings of hard cases.
STEPS = 60
_EPS = float(np.finfo(np.float64).eps)


# ------------------------------------------------------------------ rank-one changes of a spectrum

def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum w_j / (d_j - t) for strictly rising d and positive w, one above each d.

    A root is (nearest d, distance from it), so that its distances to all d keep their relative precision.
    """
    k = len(d)
    width = np.append(np.diff(d), w.sum())  # the last root lies at most sum(w) above the last d
    gap = d[None, :] - d[:, None]
    middle = 1 + (w / (gap - (width / 2)[:, None])).sum(1)
    right = (middle < 0) & (np.arange(k) < k - 1)
    origin = np.where(right, np.minimum(np.arange(k) + 1, k - 1), np.arange(k))
    delta = d[None, :] - d[origin][:, None]
    low = np.where(right, -width / 2, np.where(middle < 0, width / 2, 0))
    high = np.where(right, 0, np.where(middle < 0, width, width / 2))
    upper = np.arange(k)[None, :] > np.arange(k)[:, None]
    first = np.arange(k) - (np.arange(k) == k - 1) * (k > 1)  # the two poles beside a root; for the last the two below
    near, far = delta[np.arange(k), first], delta[np.arange(k), np.minimum(first + 1, k - 1)]
    if k > 1:
        upper[-1, -1] = True
    t = (low + high) / 2
    active = np.arange(k)
    for _ in range(STEPS):
        inverse = 1 / (delta[active] - t[active, None])
        square = inverse * inverse
        slope, over_slope = square @ w, (square * upper[active]) @ w
        under_slope = slope - over_slope
        f = 1 + inverse @ w
        size = 1 + np.abs(inverse) @ w
        below = f < 0
        low[active[below]], high[active[~below]] = t[active[below]], t[active[~below]]
        d1, d2 = near[active] - t[active], far[active] - t[active]
        with np.errstate(all="ignore"):
            a = (d1 + d2) * f - d1 * d2 * slope
            b = d1 * d2 * f
            c = f - d1 * under_slope - d2 * over_slope
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            # beyond both poles (the last root) the other solution of the quadratic is the one ahead
            root = np.where(active == k - 1, -root, root)
            step = np.where(a * np.sign(root) <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        guess = t[active] + step
        lo, hi = low[active], high[active]
        inside = np.isfinite(guess) & (guess > lo) & (guess < hi)
        guess = np.where(inside, guess, (lo + hi) / 2)
        done = (np.abs(f) <= 8 * _EPS * (size + np.abs(t[active]) * slope)) | (guess == t[active]) | (hi - lo <= 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)))
        t[active[~done]] = guess[~done]
        active = active[~done]
        if not len(active):
            break
    return origin, np.where(t == 0, np.where(right, -1.0, 1.0) * np.finfo(np.float64).tiny, t)


def rank_one(values: np.ndarray, vectors: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of vectors * diag(values) * vectors' + u u'; values rise, vectors are columns."""
    z = u @ vectors
    length = float(z @ z)
    if length == 0:
        return values, vectors
    scale = max(float(values[-1]), length)
    same = np.diff(values) <= 8 * _EPS * scale
    if same.any():  # among equal eigenvalues turn the basis until one vector carries the whole change
        vectors = vectors.copy()
        edges = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            size = float(np.sqrt(z[a:b] @ z[a:b])) if b - a > 1 else 0.0
            if size:
                mirror = z[a:b].copy()
                mirror[-1] += size if mirror[-1] >= 0 else -size
                part = vectors[:, a:b]
                vectors[:, a:b] = part - np.outer(part @ mirror, mirror * (2 / (mirror @ mirror)))
                sign = -1.0 if z[b - 1] >= 0 else 1.0
                z[a:b] = 0
                z[b - 1] = sign * size
    live = np.flatnonzero(z * z > (8 * _EPS) ** 2 * length)
    live = live[np.concatenate([np.diff(values[live]) > 0, [True]])]
    d, w = values[live], z[live] ** 2
    k = len(live)
    if k == 1:
        new, turned = d + w, vectors[:, live]
    else:
        origin, t = secular_roots(d, w)
        new = d[origin] + t
        apart = (d[:, None] - d[origin][None, :]) - t[None, :]  # d_i - root_j
        gaps = d[None, :] - d[:, None]
        np.fill_diagonal(gaps, 1.0)
        # the change for which the computed roots are exact: w_i = product of (root_j - d_i) over product of (d_j - d_i)
        ratio = -apart / gaps
        exact = np.sqrt(np.abs(np.prod(ratio, axis=1)))
        turn = np.copysign(exact, z[live])[:, None] / apart
        turn /= np.sqrt((turn * turn).sum(0))
        turned = vectors[:, live] @ turn
    values, vectors = values.copy(), vectors.copy()
    values[live], vectors[:, live] = new, turned
    if (np.diff(values) < 0).any():
        order = np.argsort(values, kind="stable")
        values, vectors = values[order], vectors[:, order]
    return values, vectors


@dataclass
class Spectrum:
    """Count, mean and eigenpairs of the scatter of the vectors seen; their exact sums beside it."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    total: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim), np.zeros(dim, dtype=object))

    def change(self, u: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, u)

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        if self.n:
            self.change(away * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + away / self.n

    def combine(self, other: Spectrum) -> None:
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.vectors, self.total = other.n, other.mean, other.values, other.vectors, other.total
            return
        away, both = other.mean - self.mean, self.n + other.n
        for j in np.flatnonzero(other.values > 0).tolist():
            self.change(other.vectors[:, j] * np.sqrt(other.values[j]))
        self.change(away * np.sqrt(self.n / both * other.n))
        self.mean = self.mean + away * (other.n / both)
        self.n, self.total = both, self.total + other.total

    def refreshed(self) -> Spectrum:
        """Orthonormal again to the last digit."""
        q, r = np.linalg.qr(self.vectors)
        return Spectrum(self.n, self.mean, self.values, q * np.sign(np.diag(r) + (np.diag(r) == 0)), self.total)


_SPECTRUM = "part long, n long, mean array<double>, eigenvalues array<double>, vectors array<double>, total array<string>"


def _row(part: int, s: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([s.n], pa.int64()),
         *(pa.array([x.ravel()], pa.list_(pa.float64())) for x in (s.mean, s.values, s.vectors)),
         pa.array([[str(int(t)) for t in s.total]], pa.list_(pa.string()))],
        names=["part", "n", "mean", "eigenvalues", "vectors", "total"])


def _spectrum(row: dict) -> Spectrum:
    dim = len(row["mean"])
    return Spectrum(row["n"], np.array(row["mean"]), np.array(row["eigenvalues"]), np.array(row["vectors"]).reshape(dim, dim),
                    np.array([int(t) for t in row["total"]], dtype=object))


# ------------------------------------------------------------------ whole numbers

def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors of finite components as whole numbers."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform("c", lambda v: F.floor(v * scale).cast("long"))
    return vectors.select("vec_id", c.alias("c")).where("c is not null").where(fine).select("vec_id", x.alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of one length as rows of whole numbers."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dim)


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of the columns without overflow."""
    low = (x & 0xFFFFFFFF).sum(0).astype(object)
    return low + ((x >> 32).sum(0).astype(object) << 32)


# ------------------------------------------------------------------ passes over the fit list

def _fit(dim: int):
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum.empty(dim)
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            s.total = s.total + exact_sum(x)
            for row in x.astype(np.float64):
                s.add(row)
        if s.n:
            yield _row(TaskContext.get().partitionId(), s.refreshed())
    return run


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, part = None, 0
    for batch in batches:
        for row in batch.to_pylist():
            if now is not None and row["part"] // FAN_IN == part:
                now.combine(_spectrum(row))
                continue
            if now is not None:
                yield _row(part, now.refreshed())
            now, part = _spectrum(row), row["part"] // FAN_IN
    if now is not None:
        yield _row(part, now.refreshed())


def spectrum(fit: DataFrame, dim: int) -> Spectrum:
    """Of the whole fit list: spectra of parts of TASK_ROWS, combined in a tree of FAN_IN branches."""
    parts = max(1, -(-fit.count() // TASK_ROWS))
    now = written(fit.repartition(parts).mapInArrow(_fit(dim), _SPECTRUM), "whitening-spectra")
    while parts > 1:
        groups = -(-parts // FAN_IN)
        dealt = now.repartition(groups, F.expr(f"part div {FAN_IN}")).sortWithinPartitions("part")
        now, parts = written(dealt.mapInArrow(_combine, _SPECTRUM), "whitening-spectra"), groups
    rows = now.take(1)
    return _spectrum(rows[0].asDict()) if rows else Spectrum.empty(dim)


def _in_basis(mean: np.ndarray, basis: np.ndarray):
    """Adds up products of the coordinates of centred vectors, and the coordinates, for one task."""
    dim, k = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            y = (matrix(batch.column("x"), dim) - mean) @ basis
            products += y.T @ y
            sums += y.sum(0)
        at = np.arange(k * k + k)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.append(products.ravel(), sums))], names=["at", "value"])
    return run


def covariance(fit: DataFrame, n: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of the fit list in a basis, divisor n; tasks send one matrix each."""
    k = basis.shape[1]
    rows = fit.mapInArrow(_in_basis(mean, basis), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(k * k + k)
    for r in rows:
        flat[r["at"]] = r["value"]
    off = flat[k * k :] / n
    return flat[: k * k].reshape(k, k) / n - np.outer(off, off)


@dataclass(frozen=True)
class Whitening:
    """What whitens vectors of one length: exact count and sums, eigenpairs by falling eigenvalue, and how far off it is."""

    n: int
    total: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([t / self.n for t in self.total])


def learn(fit: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """fit: distinct vectors of one length, one column x; None if there are none."""
    s = spectrum(fit, dim)
    if not s.n:
        return None
    mean = np.array([t / s.n for t in s.total])
    h = covariance(fit, s.n, mean, s.vectors)
    values, turn = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-values, kind="stable")
    trace = float(np.trace(h))
    positive = order[values[order] > 16 * dim * _EPS * max(trace, 0.0)][:components]
    vectors = s.vectors @ turn[:, positive]
    error = None
    if len(positive):
        white = covariance(fit, s.n, mean, vectors / np.sqrt(values[positive]))
        error = float(np.abs(white - np.eye(len(positive))).max())
    return Whitening(s.n, tuple(int(t) for t in s.total), values[positive], vectors, trace, error)


def deviations(x: np.ndarray, n: int, total: tuple[int, ...]) -> list[int | None]:
    """Exact sum over dimensions of (n * x - total) squared; None beyond a long."""
    most = n * max(int(x.max(initial=1)), -int(x.min(initial=0))) + max((abs(t) for t in total), default=0)
    if most * most * max(len(total), 1) < 1 << 63:
        away = n * x - np.array(total, dtype=np.int64)
        return (away * away).sum(1).tolist()
    away = x.astype(object) * n - np.array(total, dtype=object)
    return [int(v) if v < 1 << 63 else None for v in (away * away).sum(1)]


_RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def applied(rows: DataFrame, w: Whitening) -> DataFrame:
    """Rows (vec_id, x) of one length in whitened coordinates, a row for each component."""
    k = len(w.values)
    basis, dim, mean = w.vectors / np.sqrt(w.values), len(w.total), w.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            m = len(x)
            away = [d for d in deviations(x, w.n, w.total) for _ in range(k)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)),
                 pa.array(away, pa.int64()), pa.array(((x - mean) @ basis).ravel()),
                 pa.array(np.tile(w.values / w.trace, m)), pa.array(np.full(m * k, w.identity_error))],
                names=["vec_id", *(c.split()[0] for c in _RESULT.split(", "))])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {id_type}, {_RESULT}")


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row for each usable vector and component."""
    rows = usable(vectors, scale)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    out = None
    for (dim,) in sorted(map(tuple, fit.select(F.size("x")).distinct().collect())):
        w = learn(fit.where(F.size("x") == dim), dim, components) if dim else None
        if w is not None and len(w.values):
            made = applied(rows.where(F.size("x") == dim), w)
            out = made if out is None else out.unionAll(made)
    if out is None:
        id_type = rows.schema["vec_id"].dataType.simpleString()
        out = vectors.sparkSession.createDataFrame([], f"vec_id {id_type}, {_RESULT}")
    return out


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op12: one row for each usable vector and each of the first components."""
    return whitened(table(spark, folder, "embeddings"))


SQL = None
