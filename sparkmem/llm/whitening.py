"""Operator 13, whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Every entry c of a vector becomes the long x = floor(1024 * c) + 100000 (with c as double). Counts and sums of the x are exact longs; the scatter of the vectors less
their mean is summed in the tasks, so what a task sends on and what the driver holds is a matrix of the vectors' length, whatever the number of rows.
The scatter is factored by Cholesky with diagonal pivoting; one-sided Jacobi rotates the columns of the triangular factor
until they are orthogonal. Their squared norms are then the eigenvalues and the columns divided by their norms the
eigenvectors: the scatter's own small eigenvalues never pass through a product of it with itself. Rows are whitened in a last scan; the covariance of
what was whitened is measured against the identity.

Nulls and odd input: a vector that is null, or holds null or non-finite entries or one whose x is beyond 2^52, is dropped and is no part of the fit; so is an empty one.
Vectors of each length are fitted and whitened on their own. Components of no variance (an eigenvalue below 1e-12 of the greatest) don't exist, so equal
vectors, or a single one, give no rows; repeated rows count each and come back each; null ids come back as null. ``deviation`` is null where a long can't
hold it. An empty table gives an empty result. Extra columns are ignored. Eigenvectors have their entry of largest magnitude positive; equal eigenvalues keep the order in
which Jacobi leaves them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_conf

SCALE, SHIFT = 1024, 100_000       # fixed values of the contract
COMPONENTS = 8
BLOCK = 1 << 22                    # entries of the vectors handled at once
NO_VARIANCE = 1e-12                # of the greatest eigenvalue


@dataclass
class Whitening:
    """Fit of the vectors of one length."""
    n: int
    sums: np.ndarray               # exact, int64
    values: np.ndarray             # eigenvalues, falling
    vectors: np.ndarray            # a column per component
    trace: float
    identity_error: float | None = None


# --------------------------------------------------------------------------
# Matrices of the vectors' length
# --------------------------------------------------------------------------
def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L of full column rank with L L^T = a (rows in a's order): the greatest remaining diagonal entry is the next pivot."""
    left, d = a.astype(np.float64).copy(), len(a)
    top = max(float(left.diagonal().max()), 0.0) if d else 0.0
    columns = []
    open_rows = np.ones(d, bool)
    for _ in range(d):
        diagonal = np.where(open_rows, left.diagonal(), -np.inf)
        p = int(diagonal.argmax())
        if diagonal[p] <= top * d * np.finfo(np.float64).eps or diagonal[p] <= 0:
            break
        column = np.where(open_rows, left[:, p], 0.0) / math.sqrt(diagonal[p])
        column[p] = math.sqrt(diagonal[p])
        left -= np.outer(column, column)
        open_rows[p] = False
        columns.append(column)
    return np.array(columns).T if columns else np.zeros((d, 0))


def _rounds(k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of 0..k-1 in rounds of disjoint pairs (each pair once): one seat stays, the others move on."""
    seats = list(range(k + k % 2))
    out = []
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[:len(seats) // 2], reversed(seats[len(seats) // 2:])) if max(a, b) < k]
        out.append((np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated in pairs until all are orthogonal to working precision."""
    g = factor.T.copy()                                     # columns as rows
    if len(g) < 2:
        return g.T
    rounds = _rounds(len(g))
    # a sum of m products is off by about sqrt(m) roundings, so no cosine can be asked to be smaller than that
    small = 4 * math.sqrt(factor.shape[0]) * np.finfo(np.float64).eps
    for _ in range(sweeps):
        rotated = False
        for i, j in rounds:
            a, b = g[i], g[j]
            aa, bb, ab = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
            turn = np.abs(ab) > small * np.sqrt(aa * bb)
            if not turn.any():
                continue
            rotated = True
            a, b, aa, bb, ab, i, j = a[turn], b[turn], aa[turn], bb[turn], ab[turn], i[turn], j[turn]
            zeta = (bb - aa) / (2 * ab)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            g[i] = c[:, None] * a - s[:, None] * b
            g[j] = s[:, None] * a + c[:, None] * b
        if not rotated:
            break
    return g.T


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors as columns) of a covariance."""
    g = one_sided_jacobi(pivoted_cholesky(covariance))
    norms = np.sqrt((g * g).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] ** 2 > NO_VARIANCE * (norms.max() ** 2 if len(norms) else 0.0)]
    values, vectors = norms[order] ** 2, g[:, order] / norms[order]
    if len(order):
        lead = vectors[np.abs(vectors).argmax(0), np.arange(len(order))]
        vectors = vectors * np.where(lead < 0, -1.0, 1.0)
    return values, vectors


# --------------------------------------------------------------------------
# Passes over the vectors
# --------------------------------------------------------------------------
def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, x as int64 matrix) of the usable vectors of a batch (its last column)."""
    col = batch.column(batch.num_columns - 1)
    col = col.cast(pa.list_(pa.float64()))
    length = np.diff(col.offsets.to_numpy())
    flat = col.values.slice(col.offsets[0].as_py(), int(length.sum()))
    c = flat.to_numpy(zero_copy_only=False)                  # nulls become nan
    start = np.concatenate([[0], np.cumsum(length)])
    usable = ~np.asarray(col.is_null().to_numpy(zero_copy_only=False), bool) & (length > 0)
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.floor(c * float(SCALE))
        bad = ~(np.abs(y) < 2.0 ** 52)
    if bad.any():
        usable &= np.add.reduceat(np.append(bad, False), start[:-1]) == 0 if len(length) else usable
    for d in np.unique(length[usable]):
        rows = np.flatnonzero(usable & (length == d))
        step = max(1, BLOCK // int(d))
        for lo in range(0, len(rows), step):
            some = rows[lo:lo + step]
            yield int(d), some, y[start[some][:, None] + np.arange(d)].astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, i, value): the task's exact sum of each entry; i = -1 is the number of vectors."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for d, _, x in _blocks(b):
            total = held.setdefault(d, np.zeros(d + 1, object))
            total[0] += len(x)
            total[1:] += x.sum(0)
    for d, total in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d, np.int32)), pa.array(np.arange(-1, d, dtype=np.int32)),
                                          pa.array([int(v) for v in total], pa.int64())], ["dim", "i", "value"])


def _scatter(fits: dict[int, Whitening]):
    """(dim, i, j, value): the task's sums of products of the centred entries, i <= j."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _blocks(b):
                y = x - fits[d].sums / fits[d].n
                held[d] = held.get(d, 0.0) + y.T @ y
        for d, m in held.items():
            i, j = np.triu_indices(d)
            for lo in range(0, len(i), 1 << 16):
                at = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i[at]), d, np.int32)), pa.array(i[at].astype(np.int32)),
                                                  pa.array(j[at].astype(np.int32)), pa.array(m[i[at], j[at]])], ["dim", "i", "j", "value"])
    return run


def _whitened(fit: Whitening, x: np.ndarray) -> np.ndarray:
    return (x - fit.sums / fit.n) @ fit.vectors / np.sqrt(fit.values)


def _whitened_sums(fits: dict[int, Whitening], means: dict[int, np.ndarray] | None):
    """(dim, i, j, value): sums of the whitened entries (j = -1), or, given their means, of products of the centred ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _blocks(b):
                w = _whitened(fits[d], x)
                part = w.sum(0)[:, None] if means is None else (w - means[d]).T @ (w - means[d])
                held[d] = held.get(d, 0.0) + part
        for d, m in held.items():
            i, j = np.indices(m.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(m.ravel())], ["dim", "i", "j", "value"])
    return run


def _exact_deviation(fit: Whitening, x: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n x - S)^2 per row, in longs, or in Python's integers where these may not hold it."""
    far = np.abs(x - fit.sums / fit.n).max() * fit.n
    if x.shape[1] * (far + 1) ** 2 < 2.0 ** 62 and np.abs(x).max() * float(fit.n) < 2.0 ** 62:
        y = x * fit.n - fit.sums
        return pa.array((y * y).sum(1))
    y = x.astype(object) * fit.n - fit.sums.astype(object)
    return pa.array([v if v < 1 << 63 else None for v in ((int(r @ r)) for r in y)], pa.int64())


def _rows(fits: dict[int, Whitening], id_type: pa.DataType | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, rows, x in _blocks(b):
                fit = fits[d]
                k = len(fit.values)
                if not k:
                    continue
                w, deviation = _whitened(fit, x), _exact_deviation(fit, x)
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, fit.n, np.int64)), deviation.take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()),
                     pa.array(np.tile(fit.values / fit.trace, m)), pa.array(np.full(m * k, fit.identity_error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of (id, embedding) per length of vector."""
    arrow_conf(vectors.sparkSession)
    only = vectors.select("embedding")
    fits: dict[int, Whitening] = {}
    for r in only.mapInArrow(_sums, "dim int, i int, value long").groupBy("dim", "i").agg(F.sum("value").alias("v")).collect():
        f = fits.setdefault(r.dim, Whitening(0, np.zeros(r.dim, np.int64), np.zeros(0), np.zeros((r.dim, 0)), 0.0))
        if r.i < 0:
            f.n = r.v
        else:
            f.sums[r.i] = r.v

    def matrices(run, size) -> dict[int, np.ndarray]:
        out = {d: np.zeros(size(d)) for d in fits}
        for r in only.mapInArrow(run, "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("v")).collect():
            out[r.dim][r.i, r.j] = r.v
        return out

    for d, m in matrices(_scatter(fits), lambda d: (d, d)).items():
        f = fits[d]
        covariance = (m + np.triu(m, 1).T) / f.n
        values, axes = eigen(covariance)
        f.values, f.vectors, f.trace = values[:components], axes[:, :components], float(np.trace(covariance))
    k = {d: len(f.values) for d, f in fits.items()}
    means = {d: m[:, 0] / fits[d].n for d, m in matrices(_whitened_sums(fits, None), lambda d: (k[d], 1)).items()}
    for d, m in matrices(_whitened_sums(fits, means), lambda d: (k[d], k[d])).items():
        fits[d].identity_error = float(np.abs(m / fits[d].n - np.eye(k[d])).max()) if k[d] else 0.0
    return fits


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of the usable rows of (id, embedding)."""
    fits = fit_whitening(vectors, components)
    return vectors.select("id", "embedding").mapInArrow(
        _rows(fits), "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
