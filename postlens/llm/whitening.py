"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers (``floor(64 * entry) + 1000000``); the fit list is
each distinct vector once.  Counts and sums are exact, so rows are centred
before any product is formed: ``n * x - S`` is a whole number, and the centred
row is that over ``n``.

The components are those of the centred fit list ``A``, whose Gram matrix is
never taken as it stands but improved: a pass over the rows forms the Gram
matrix of ``Q = A * inv(R)`` (a triangular solve a row), its Cholesky factor
goes into ``R``, and the next pass sees nearly orthonormal rows.  The first
factor is of the Gram matrix plus a small shift of its diagonal, so it exists
however ill-conditioned the rows are.  When ``Q``'s Gram matrix is the identity
to double precision, ``A = Q * R`` and the singular vectors of the small ``R``
are the components.  If rows lie in a subspace, the identity is not reached in
the directions that no row takes; after ``PASSES`` the symmetric root of the
last Gram matrix goes into ``R`` instead, which is exact for those too.

A pass is one map over the stored fit list: each batch adds to its task's Gram
matrix, and tasks' matrices are added up by Spark, entry by entry.  The driver
holds matrices of dimension times dimension only.

Defined cases: vectors that are null or hold null or non-finite entries are
left out; so are vectors of another length than the commonest one (ties: the
longer), and empty ones; rows with equal or null ids are rows of their own; an
entry beyond the range of long is cut to it; a component without variance to
double precision has whitened null and no part in ``identity_error``;
``explained`` is null if there is no variance at all; ``deviation`` is null
where it does not fit a long; an empty table gives no row; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.session import scratch_path

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Passes after which a Gram matrix that is not the identity is taken for singular.
PASSES = 6
#: Rows whose coordinates are held as doubles at a time.
ROWS = 4096
EPS = float(np.finfo(float).eps)


def whole(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and the whole-number vector ``x`` of each row that takes part."""
    finite = F.expr("coalesce(size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) "
                    "and abs(cast(c as double)) < double('infinity')), false)")
    entry = f"floor(least(greatest({SCALE}D * cast(c as double), -9e18D), 9e18D)) + {OFFSET}L"
    rows = vectors.where(finite).select("vec_id", F.expr(f"transform(embedding, c -> cast({entry} as bigint))").alias("x"))
    by = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    return rows.where(F.size("x") == (by["dims"] if by else 0))


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some rows at a time, with their ``x`` as a matrix."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            x = part.column(part.schema.get_field_index("x"))
            yield part, x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` as whole numbers, of type long if they fit it, else of any size."""
    most = n * _most(x) + max(map(abs, sums), default=0)
    if most < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(c: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None beyond long."""
    if c.dtype != object and _most(c)**2 * c.shape[1] < 2**63:
        return (c**2).sum(axis=1).tolist()
    sums = (sum(v * v for v in row) for row in c.tolist())
    return [s if s < 2**63 else None for s in sums]


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``a * inv(r)`` for an upper triangular r, column by column."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def totals(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each entry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dims + 1)
        for _, x in blocks(batches, dims):
            part = x.sum(axis=0) if _most(x) * len(x) < 2**63 else x.astype(object).sum(axis=0)
            total = [a + b for a, b in zip(total, [len(x), *part.tolist()])]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int64()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["at", "value"])

    sums = {r["at"]: int(r["value"]) for r in
            rows.select("x").mapInArrow(work, "at long, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    return sums.get(0, 0), [sums.get(i + 1, 0) for i in range(dims)]


def gram(rows: DataFrame, dims: int, make: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The Gram matrix of ``make(x)``, ``size`` numbers a row, over all rows: within tasks first, then entry by entry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, x in blocks(batches, dims):
            a = make(x)
            total += a.T @ a
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i * size + j), pa.array(total[i, j])], ["at", "value"])

    out = np.zeros(size * size)
    for r in rows.select("x").mapInArrow(work, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    out = out.reshape(size, size)
    return out + np.triu(out, 1).T


def cholesky_qr(of: Callable[[np.ndarray], np.ndarray], dims: int, n: int) -> np.ndarray:
    """R of n rows; ``of(R)`` is the Gram matrix of the rows times inv(R)."""
    r, one = np.eye(dims), np.eye(dims)
    for turn in range(PASSES):
        g = of(r)
        if not g.any():  # all rows are the same
            return np.zeros((dims, dims))
        if turn and np.abs(g - one).max() <= 8 * dims * EPS:
            return r
        if turn + 1 == PASSES:
            break
        # the published shift: 11 (n d + d (d + 1)) u |A|^2, never more than a small part of |A|^2
        shift = 0.0 if turn else min(11 * (n * dims + dims * (dims + 1)) * EPS / 2, 1e-4) * np.linalg.norm(g, 2)
        while True:
            try:
                r = np.linalg.cholesky(g + shift * one).T @ r
                break
            except np.linalg.LinAlgError:
                shift = max(10 * shift, dims * EPS * np.abs(g).max())
    values, vectors = np.linalg.eigh(g)
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T @ r


class Whitening(NamedTuple):
    """What a fit list of ``n`` distinct vectors with entries' ``sums`` gives.  Components are columns; ``variances`` are
    null (nan) where there is no variance."""

    dims: int
    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``"""
        return coordinates(centred(x, self.n, self.sums), self.n)

    def whitened(self, coordinates: np.ndarray) -> np.ndarray:
        return (coordinates @ self.components) / np.sqrt(self.variances)


def coordinates(c: np.ndarray, n: int) -> np.ndarray:
    return (c / n).astype(float)


def fitted(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float | None] | None:
    """The whitening of the distinct vectors of ``rows`` (as ``whole`` gives them), and how far the covariance of the
    whitened list is from the identity; None without rows."""
    path = scratch_path(rows.sparkSession, "whitening-fit")
    rows.select("x").distinct().write.parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    first = rows.select(F.size("x")).first()
    if first is None:
        return None
    dims = first[0]
    n, sums = totals(rows, dims)

    def part(r: np.ndarray) -> np.ndarray:
        return gram(rows, dims, lambda x: solved(coordinates(centred(x, n, sums), n), r), dims)

    r = cholesky_qr(part, dims, n)
    _, sigma, vectors = np.linalg.svd(r)
    variances = sigma**2 / n
    total, k = variances.sum(), min(components, dims)
    explained = variances[:k] / total if total > 0 else np.full(k, np.nan)
    there = variances[:k] > dims * EPS * variances[0]
    fit = Whitening(dims, n, sums, vectors[:k].T, np.where(there, variances[:k], np.nan), explained)
    own = np.flatnonzero(there)
    if not len(own):
        return fit, None
    covariance = gram(rows, dims, lambda x: fit.whitened(fit.coordinates(x))[:, own], len(own)) / n
    return fit, float(np.abs(covariance - np.eye(len(own))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every row that takes part."""
    rows = whole(vectors)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fitted(rows, components)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    fit, error = found
    k = len(fit.explained)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, fit.dims):
            c = centred(x, fit.n, fit.sums)
            of = np.repeat(np.arange(len(x)), k)
            white = fit.whitened(coordinates(c, fit.n)).ravel()
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(of), fit.n)), pa.array(squares(c), pa.int64()).take(pa.array(of)),
                 pa.array(white, mask=np.isnan(white)), pa.array(np.tile(fit.explained, len(x)), from_pandas=True),
                 pa.array([error] * len(of), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(work, schema)
