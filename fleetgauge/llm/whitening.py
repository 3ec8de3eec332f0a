"""Whitening of embeddings: principal components with unit variance.

One pass gathers the number of vectors, exact sums and the centred scatter: each batch is centred on its own mean before it is
multiplied, and parts are merged with the exact difference of their means. The scatter, whose size is that of the dimension squared, is
factored by Cholesky with diagonal pivoting; one-sided Jacobi rotations then make the columns of the triangular factor orthogonal. Their
squared norms are the eigenvalues, the normalised columns the components; the covariance itself is never squared or iterated on.
A second pass measures the covariance of the whitened vectors, a third returns them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts are merged in so many tasks before the driver merges what they give.
_MERGERS = 32
_SWEEPS = 60


class Moments:
    """Number, sums and centred scatter of vectors; sums are Python integers for whole numbers."""

    def __init__(self, n: int, sums: list, scatter: np.ndarray):
        self.n, self.sums, self.scatter = n, sums, scatter

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of the rows of a matrix of whole numbers or of floating-point numbers."""
        n = len(x)
        if x.dtype.kind == "i":
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums = [int(a) * (1 << 32) + int(b) for a, b in zip(high, low, strict=True)]
            y = centred(x, n, sums)
        else:
            sums = x.sum(axis=0).tolist()
            y = x - np.array(sums) / n
        return cls(n, sums, y.T @ y)

    def merged(self, other: Moments) -> Moments:
        a, b = self.n, other.n
        apart = np.array([(v * a - u * b) / (a * b) for u, v in zip(self.sums, other.sums, strict=True)])
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (a * b / (a + b))
        return Moments(a + b, [u + v for u, v in zip(self.sums, other.sums, strict=True)], scatter)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Whole numbers less the mean: the whole part is subtracted exactly."""
    return (x - np.array([s // n for s in sums], np.int64)) - np.array([s % n / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Of each row, the sum over its entries of (n * x - sum) ** 2, exact."""
    y = x - np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    if (n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 * max(1, x.shape[1]) >= 1 << 63:
        y, rest = y.astype(object), rest.astype(object)
    return ((n * y - rest) ** 2).sum(axis=1).tolist()


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def gather(frame: DataFrame, matrix: callable) -> Moments | None:
    """The moments of all rows of ``matrix(batch)``, or None; the driver gets one part from each merging task."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                own = Moments.of(matrix(batch))
                found = found.merged(own) if found else own
        if found:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"merger": pa.array([task % _MERGERS], pa.int32()), "task": pa.array([task], pa.int32()), "moments": pa.array([pickle.dumps(found)], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("task").to_pylist(), table.column("moments").to_pylist(), strict=True))
        found = pickle.loads(rows[0][1])
        for _, more in rows[1:]:
            found = found.merged(pickle.loads(more))
        return pa.table({"task": pa.array([rows[0][0]], pa.int32()), "moments": pa.array([pickle.dumps(found)], pa.binary())})

    parts = frame.mapInArrow(part, "merger int, task int, moments binary").groupBy("merger").applyInArrow(merge, "task int, moments binary")
    found = None
    for r in sorted(parts.collect(), key=lambda r: r.task):
        more = pickle.loads(r.moments)
        found = found.merged(more) if found else more
    return found


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``l`` and ``order`` with ``a[order][:, order] = l @ l.T``; ``l`` has as many columns as ``a`` has rank."""
    size = len(a)
    order, left = np.arange(size), a.diagonal().copy()
    factor = np.zeros((size, size))
    least = left.max(initial=0) * size * np.finfo(float).eps
    for k in range(size):
        p = k + int(left[k:].argmax())
        if left[p] <= least:
            return factor[:, :k], order
        for x in (order, left, factor):
            x[[k, p]] = x[[p, k]]
        factor[k, k] = np.sqrt(left[k])
        factor[k + 1 :, k] = (a[order[k + 1 :], order[k]] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def _rounds(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns, in rounds of disjoint pairs (each column meets every other once)."""
    ring = list(range(size + size % 2))
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :]), strict=True) if max(a, b) < size]
        yield np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The matrix with its columns rotated until they are orthogonal."""
    columns = factor.T.copy()
    rounds = list(_rounds(len(columns)))
    close = np.finfo(float).eps * max(1, len(columns))
    for _ in range(_SWEEPS):
        worst = 0.0
        for left, right in rounds:
            p, q = columns[left], columns[right]
            pp, qq, pq = (p * p).sum(axis=1), (q * q).sum(axis=1), (p * q).sum(axis=1)
            off = np.abs(pq) / np.maximum(np.sqrt(pp * qq), np.finfo(float).tiny)
            worst = max(worst, float(off.max(initial=0)))
            zeta = (qq - pp) / np.where(pq == 0, 1, 2 * pq)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            t = np.where(off <= np.finfo(float).eps, 0, t)[:, None]
            c = 1 / np.hypot(1, t)
            columns[left], columns[right] = c * (p - t * q), c * (t * p + q)
        if worst <= close:
            break
    return columns.T


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a centred scatter, as many as its rank."""
    factor, order = pivoted_cholesky(scatter)
    rotated = one_sided_jacobi(factor)
    norms = np.sqrt((rotated**2).sum(axis=0))
    by = np.argsort(-norms, kind="stable")
    vectors = np.zeros_like(rotated)
    vectors[order] = rotated / norms
    return norms[by] ** 2, vectors[:, by]


def whole_numbers(vector: Column | str, scale: int = 1024, shift: int = 100_000) -> Column:
    """The entries as whole numbers, ``floor(scale * c) + shift``; null for vectors that are null or hold an entry that is null, not
    finite, or 2**42 or larger (which whole numbers of 64 bits do not hold safely)."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    usable = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 42), F.lit(False)))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long")))


def whiten(vectors: DataFrame, most: int = 8) -> DataFrame:
    """The whitened coordinates of ``vec_id`` and ``x`` (array of whole numbers).

    One row per vector and component, up to ``most``: ``vec_id``, ``component`` (from 1, by falling eigenvalue), ``n`` (vectors),
    ``deviation`` (the sum over entries of (n * x - sum) ** 2, exact; null beyond the range of a long), ``deviation_text`` (the same
    in decimal, of any size), ``whitened``, ``explained`` (share of the variance) and ``identity_error`` (largest absolute entry of the
    whitened vectors' covariance less the identity, measured over all of them).

    Rows with a null ``x`` are left out, and those of another length than most rows have (of lengths equally common, the largest
    counts). Repeated vectors count each, also without ``vec_id``; other columns are ignored. Directions without variance are no
    components: one distinct vector alone, empty vectors, or no rows give none. Equal eigenvalues leave the choice of components open;
    it is made once, for all rows.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast("array<long>").alias("x")).filter("x is not null and forall(x, c -> c is not null)")
    sizes = own.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    schema = "vec_id long, component int, n long, deviation_text string, whitened double, explained double, identity_error double"
    own = own.filter(F.size("x") == (sizes[0]["size"] if sizes else -1))
    found = gather(own, lambda batch: _matrix(batch.column("x"), np.int64)) if sizes and sizes[0]["size"] else None
    values, vecs = components(found.scatter) if found else (np.zeros(0), np.zeros((0, 0)))
    kept = min(most, len(values))
    if not kept:
        return _typed(own.sparkSession.createDataFrame([], schema))
    n, sums = found.n, found.sums
    basis = vecs[:, :kept] / np.sqrt(values[:kept] / n)
    explained = values[:kept] / found.scatter.trace()

    def whitened(batch: pa.RecordBatch) -> np.ndarray:
        return centred(_matrix(batch.column("x"), np.int64), n, sums) @ basis

    again = gather(own, whitened)
    error = float(np.abs(again.scatter / again.n - np.eye(kept)).max())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            each = np.repeat(np.arange(rows), kept)
            exact = pa.array(map(str, deviations(_matrix(batch.column("x"), np.int64), n, sums)), pa.string(), size=rows)
            columns = [
                batch.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * kept, n)),
                exact.take(pa.array(each)),
                pa.array(whitened(batch).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * kept, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return _typed(own.mapInArrow(run, schema))


def _typed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("deviation", F.expr("try_cast(deviation_text as bigint)"))
