"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers first, so that counts and sums are exact. The rows,
centred, are the tall matrix A. Its R factor is found by passes over the rows:
each pass takes the rows through the triangular solves of the factors so far,
adds up the Gram matrix of the result and factors it by Cholesky,

    A^T A + shift = R1^T R1,   Q1 = A R1^-1,
    Q1^T Q1 = R2^T R2,         Q2 = Q1 R2^-1,
    Q2^T Q2 = R3^T R3,         R = R3 R2 R1.

The shift of the first pass is above the rounding error of the Gram matrix, so
Cholesky cannot fail there however close to dependent the columns are; the next
two passes bring back what the shift took. The singular values and right vectors
of the small matrix R are those of A. No eigenvalue is taken from a Gram matrix
of A itself, which would square its condition.

Rows stay where they are: each pass is a map over the table that gives one
matrix of d x d a task, summed by columns in Spark. The driver holds d x d
numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers: floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: A larger whole number does not fit; it is held at this bound.
LARGEST = 1 << 62
PASSES = 3
#: Singular values below this share of the largest are rounding errors of zero.
NEGLIGIBLE = 1e-11
#: Rows of a block, and columns of the blocks in which matrices are summed.
ROWS, COLUMNS = 2048, 64


@dataclass(frozen=True)
class Fit:
    """The fit list's exact count and sums, and its components."""

    n: int
    sums: tuple[int, ...]
    wide: bool  # whole numbers are too large for 64-bit arithmetic
    components: np.ndarray  # d x k, unit columns
    eigenvalues: np.ndarray  # k, of the covariance, falling
    trace: float
    factors: tuple[np.ndarray, ...]  # R1, R2, R3
    identity_error: float | None


def finite(column: Column) -> Column:
    """Vectors without null or non-finite entries."""
    return column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """vec_id, embedding of the rows that take part, and their length."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"))
    rows = rows.filter(finite(F.col("embedding")) & (F.size("embedding") > 0))
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else 0
    return rows.filter(F.size("embedding") == d), d


def whole(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * entry) + OFFSET of doubles, as 64-bit integers."""
    scaled = np.floor(SCALE * entries)
    low, high = -float(LARGEST), float(LARGEST)
    return np.clip(scaled, low, high).astype(np.int64) + OFFSET


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, whole numbers) of a bounded number of rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            entries = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield part.column("vec_id"), whole(entries)


def differences(x: np.ndarray, n: int, sums: tuple[int, ...], wide: bool) -> np.ndarray:
    """n * x - S, exact."""
    if wide:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def solved(rows: np.ndarray, factors) -> np.ndarray:
    """rows R1^-1 R2^-1 ... by substitution, column by column."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[0]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def counts_and_sums(rows: DataFrame, d: int) -> tuple[int, tuple[int, ...], bool]:
    """n, the exact sum of each dimension, and whether n * x - S and its squares pass 64 bits."""

    def work(batches):
        n, total, low, high = 0, [0] * d, np.full(d, LARGEST), np.full(d, -LARGEST - 1)
        for _, x in blocks(batches, d):
            n += len(x)
            low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
            # halves of 31 bits: their sums over a block cannot overflow
            top, rest = (x >> 31).sum(0), (x & ((1 << 31) - 1)).sum(0)
            total = [t + (int(a) << 31) + int(b) for t, a, b in zip(total, top, rest, strict=True)]
        if n:
            text = pa.array([str(t) for t in total], pa.string())
            yield pa.RecordBatch.from_pydict(
                {"j": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "total": text, "low": pa.array(low), "high": pa.array(high)}
            )

    parts = rows.mapInArrow(work, "j int, n long, total string, low long, high long")
    whole_sum = F.sum(F.col("total").cast("decimal(38,0)"))
    found = parts.groupBy("j").agg(F.sum("n").alias("n"), whole_sum.alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("j").collect()
    if not found:
        return 0, (), False
    n, sums = found[0]["n"], tuple(int(r["total"]) for r in found)
    far = max(max(abs(n * r["low"] - s), abs(n * r["high"] - s), n * abs(r["low"]), n * abs(r["high"])) for r, s in zip(found, sums, strict=True))
    return n, sums, far * far * d >= 1 << 62 or far >= 1 << 62


def summed_matrix(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of the tasks' matrices; `parts` has i, block, entries. One group is a row's block of COLUMNS numbers a task."""

    def add(key, group):
        entries = group.column("entries").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        total = entries.sum(0)
        kind = pa.list_(pa.float64())
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "entries": pa.array([total], kind)})

    out = np.zeros((width, width))
    for r in parts.groupBy("i", "block").applyInArrow(add, "i int, block int, entries array<double>").collect():
        at = r["block"] * COLUMNS
        out[r["i"], at : at + len(r["entries"])] = r["entries"]
    return out


def gram(rows: DataFrame, d: int, width: int, transform) -> np.ndarray:
    """Sum of t^T t over the rows' blocks, where t = transform(whole numbers) has `width` columns."""

    def work(batches):
        total, any_row = np.zeros((width, width)), False
        for _, x in blocks(batches, d):
            t = transform(x)
            total += t.T @ t
            any_row = True
        if any_row:
            for at in range(0, width, COLUMNS):
                part = total[:, at : at + COLUMNS]
                yield pa.RecordBatch.from_pydict(
                    {
                        "i": pa.array(range(width), pa.int32()), "block": pa.array([at // COLUMNS] * width, pa.int32()),
                        "entries": pa.array(list(part), pa.list_(pa.float64())),
                    }
                )

    return summed_matrix(rows.mapInArrow(work, "i int, block int, entries array<double>"), width)


def cholesky(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper R with R^T R = g + shift. The shift bounds the rounding error of g; later passes take one only where g is not positive definite."""
    d = len(g)
    step = 11 * (min(n, ROWS) + d + 1) * d * np.finfo(float).eps / 2 * max(np.trace(g), np.finfo(float).tiny)
    shift = step if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, step)


def fit(rows: DataFrame, d: int, components: int) -> Fit | None:
    """Components of all of `rows`; None if there are no rows."""
    n, sums, wide = counts_and_sums(rows, d) if d else (0, (), False)
    if n == 0:
        return None

    def centred(x):
        return differences(x, n, sums, wide).astype(np.float64) / n

    factors: tuple[np.ndarray, ...] = ()
    for k in range(PASSES):
        done = factors
        g = gram(rows, d, d, lambda x, done=done: solved(centred(x), done))
        if k == 0 and not g.any():
            return Fit(n, sums, wide, np.zeros((d, 0)), np.zeros(0), 0.0, (), None)
        factors += (cholesky(g, n, shifted=k == 0),)
    r = factors[0]
    for later in factors[1:]:
        r = later @ r
    _, singular, right = np.linalg.svd(r)
    kept = min(components, int((singular > NEGLIGIBLE * singular[0]).sum()))
    axes = right[:kept].T
    largest = np.abs(axes).argmax(0)
    axes = axes * np.sign(axes[largest, range(kept)])
    eigenvalues, trace = singular[:kept] ** 2 / n, float((singular**2).sum() / n)

    def whitened(x):
        return centred(x) @ (axes / np.sqrt(eigenvalues))

    # the last column of ones brings the means
    both = gram(rows, d, kept + 1, lambda x: np.column_stack([whitened(x), np.ones(len(x))])) / n
    covariance = both[:kept, :kept] - np.outer(both[kept, :kept], both[kept, :kept])
    error = float(np.abs(covariance - np.eye(kept)).max())
    return Fit(n, sums, wide, axes, eigenvalues, trace, factors, error)


FIELDS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 32, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    A vector that is null, empty, or holds a null or non-finite entry takes no
    part; neither does one of another length than the most frequent (of two as
    frequent, the shorter). Repeated rows count each time and come back each
    time; null ids pass through; other columns are not looked at, whatever their
    names. No usable rows give no rows. A component without variance has no
    rows, so equal vectors alone give none. Equal eigenvalues: the components
    span their space, the same for all rows. Components have a positive largest
    entry.

    deviation, the sum over dimensions of (n * x - S)^2, is exact, and null where
    it does not fit a long.

    Six passes over the two columns; nothing of the table is shuffled or stored.
    """
    session = vectors.sparkSession
    rows, d = usable(vectors, id_column, vector_column)
    found = fit(rows, d, components)
    if found is None or not len(found.eigenvalues):
        return session.createDataFrame([], FIELDS)
    n, sums, wide, k = found.n, found.sums, found.wide, len(found.eigenvalues)
    to_whitened = found.components / np.sqrt(found.eigenvalues)
    explained, error = found.eigenvalues / found.trace, found.identity_error

    def work(batches):
        for ids, x in blocks(batches, d):
            far = differences(x, n, sums, wide)
            deviation = (far * far).sum(1)
            if wide:
                deviation = [v if v < 1 << 63 else None for v in deviation]
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": ids.take(pa.array(rows)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(rows), n, np.int64)),
                    "deviation": pa.array(deviation, pa.int64()).take(pa.array(rows)),
                    "whitened": pa.array((far.astype(np.float64) / n @ to_whitened).ravel()),
                    "explained": pa.array(np.tile(explained, len(x))),
                    "identity_error": pa.array(np.full(len(rows), error)),
                }
            )

    return rows.mapInArrow(work, FIELDS)
