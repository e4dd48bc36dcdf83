"""Embedding whitening: principal components of all vectors, each scaled to unit variance.

Three scans of the vectors and one small solve. (1) Sums of the integer vectors x = floor(64 c) + 1,000,000,
exact. (2) The covariance: each task centres its vectors, multiplies them and sends one matrix, row by row;
rows meet by their number and are added as they stream by, so no task holds more than its share of one matrix.
(3) The whitened vectors and what their covariance differs from the identity by.

The solve is mixed-precision refinement (Ogita and Aishima): eigenvectors in float32, then iterations of matrix
products in extended precision that double the number of right digits; eigenvalues closer together than the
current error cannot be told apart by it, so each such cluster is solved by itself, as a small matrix with its
mean taken off. The matrix has dimension^2 entries and is all that the driver holds.

A null vector, or one with a null or non-finite entry, is dropped. The dimension is that of most vectors (of
equal numbers the larger); vectors of another one, and empty ones, are dropped too. Entries of x saturate
at +-2**40. Repeated rows and vectors each count; a null vec_id is carried along. Directions without variance have
no component, so equal vectors, a single one or an empty table give no rows. `deviation` is null where it is too
large for a long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
WIDEST = 1 << 40
#: Vectors that one step works on.
STEP = 4096
EXACT = np.longdouble


def _vectors(batch: pa.RecordBatch, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer vectors as doubles) of the vectors that count; of `dim`, or of each length in turn."""
    column = batch.column(1)
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for n in [dim] if dim else np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        for at in range(0, len(rows), STEP):
            some = rows[at : at + STEP]
            flat = column.take(pa.array(some)).flatten()
            values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(some), n)
            fine = np.isfinite(values).all(axis=1)
            if fine.any():
                yield some[fine], np.clip(np.floor(SCALE * values[fine]) + SHIFT, -WIDEST, WIDEST)


def _named(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))


def vector_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(number, sums by dimension) of the vectors of the commonest length, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, x in _vectors(batch):
                n, total = sums.get(x.shape[1], (0, 0))
                sums[x.shape[1]] = [n + len(x), total + x.astype(np.int64).sum(axis=0)]
        for dim, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(total)], names=["dim", "i", "n", "total"])

    # A row for each dimension; totals as decimals, which no number of vectors overflows.
    by_dim = vectors.mapInArrow(run, "dim int, i int, n long, total long").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    best = by_dim.where("i = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if best is None:
        return 0, []
    return best.n, [int(r.total) for r in by_dim.where(F.col("dim") == best.dim).orderBy("i").collect()]


def _summed_matrix(df: DataFrame, partial, dim: int) -> np.ndarray:
    """The sum of the matrices that `partial` makes of each task's batches. Rows of one number meet and are added as they come."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            for _, x in _vectors(batch, partial.dim):
                total += partial(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, dim)
            for i, row in zip(batch.column(0).to_pylist(), rows, strict=True):
                sums[i] = sums[i] + row if i in sums else row.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "row"])

    schema = "i int, row array<double>"
    out = np.zeros((dim, dim))
    for i, row in df.mapInArrow(send, schema).repartition("i").mapInArrow(add, schema).collect():  # dim rows of dim numbers
        out[i] = row
    return out


class _Centred:
    """x'x of vectors less the whole number next to the mean: sums of whole numbers, exact below 2**53, in any order."""

    def __init__(self, centre: np.ndarray):
        self.centre, self.dim = centre, len(centre)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x - self.centre
        return y.T @ y


class _Whitened:
    def __init__(self, whitener: Whitener):
        self.whitener, self.dim = whitener, whitener.dim

    def __call__(self, x: np.ndarray) -> np.ndarray:
        # One more column of ones, so that the sums come along.
        w = np.column_stack([self.whitener.transform(x), np.ones(len(x))])
        return w.T @ w


@dataclass
class Whitener:
    """n, the sums of x, and the components (columns) with their eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, as doubles of whole numbers (exact below 2**53)."""
        whole = np.array([s // self.n for s in self.sums], np.float64)
        rest = np.array([s % self.n for s in self.sums], np.float64)
        return (x - whole) * self.n - rest

    def transform(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) / self.n @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n*x - S)^2, exact; None beyond a long."""
        z = self.centred(x)
        most = float(np.abs(z).max(initial=0))
        if most * most * max(1, z.shape[1]) < 1 << 62 and most < 1 << 53:
            return (z.astype(np.int64) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x]
        return [d if d < 1 << 63 else None for d in exact]


def refined_eigen(a: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, in the precision of EXACT."""
    a = np.asarray(a, EXACT)
    n = len(a)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(n, EXACT), np.eye(n, dtype=EXACT)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(EXACT)
    norm = np.sqrt((a * a).sum())
    floor = 8 * n * np.finfo(EXACT).eps * norm
    before = None
    for _ in range(rounds):
        ax = a @ x
        r, s = np.eye(n, dtype=EXACT) - x.T @ x, x.T @ ax
        s = (s + s.T) / 2  # else its rounding, over a small gap, would cost orthogonality
        value = np.diag(s) / (1 - np.diag(r))
        error = 2 * (np.sqrt(((s - np.diag(value)) ** 2).sum()) + norm * np.sqrt((r * r).sum()))
        if error <= floor or before is not None and error > before / 2 and error <= 64 * floor:
            break
        before = error
        gap = value[None, :] - value[:, None]
        near = np.abs(gap) <= error
        step = np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ step
        order = np.argsort(-value, kind="stable")
        x, value = x[:, order], value[order]
        for some in np.split(np.arange(n), np.flatnonzero(-np.diff(value) > error) + 1):
            if len(some) > 1:
                x[:, some] = _subspace(a, x[:, some], value[some].mean())
    value = np.einsum("ij,ij->j", x, a @ x) / (x * x).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    x = x[:, order] / np.sqrt((x * x).sum(axis=0))[order]
    return value[order] * scale, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(n)] < 0, -1, 1)


def _subspace(a: np.ndarray, x: np.ndarray, mean) -> np.ndarray:
    """x turned within its own span to the eigenvectors of a there; with the mean taken off, close values differ clearly."""
    x = x @ (1.5 * np.eye(x.shape[1], dtype=EXACT) - x.T @ x / 2)  # orthonormal to twice the digits
    small = x.T @ (a @ x) - mean * (x.T @ x)
    small = (small + small.T) / 2
    most = np.abs(small).max()
    if not most:
        return x
    turn = np.linalg.eigh((small / most).astype(np.float64))[1].astype(EXACT)
    # As x itself: a turn that is orthonormal in doubles only would leave x so in the last round.
    return x @ (turn @ (1.5 * np.eye(len(turn), dtype=EXACT) - turn.T @ turn / 2))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of all vectors; None without any. vectors: (vec_id, vector) as named by _named."""
    n, sums = vector_sums(vectors)
    if not n:
        return None
    whole = [(2 * s + n) // (2 * n) for s in sums]
    moments = _summed_matrix(vectors, _Centred(np.array(whole, np.float64)), len(sums)).astype(EXACT)
    off = np.array([EXACT(s - w * n) / EXACT(n) for s, w in zip(sums, whole, strict=True)], EXACT)
    covariance = moments / n - np.outer(off, off)
    value, vector = refined_eigen(covariance)
    kept = min(components, int((value > len(sums) * np.finfo(np.float64).eps * max(value[0], 0)).sum()))
    return Whitener(n, sums, vector[:, :kept].astype(np.float64), value[:kept].astype(np.float64), float(np.trace(covariance)))


def identity_error(vectors: DataFrame, whitener: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over all of them."""
    k = len(whitener.values)
    sums = _summed_matrix(vectors, _Whitened(whitener), k + 1) / whitener.n
    covariance = sums[:k, :k] - np.outer(sums[:k, k], sums[:k, k])
    return float(np.abs(covariance - np.eye(k)).max(initial=0))


def whiten(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    vectors = _named(df, vec_id, vector)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whitener = fit(vectors, components)
    if whitener is None or not len(whitener.values):
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(vectors, whitener), len(whitener.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = whitener.values / whitener.trace
        for batch in batches:
            for rows, x in _vectors(batch, whitener.dim):
                m = len(rows)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, whitener.n)), pa.array(whitener.deviation(x), pa.int64()).take(each),
                     pa.array(whitener.transform(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(run, schema)
