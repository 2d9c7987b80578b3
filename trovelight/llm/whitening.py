"""Whitening of vectors: distributed integer moments, eigenvectors in float32 refined in double precision.

The covariance is summed where the vectors are read. Its eigenvectors come from a float32 decomposition and
are corrected by the matrix-multiplication iteration of Ogita and Aishima ("Iterative refinement for
symmetric eigenvalue decomposition", 2018 and 2019), which doubles the right digits each round. Eigenvalues
closer than its error bound form a cluster, whose vectors are told apart by a smaller decomposition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.llm.common import prepared, row_field, row_of

COMPONENTS = 32
SCALE = 64.0
SHIFT = 1_000_000
# Whole numbers beyond this are not exact in a double; larger entries count as this.
_LARGEST = 2.0**52
# Eigenvalues up to this share of the largest, times the dimensions, are rounding errors of 0.
_NOTHING = 1e-14
_ROUNDS = 30


@dataclass(frozen=True)
class Whitening:
    """What whitening needs of a table: its size, the sums, eigenvalues (falling) and unit eigenvectors of the whole numbers.

    `components` has a column per eigenvalue above rounding; `explained` is each one's share of the trace.
    """

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def centre(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mean as whole numbers, what it lacks, and the same times n as whole numbers."""
        near = [round(s / self.n) for s in self.sums]
        rest = [s - self.n * c for s, c in zip(self.sums, near, strict=True)]
        return np.array(near, np.float64), np.array([r / self.n for r in rest]), np.array(rest, object)


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all are finite numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def _numbers(vectors: pa.Array, dims: int, scale: float, shift: int) -> np.ndarray:
    """A batch of vectors as whole numbers in doubles, floor(scale * entry) + shift."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.clip(np.floor(scale * values), -_LARGEST, _LARGEST) + shift


def _moments(rows: DataFrame, width: int, of: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products over the rows of what `of` makes of each batch; a task hands on width * (width + 1) numbers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            made = of(batch)
            total += made.sum(axis=0)
            products += made.T @ made
        both = np.concatenate([total, products.ravel()])
        for at in range(0, len(both), 1 << 16):
            block = both[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(block)), pa.int64()), pa.array(block)], names=["at", "value"])

    both = np.zeros(width * (width + 1))
    found = rows.mapInArrow(summed, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    both[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return both[:width], both[width:].reshape(width, width)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to double precision.

    Every round measures how far the vectors are from orthonormal (R) and the matrix from diagonal (S) in
    them, and corrects each pair by (S + value * R) / gap where the gap is over the error bound, else by half
    of R. The vectors of a cluster are then turned by the eigenvectors of the shifted matrix in them.
    """
    size = np.abs(matrix).max(initial=0.0) or 1.0
    a = matrix / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    before = np.inf
    for _ in range(_ROUNDS):
        r = np.eye(len(a)) - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        value = np.diag(s) / (1 - np.diag(r))
        bound = 2 * (np.linalg.norm(s - np.diag(value)) + np.linalg.norm(a) * np.linalg.norm(r))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > bound
        step = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1.0), r / 2)
        x = x + x @ step
        order = np.argsort(value, kind="stable")
        for cluster in np.split(order, np.flatnonzero(np.diff(value[order]) > bound) + 1):
            if len(cluster) > 1:
                inside = x[:, cluster]
                middle = value[cluster].mean()
                small = inside.T @ (a @ inside - middle * inside)
                x[:, cluster] = inside @ np.linalg.eigh((small + small.T) / 2)[1]
        change = np.abs(step).max(initial=0.0)
        if change < 1e-15 or change >= before / 2:
            break
        before = change
    value = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    x = x / np.linalg.norm(x, axis=0)
    order = np.argsort(-value, kind="stable")
    x = x[:, order]
    # Either sign would do; the largest entry of each is positive.
    x *= np.where(x[np.abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1.0, 1.0)
    return value[order] * size, x


def fitted(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of all usable vectors of `rows`, None where there are none.

    Vectors have to have one length. Two passes: sums of whole numbers, then products about the rounded mean,
    which are whole numbers too, so that the result does not depend on how rows are split. The driver reads a
    row for each pair of dimensions.
    """
    prepared(rows.sparkSession)
    vectors = rows.select(F.col(f"`{vector}`").alias("v")).where(usable(F.col("v")))
    n, low, high = vectors.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        return None
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} entries cannot be whitened together")
    dims = int(low)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, np.int64)
        for batch in batches:
            total += _numbers(batch.column(0), dims, scale, shift).astype(np.int64).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total)], names=["at", "value"])

    found = vectors.mapInArrow(summed, "at long, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums = tuple(int(row.value) for row in sorted(found.collect()))
    centre, lacking, _ = Whitening(n, sums, np.empty(0), np.empty((dims, 0)), np.empty(0)).centre()
    _, products = _moments(vectors, dims, lambda batch: _numbers(batch.column(0), dims, scale, shift) - centre)
    covariance = products / n - np.outer(lacking, lacking)
    values, axes = eigen((covariance + covariance.T) / 2)
    kept = np.flatnonzero(values > _NOTHING * dims * values[0])[:components] if values[0] > 0 else np.empty(0, int)
    trace = np.trace(covariance) or 1.0
    return Whitening(n, sums, values[kept], axes[:, kept], values[kept] / trace)


def _whitened(batch: pa.Array, model: Whitening, scale: float, shift: int) -> np.ndarray:
    centre, lacking, _ = model.centre()
    numbers = _numbers(batch, len(centre), scale, shift)
    return ((numbers - centre) - lacking) @ (model.components / np.sqrt(model.values))


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, summed over all of them."""
    width = len(model.values)
    vectors = rows.select(F.col(f"`{vector}`").alias("v")).where(usable(F.col("v")))
    total, products = _moments(vectors, width, lambda batch: _whitened(batch.column(0), model, scale, shift))
    mean = total / model.n
    return float(np.abs(products / model.n - np.outer(mean, mean) - np.eye(width)).max(initial=0.0))


def whitened(
    rows: DataFrame, model: Whitening | None, vector: str = "embedding", carry: list[str] | None = None, scale: float = SCALE, shift: int = SHIFT
) -> DataFrame:
    """Every row with a usable vector: its carried columns as struct `row`, deviation and whitened.

    `deviation` is the squared distance of n times the whole numbers from their sums, exact; `whitened` has an
    entry a component. Rows whose vector is null, has no entry, or holds null or non-finite entries are left out;
    so is every row where there is no model. Constant dimensions and repeated vectors give fewer components than asked
    for, equal vectors none. Repeated rows count each. Columns may have any names.
    """
    schema = T.StructType(
        [row_field(rows, carry), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    )
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    centre, _, rest = model.centre()
    near = rest.astype(np.float64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = _numbers(batch.column(1), len(centre), scale, shift) - centre
            reach = np.abs(numbers * model.n - near).max(initial=0.0)
            if reach**2 * len(centre) < 2.0**62:
                apart = numbers.astype(np.int64) * model.n - rest.astype(np.int64)
                deviation = pa.array((apart * apart).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                apart = numbers.astype(np.int64).astype(object) * model.n - rest
                deviation = pa.array([int(d) for d in (apart * apart).sum(axis=1)], pa.decimal128(38, 0))
            made = _whitened(batch.column(1), model, scale, shift)
            ends = np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, arrays], names=schema.names)

    vectors = rows.select(row_of(rows, carry), F.col(f"`{vector}`").alias("v")).where(usable(F.col("v")))
    return vectors.mapInArrow(project, schema)
