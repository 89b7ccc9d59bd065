"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Every entry becomes a whole number, so that counts, sums and deviations are exact. Three passes
fit the model: the length of the vectors, their sums, and the scatter about the mean. What leaves
a task is one sum a dimension or a pair of dimensions, and what reaches the driver is one matrix
of the dimensions, however many rows there are. There the scatter's pivoted Cholesky factor is
rotated, column against column, until all columns are orthogonal: their squared norms are then the
eigenvalues and the columns themselves, normalised, the components. No matrix is squared on the
way, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.frames import small_batches, with_struct

#: An entry c stands for floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries from here on cannot be scaled exactly in doubles; they count as not finite.
TOO_LARGE = float((1 << 53) // SCALE)
#: Components of the query.
COMPONENTS = 32
#: Share of all variance up to which a direction is rounding noise, not a component.
NOISE = 1e-11
#: Cosine of two columns that counts as orthogonal, and the sweeps in which to get there.
ORTHOGONAL, SWEEPS = 1e-15, 60
_LOW_BITS = 26
_LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """What the vectors of one length have in common.

    ``low`` and ``rest`` give each dimension's sum as ``n * low + rest`` with ``0 <= rest < n``;
    ``components`` has a column for each eigenvalue in ``values``, largest first.
    """

    size: int
    n: int
    low: np.ndarray
    rest: list[int]
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    identity_error: float | None = None

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.values]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Entries less their dimension's mean; the whole part is taken off in whole numbers."""
        return (x - self.low) - np.array([float(r) for r in self.rest]) / max(self.n, 1)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))


def usable(vector: Column) -> Column:
    """Whether a vector has entries, and all of them are finite and can be scaled exactly."""
    fine = F.forall(vector, lambda v: v.isNotNull() & (F.abs(v) < F.lit(TOO_LARGE)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def whole(column: pa.Array, size: int) -> np.ndarray:
    """The scaled entries of vectors of one length, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, size) + OFFSET


def common_size(vectors: DataFrame, vector: str = "embedding") -> int:
    """The length that most usable vectors have, the longer of equally common ones; 0 for none."""
    sizes = vectors.filter(usable(F.col(vector))).groupBy(F.size(vector).alias("size")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return top["size"] if top else 0


def remaining(vectors: DataFrame, size: int, vector: str = "embedding") -> DataFrame:
    """The rows with a usable vector of that length."""
    return vectors.filter(usable(F.col(vector)) & (F.size(vector) == size))


def _folded(
    vectors: DataFrame, vector: str, schema: str, start: Callable, add: Callable, rows: Callable
) -> DataFrame:
    """One set of rows for each partition, made of what its batches add up to."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = start()
        for batch in batches:
            if batch.num_rows:
                add(total, batch.column(0))
        yield pa.RecordBatch.from_pydict(rows(total))

    return vectors.select(vector).mapInArrow(run, schema)


def _sums(vectors: DataFrame, vector: str, size: int) -> tuple[int, list[int]]:
    """The number of vectors and each dimension's exact sum.

    Entries are added in a high and a low part, neither of which leaves 64 bits within a task.
    """

    def add(total: dict, column: pa.Array) -> None:
        x = whole(column, size)
        total["n"] += len(x)
        total["high"] += (x >> _LOW_BITS).sum(axis=0)
        total["low"] += (x & ((1 << _LOW_BITS) - 1)).sum(axis=0)

    parts = _folded(
        vectors, vector, "dim int, n long, high long, low long",
        lambda: {"n": 0, "high": np.zeros(size, np.int64), "low": np.zeros(size, np.int64)},
        add,
        lambda t: {"dim": pa.array(np.arange(size, dtype=np.int32)), "n": pa.array([t["n"]] * size, pa.int64()),
                   "high": pa.array(t["high"]), "low": pa.array(t["low"])},
    )
    wide = "decimal(38,0)"
    found = (
        parts.groupBy("dim")
        .agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast(wide)).alias(c) for c in ("high", "low")])
        .orderBy("dim")
        .collect()
    )
    return found[0]["n"], [(int(r["high"]) << _LOW_BITS) + int(r["low"]) for r in found]


def _products(
    vectors: DataFrame, vector: str, size: int, width: int, made: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """The sum over all vectors of each made row's products of two entries."""
    left, right = np.triu_indices(width)

    def add(total: list, column: pa.Array) -> None:
        y = made(whole(column, size))
        total[0] += y.T @ y

    parts = _folded(
        vectors, vector, "i int, j int, v double", lambda: [np.zeros((width, width))], add,
        lambda t: {"i": pa.array(left.astype(np.int32)), "j": pa.array(right.astype(np.int32)),
                   "v": pa.array(t[0][left, right])},
    )
    out = np.zeros((width, width))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out


def pivoted_cholesky(matrix: np.ndarray, least: float) -> np.ndarray:
    """A factor F with ``F @ F.T`` equal to the matrix, as far as pivots exceed ``least``.

    Rows stand in the matrix's order; taken in the order of the pivots they are triangular.
    """
    d = len(matrix)
    factor, order, left = np.zeros((d, d)), np.arange(d), np.diag(matrix).copy()
    for k in range(d):
        best = k + int(np.argmax(left[order[k:]]))
        if left[order[best]] <= least:
            return factor[:, :k]
        order[[k, best]] = order[[best, k]]
        pivot, others = order[k], order[k + 1 :]
        factor[pivot, k] = np.sqrt(left[pivot])
        done = factor[others, :k] @ factor[pivot, :k]
        factor[others, k] = (matrix[others, pivot] - done) / factor[pivot, k]
        left[others] -= factor[others, k] ** 2
    return factor


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds of pairs that share none."""
    seats = list(range(n)) + [-1] * (n % 2)
    for _ in range(len(seats) - 1):
        pairs = [p for p in zip(seats, reversed(seats), strict=True)][: len(seats) // 2]
        pairs = [p for p in pairs if -1 not in p]
        if pairs:
            yield np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        seats = [seats[0], seats[-1], *seats[1:-1]]


def rotate_columns(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors of ``factor @ factor.T``, largest first.

    Pairs of columns are rotated until they are orthogonal; a rotation of columns leaves that
    product as it is.
    """
    a = factor.copy()
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in _rounds(a.shape[1]):
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            cosine = np.abs(xy) / np.sqrt(np.maximum(xx * yy, np.finfo(float).tiny))
            worst = max(worst, float(cosine.max()))
            turned = cosine > ORTHOGONAL
            zeta = (yy - xx) / np.where(turned, 2 * xy, 1)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turned, t, 0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if worst <= ORTHOGONAL:
            break
    values = (a * a).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    values, a = values[order], a[:, order]
    return values, a / np.sqrt(np.maximum(values, np.finfo(float).tiny))


def fit(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> Whitening:
    """Fit the whitening of a table's vectors to all rows that :func:`remaining` keeps.

    Repeated rows count as often as they stand there. Directions with a share of the variance of
    NOISE or less are no components, so equal vectors, a single one, or none give none. The
    numbers of dimensions and components bound what the driver and a task hold.
    """
    size = common_size(vectors, vector)
    if not size:
        return Whitening(0, 0, np.zeros(0, np.int64), [])
    rows = remaining(vectors, size, vector)
    n, sums = _sums(rows, vector, size)
    low = [s // n for s in sums]
    model = Whitening(size, n, np.array(low, np.int64), [s - n * m for s, m in zip(sums, low, strict=True)])
    covariance = _products(rows, vector, size, size, model.centred) / n
    trace = float(np.trace(covariance))
    if not trace > 0:
        return model
    values, found = rotate_columns(pivoted_cholesky(covariance, NOISE * trace))
    kept = int((values > NOISE * trace).sum())
    kept = min(kept, components)
    fitted = Whitening(size, n, model.low, model.rest, trace, values[:kept], found[:, :kept])
    return Whitening(**{**vars(fitted), "identity_error": _identity_error(rows, vector, fitted)})


def _identity_error(rows: DataFrame, vector: str, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' own covariance less the identity."""
    k = len(model.values)
    # A column of ones beside them gives the means in the same pass.
    made = lambda x: np.column_stack([model.whiten(x), np.ones(len(x))])
    total = _products(rows, vector, model.size, k + 1, made) / model.n
    return float(np.abs(total[:k, :k] - np.outer(total[k, :k], total[k, :k]) - np.eye(k)).max())


def _deviations(model: Whitening, x: np.ndarray) -> pa.Array:
    """Each row's exact sum of ``(n * x - S) ** 2``, null where it does not fit a long."""
    about = ((model.n * model.centred(x)) ** 2).sum(axis=1)
    small = about < 2.0**62
    rest = np.array([r if r <= _LONGEST else 0 for r in model.rest], np.int64)
    out = ((np.where(small[:, None], model.n * (x - model.low), 0) - rest * small[:, None]) ** 2).sum(axis=1)
    exact = out.tolist()
    for row in np.flatnonzero(~small).tolist():
        parts = zip((x[row] - model.low).tolist(), model.rest, strict=True)
        value = sum((model.n * a - r) ** 2 for a, r in parts)
        exact[row] = value if value <= _LONGEST else None
    return pa.array(exact, pa.int64())


def add_whitened(
    vectors: DataFrame,
    model: Whitening,
    keep: list[str] | None = None,
    vector: str = "embedding",
    name: str = "whitened",
) -> DataFrame:
    """Add a struct of ``deviation`` and ``values`` (one for each component) to remaining rows.

    Rows go whose vector is null or empty, holds a null, NaN, infinite or too large entry, or has
    another length than the fitted one. Null ids, repeated rows and other columns stay as they
    are; an older column of the new one's name is replaced. Without components ``values`` is empty.
    """
    fields = T.StructType(
        [T.StructField("deviation", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))]
    )
    k = len(model.values)

    def prepare() -> Callable[[pa.Array], pa.StructArray]:
        def compute(column: pa.Array) -> pa.StructArray:
            x = whole(column, model.size)
            flat = model.whiten(x).ravel() if k else np.zeros(0)
            starts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            values = pa.ListArray.from_arrays(starts, pa.array(flat))
            return pa.StructArray.from_arrays([_deviations(model, x), values], names=["deviation", "values"])

        return compute

    rows = remaining(vectors, model.size, vector)
    return with_struct(rows, name, fields, prepare, keep, text=vector)


def component_rows(whitened: DataFrame, model: Whitening, name: str = "whitened") -> DataFrame:
    """One row for each vector and component, with what holds for the component and for all."""
    explained = F.array(*[F.lit(x) for x in model.explained]).cast("array<double>")
    others = [c for c in whitened.columns if c != name]
    return whitened.select(*others, f"{name}.deviation", F.posexplode(f"{name}.values").alias("place", "whitened")).select(
        *others,
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
