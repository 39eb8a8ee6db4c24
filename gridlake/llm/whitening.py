"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries c become integers x = floor(256 c).  The fit list is each distinct vector
once.  Its covariance V is never formed: for a small block Q of directions, one
distributed pass over the fit list gives V Q as the sum of Xc'(Xc Q), where Xc are
a batch's vectors less the mean (centred before multiplying).  Spark adds the
partial blocks up by dimension, so the driver sees dimensions x block numbers
whatever the number of rows.

Each round applies a Chebyshev polynomial of V to the block by its three-term
recurrence, one pass for a degree.  The polynomial stays within 1 on [0, cut], the
unwanted spectrum, and grows fast above it; ``cut`` is the smallest Ritz value of
the block, under which all but the block's own directions lie.  A QR
decomposition and a Rayleigh-Ritz step give the next block.  The iteration ends
when the wanted components are certified: the residual |V q - e q| of each is
at most ``TOLERANCE`` times the largest eigenvalue, or rounding allows no smaller one
(``PATIENCE`` rounds without a better one).  A vector of residual r is within
r / gap of an eigenvector.  Where the block holds all dimensions, the
first Rayleigh-Ritz step is already exact.

A covariance of up to ``components`` columns is all that leaves the iteration;
the whitened vectors are one more pass over all rows, with the same block for
every row.

Defined results for odd input: rows whose vector is null, or holds null, NaN or
infinite entries, are dropped, as are rows of another length than the most
frequent one (ties: the longest) and empty vectors; 256 c outside 64 bits is the nearest 64-bit integer; a
repeated row gets its result again; fewer dimensions than asked for give as many
components; a component without variance (an eigenvalue within rounding of 0, so also every component of a
single vector) has whitened null and explained 0 and is left out of the identity
error, which is 0 where no component is left; a deviation outside 64 bits is null; an empty table gives an
empty result; null and repeated ids and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import written

SCALE = 256
COMPONENTS = 4
GUARD = 20
DEGREE = 8
TOLERANCE = 2e-14
PATIENCE = 3
MAX_ROUNDS = 200
_BATCH_NUMBERS = 1 << 19
_EPS = float(np.finfo(float).eps)


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry as a long."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))) + F.lit(0))


def usable(vector: Column) -> Column:
    entries = vector.cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def integer_vectors(frame: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and x of the rows whose vector counts."""
    rows = frame.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")).filter(usable(F.col("vector")))
    rows = rows.select("id", quantised(F.col("vector")).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.filter(F.size("x") == (lengths["length"] if lengths else 0))


def matrices(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of Arrow batches with their vectors as an int64 matrix, of a bounded number of entries."""
    step = max(1, _BATCH_NUMBERS // width)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            values = part.column(column).flatten().to_numpy(zero_copy_only=False)
            yield part, values.reshape(part.num_rows, width)


def _exact_sum(x: np.ndarray) -> list[int]:
    """Column sums of int64 as Python integers, whatever their size."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(lo) for h, lo in zip(high.sum(axis=0), low.sum(axis=0))]


def column_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, [0] * width
        for _, x in matrices(batches, 0, width):
            rows += len(x)
            total = [a + b for a, b in zip(total, _exact_sum(x))]
        if rows:
            yield pa.RecordBatch.from_pydict(
                {"dim": range(width), "high": [t >> 32 for t in total], "low": [t & 0xFFFFFFFF for t in total], "n": [rows] * width},
                pa.schema([("dim", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("n", pa.int64())]),
            )

    parts = fit.select("x").mapInArrow(run, "dim int, high long, low long, n long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    sums = {r.dim: r for r in parts.groupBy("dim").agg(*wide, F.sum("n").alias("n")).collect()}
    if not sums:
        return 0, []
    return sums[0].n, [(int(sums[k].high) << 32) + int(sums[k].low) for k in range(width)]


def summed_block(
    fit: DataFrame, width: int, block: int, partial: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """Sum over the fit list of a (rows x block) matrix that ``partial`` makes of each batch of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in matrices(batches, 0, width):
            part = partial(x)
            total = part if total is None else total + part
        if total is not None:
            names = ["dim", *(f"c{k}" for k in range(block))]
            columns = [pa.array(range(len(total)), pa.int32()), *(pa.array(total[:, k]) for k in range(block))]
            yield pa.RecordBatch.from_arrays(columns, names)

    ddl = ", ".join(["dim int", *(f"c{k} double" for k in range(block))])
    parts = fit.select("x").mapInArrow(run, ddl)
    sums = parts.groupBy("dim").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(block))).collect()
    return np.array([r[1:] for r in sorted(sums)])


@dataclass
class Covariance:
    """V of the fit list as an operator on blocks of directions; ``passes`` counts the distributed passes."""

    fit: DataFrame
    n: int
    sums: list[int]
    passes: int = 0

    def __post_init__(self):
        # Python's division of integers is correctly rounded at any size.
        self.mean = np.array([s / self.n for s in self.sums])

    @property
    def width(self) -> int:
        return len(self.sums)

    def trace(self) -> float:
        mean = self.mean
        squares = summed_block(self.fit, self.width, 1, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None])
        return float(squares.sum()) / self.n

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        mean = self.mean
        self.passes += 1

        def partial(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return summed_block(self.fit, self.width, q.shape[1], partial) / self.n


@dataclass
class Components:
    """Certified leading eigenpairs: e falling, q as columns, the residual of each, rounds and passes taken."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    rounds: int
    passes: int


def chebyshev(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, degree: int, cut: float, top: float) -> np.ndarray:
    """The polynomial that is within 1 on [0, cut], scaled to 1 at ``top``, applied to the block; ``vq`` is V q.

    Scaling by the value at the largest eigenvalue keeps the recurrence from overflowing at any degree.
    """
    half = cut / 2
    first = half / (top - half)
    sigma, before, now = first, q, (vq - half * q) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - half * now) * (2 * following / half) - sigma * following * before
        sigma = following
    return now


def leading_components(
    covariance: Covariance, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, tolerance: float = TOLERANCE
) -> Components:
    width = covariance.width
    wanted, block = min(components, width), min(components + guard, width)
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((width, block)))
    best, since, rounds = None, 0, 0
    while True:
        vq = covariance @ q
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)
        top = max(float(values[0]), 0.0)
        rounds += 1
        if best is None or residuals.max() < 0.5 * best.residuals.max():
            since = 0
        else:
            since += 1
        if best is None or residuals.max() < best.residuals.max():
            best = Components(values[:wanted], q[:, :wanted], residuals, rounds, covariance.passes)
        # Rounding ends the progress only near the last digits; further away a slow spectrum is still moving.
        stuck = since >= PATIENCE and best.residuals.max() <= 1e-11 * top
        if residuals.max() <= tolerance * top or stuck or block == width or rounds >= MAX_ROUNDS:
            break
        cut = max(float(values[-1]), top * _EPS)
        if top - cut <= 8 * _EPS * top:  # all directions alike: any block will do
            break
        q, _ = np.linalg.qr(chebyshev(covariance.__matmul__, q, vq, degree, cut, top))
    if best.residuals.max() > 1e-9 * max(top, 1e-300):
        raise ArithmeticError(f"components not certified after {rounds} rounds: residual {best.residuals.max():.2e}")
    best.passes = covariance.passes
    return best


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2."""
    largest = max(int(np.abs(x, dtype=float).max()) + 1 if x.size else 0, 1)
    most = n * largest + max(map(abs, sums))
    if most < 1 << 62 and most * most * x.shape[1] < 1 << 63:
        return (((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


@dataclass
class Whitening:
    """What maps a vector x to (x - S/n) q / sqrt(e)."""

    n: int
    sums: list[int]
    components: Components
    explained: np.ndarray
    scales: np.ndarray  # NaN for a component without variance

    def whitened(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return ((x - mean) @ self.components.vectors) * self.scales


def identity_error(fit: DataFrame, whitening: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance, centred, less the identity."""
    good = np.flatnonzero(np.isfinite(whitening.scales))
    if not len(good):
        return 0.0
    width = len(whitening.sums)
    mean = summed_block(fit, width, 1, lambda x: whitening.whitened(x)[:, good].sum(axis=0)[:, None])[:, 0] / whitening.n

    def products(x: np.ndarray) -> np.ndarray:
        centred = whitening.whitened(x)[:, good] - mean
        return centred.T @ centred

    return float(np.abs(summed_block(fit, width, len(good), products) / whitening.n - np.eye(len(good))).max())


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Fits on a frame with one vector x of the given width a row; None where it is empty."""
    n, sums = column_sums(fit, width)
    if not n:
        return None
    covariance = Covariance(fit, n, sums)
    trace = covariance.trace()
    found = leading_components(covariance, components)
    good = found.values > max(trace, 1e-300) * width * 4 * _EPS
    with np.errstate(divide="ignore", invalid="ignore"):
        scales = np.where(good, 1 / np.sqrt(found.values), np.nan)
    explained = np.where(good, found.values / trace if trace else 0.0, 0.0)
    return Whitening(n, sums, found, explained, scales)


def whiten(frame: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    id_type = frame.schema[id_column].dataType.simpleString()
    rows = integer_vectors(frame, id_column, vector_column)
    # A common vector is counted once in each task before it is shuffled.
    fit = written(rows.select("x").distinct(), "fit_list")
    head = fit.select(F.size("x")).first()
    width = head[0] if head else 0
    whitening = fit_whitening(fit, width, components) if width else None
    ddl = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if whitening is None:
        return frame.sparkSession.createDataFrame([], ddl)
    error = identity_error(fit, whitening)
    k = len(whitening.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, 1, width):
            rows = len(x)
            white = whitening.whitened(x).reshape(-1)
            again = np.repeat(np.arange(rows), k)
            deviations = pa.array(_deviations(x, whitening.n, whitening.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, whitening.n, np.int64)),
                    deviations.take(pa.array(again)),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(np.tile(whitening.explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, ddl)
