"""Whitening by LOBPCG.

The covariance is never formed. A pass over the stored vectors centres each, multiplies it into a block of directions and
sums the products over a partition; Spark sums these over all partitions. The driver holds blocks of as many rows as
there are dimensions and at most three times as many columns as components. Each step it takes the Rayleigh-Ritz vectors
of the span of the iterate, its residuals and the previous directions, until the residual of every component, taken by a
pass of its own, is below TOLERANCE of the largest eigenvalue: for each there is then an eigenvalue that near. Then all
rows are projected, and a last pass measures the covariance of the projections.

Components become x = floor(scale * c) + shift. Sums are exact, and n * x - sum is exact before it is divided by n, so a
large shift costs no digit.

Defined results: rows whose vector is null, empty, or holds a null or non-finite component take no part, nor do those of
another length than the commonest (the longer, if two are); a null id stays null; repeated rows count each, a vector may
be any part of all rows; components without variance (an eigenvalue below RANK of the largest) have no whitened value and
are left out, so a table of equal rows, or of one, has no rows, and an empty table none; whole numbers that exceed 2^53
and deviations that exceed a long are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

TOLERANCE = 1e-13
#: What is still certified if rounding keeps residuals from falling further.
CERTIFIED = 1e-9
RANK = 1e-10
#: Directions besides the components asked for.
GUARD = 8
STEPS = 200
#: Rows that a worker centres at a time.
ROWS = 4096


class Centred:
    """Whole-number vectors and their exact moments; `times` is a pass over all rows."""

    def __init__(self, vectors: DataFrame, scale: float, shift: int, id_col: str, vector_col: str):
        v = F.col(c.q(vector_col)).cast("array<double>")
        good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        lengths = vectors.where(good).groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        self.d, self.n = (lengths["d"], lengths["n"]) if lengths else (0, 0)
        whole = F.transform(v, lambda x: F.floor(x * scale) + F.lit(shift).cast("long"))
        self.rows = c.stored(vectors.where(good & (F.size(v) == self.d)).select(F.col(c.q(id_col)).cast("long").alias("vec_id"), whole.alias("x")), "whole")
        d, sums = self.d, np.zeros(self.d, object)
        partial = self.rows.mapInArrow(lambda batches: _sums(batches, d), "dim int, s long, most long")
        most = 0
        for r in partial.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("most").alias("most")).collect():  # a row for each dimension
            sums[r["dim"]], most = int(r["s"]), max(most, r["most"])
        self.sums = sums
        if most >= 1 << 53 or most * self.n >= 1 << 62:
            raise OverflowError("whole numbers times rows exceed a long")

    def centre(self):
        """A function from a batch's vectors to the exact n * x - sum."""
        n, sums, d = self.n, self.sums.astype(np.int64), self.d
        return lambda x: x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) * n - sums

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of directions."""
        n, d, m, centre = self.n, self.d, block.shape[1], self.centre()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d, m))
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    x = centre(batch.column(0).slice(k, ROWS)) / n
                    total += x.T @ (x @ block)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), *(pa.array(y) for y in total.T)], names=["dim", *(f"y{j}" for j in range(m))])

        names = [f"y{j}" for j in range(m)]
        partial = self.rows.select("x").mapInArrow(run, T.StructType([T.StructField("dim", T.IntegerType()), *(T.StructField(x, T.DoubleType()) for x in names)]))
        out = np.zeros((d, m))
        for r in partial.groupBy("dim").agg(*[F.sum(x).alias(x) for x in names]).collect():  # a row for each dimension
            out[r["dim"]] = r[1:]
        return out / n

    def trace(self) -> float:
        """The sum of the variances."""
        n, d, centre = self.n, self.d, self.centre()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = centre(batch.column(0)) / n
                yield pa.RecordBatch.from_pydict({"s": [float((x * x).sum())]})

        return (self.rows.select("x").mapInArrow(run, "s double").agg(F.sum("s")).first()[0] or 0.0) / n if d else 0.0


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    total, most = [0] * d, 0
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        if len(x):
            most = max(most, int(max(abs(int(x.max())), abs(int(x.min())))))
            if most * len(x) >= 1 << 62:
                raise OverflowError("whole numbers times rows exceed a long")
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
    if most:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(total, pa.int64()), pa.array([most] * d, pa.int64())], names=["dim", "s", "most"])


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block's columns add to an orthonormal basis; those that add nothing but rounding go."""
    for _ in range(2):
        norm = np.linalg.norm(block, axis=0)
        block = block[:, norm > 0] / norm[norm > 0]
        block = block - against @ (against.T @ block)
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-8]
    return block


def lobpcg(times, d: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric positive matrix, given by its products with blocks: values, vectors, residual norms."""
    m = min(d, k + GUARD)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    ax, p, best, stalled = times(x), np.zeros((d, 0)), np.inf, 0
    for _ in range(STEPS):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        residual = ax - x * values
        norms = np.linalg.norm(residual[:, :k], axis=0)
        scale = max(values[0], 0.0)
        if norms.max(initial=0.0) <= TOLERANCE * scale or stalled >= 3:
            # the products were carried along: take the residuals anew
            x = np.linalg.qr(x)[0]
            ax = times(x)
            values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
            x, ax, values = x @ turn[:, ::-1], ax @ turn[:, ::-1], values[::-1]
            norms = np.linalg.norm((ax - x * values)[:, :k], axis=0)
            if norms.max(initial=0.0) <= max(TOLERANCE, CERTIFIED if stalled >= 3 else 0.0) * scale or m == d:
                return values[:k], x[:, :k], norms
            residual, stalled = ax - x * values, 0
        stalled = stalled + 1 if norms.max() > best / 2 and norms.max() <= CERTIFIED * scale else 0
        best = min(best, norms.max())
        new = orthonormal(residual, x)
        new = np.hstack([new, orthonormal(p, np.hstack([x, new]))]) if p.shape[1] else new
        if not new.shape[1]:
            return values[:k], x[:, :k], norms  # the span is the whole space or invariant
        basis, products = np.hstack([x, new]), np.hstack([ax, times(new)])
        _, turn = np.linalg.eigh((basis.T @ products + products.T @ basis) / 2)
        turn = turn[:, ::-1][:, :m]
        old = x.shape[1]
        p = new @ turn[old:]
        x, ax = basis @ turn, products @ turn
    raise ArithmeticError(f"residuals of {norms.max()} after {STEPS} steps")


def whitened(vectors: DataFrame, k: int = 32, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error, residual of each row and component."""
    data = Centred(vectors, scale, shift, id_col, vector_col)
    trace = data.trace()
    if trace > 0:
        values, axes, residuals = lobpcg(data.times, data.d, min(k, data.d))
        there = values > RANK * values[0]
        values, axes, residuals = values[there], axes[:, there], residuals[there]
    else:
        values, axes, residuals = np.zeros(0), np.zeros((data.d, 0)), np.zeros(0)
    n, m, centre, turn = data.n, len(values), data.centre(), axes / np.sqrt(values)
    # the covariance of what is returned, not of what it should be
    measured = turn.T @ data.times(turn) if m else np.zeros((0, 0))
    error = float(np.abs(measured - np.eye(m)).max(initial=0.0))

    def fn(batches):
        for (x,) in batches:
            exact = centre(x)
            top = float(np.abs(exact).max(initial=0))
            squares = (exact * exact).sum(axis=1) if top * top * exact.shape[1] < 2**62 else np.array([sum(int(y) ** 2 for y in row) for row in exact], object)
            if len(squares) and max(squares) >= 1 << 63:
                raise OverflowError("deviations exceed a long")
            z = (exact / n) @ turn
            yield [pa.array(squares, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, m) if m else np.zeros(len(z) + 1), pa.int32()), pa.array(z.ravel()))]

    made = c.map_batches(data.rows, ["x"], fn, [T.StructField("deviation", T.LongType()), T.StructField("z", T.ArrayType(T.DoubleType()))], ["vec_id"])
    one = lambda numbers: F.get(F.array(*[F.lit(float(y)) for y in numbers]) if m else F.array().cast("array<double>"), F.col("at"))
    return made.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        one(values / trace if m else []).alias("explained"), F.lit(error).alias("identity_error"), one(residuals).alias("residual"),
    )
