"""Whitening of embeddings by polarisation.

Exact sums of squares of centred values are taken for every dimension and for the sum of every two. Since
``var(a + b) = var(a) + var(b) + 2 cov(a, b)``, differences of variances give all covariances, as exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed-point scale of entries, what is added, and the largest entry (a sum of squares then fits in 38 digits).
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**40
#: Entries of rows that a task squares at a time.
CELLS = 200_000


def usable(vec: Column) -> Column:
    """Neither null nor with null or non-finite entries."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vec.isNotNull() & ~F.exists(vec, bad)


def fixed(vec: Column) -> Column:
    """Entries as longs: ``floor(1024 * c) + 100000``. An entry beyond 2^40 fails the job; a vector
    that is not usable gives null."""
    one = lambda c: F.when(F.abs(c) > LARGEST, F.raise_error(F.lit(f"an entry is beyond {LARGEST}"))).otherwise(F.floor(SCALE * c.cast("double")) + SHIFT)
    return F.when(usable(vec), F.transform(vec, one))  # filters may be reordered


@dataclass(frozen=True)
class Whitener:
    """``n`` rows with sums ``sums``; ``values`` and ``vectors`` (columns) of the covariance by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        """Components with a variance: others can't be scaled to one."""
        return int((self.values > self.values.max(initial=0) * 1e-12).sum())


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dims or len(column) and (np.diff(column.offsets.to_numpy()) != dims).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), dims)


def _exact(z: np.ndarray, times: int) -> np.ndarray:
    """As whole numbers of any size, if ``times`` squares of its largest entry might leave 64 bits."""
    return z.astype(object) if len(z) and times * int(np.abs(z).max()) ** 2 >= 1 << 62 else z


def fit(x: DataFrame) -> Whitener | None:
    """Of a column ``x`` of long arrays, all rows; nothing without rows or dimensions.

    Two passes: sums, then squares of values less their floored mean. Each task hands on a number for each
    pair of dimensions, which are summed by pair as decimals; the driver gets ``d * (d + 1) / 2`` of them and
    one matrix to take apart, whatever the number of rows.
    """
    sums = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    if not sums:
        return None
    n, dims = max(r.n for r in sums), len(sums)
    if min(r.n for r in sums) < n:
        raise ValueError("vectors differ in length")
    total = [int(r.s) for r in sorted(sums, key=lambda r: r.i)]
    centre = np.array([s // n for s in total], np.int64)
    upper = np.triu_indices(dims)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((dims, dims), dtype=object)
        for batch in batches:
            z = _matrix(batch.column("x"), dims) - centre
            for part in np.array_split(z, -(-z.size // CELLS) or 1):
                part = _exact(part, 4 * len(part))
                total = np.zeros((dims, dims), part.dtype)
                for i in range(dims):
                    both = part[:, i:] + part[:, i : i + 1]
                    both[:, 0] = part[:, i]  # a dimension by itself
                    total[i, i:] = (both * both).sum(axis=0)
                held += total
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(list(map(int, held[upper])), pa.decimal128(38))], names=["i", "j", "q"])

    found = x.mapInArrow(squares, "i int, j int, q decimal(38,0)").groupBy("i", "j").agg(F.sum("q").alias("q")).collect()
    # With r = S - n * centre, what floored means leave: sums of (n x - S)^2 are n^2 q - n r^2, exactly.
    left = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    exact = {(r.i, r.j): n * n * int(r.q) - n * (left[r.i] + (left[r.j] if r.j != r.i else 0)) ** 2 for r in found}
    covariance = np.zeros((dims, dims))
    scale = n**3
    for (i, j), both in exact.items():
        cov = Fraction(both, scale) if i == j else Fraction(both - exact[i, i] - exact[j, j], 2 * scale)
        covariance[i, j] = covariance[j, i] = float(cov)
    values, vectors = np.linalg.eigh(covariance)
    return Whitener(n, tuple(total), values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(covariance)))


def project(x: DataFrame, model: Whitener, components: int) -> DataFrame:
    """``vec_id, deviation, w`` (an array of whitened values, ``x`` less the mean on each component over its deviation). The deviation is a
    long; one beyond 64 bits (from some millions of rows on) is null."""
    k, dims, n = min(components, model.rank), len(model.sums), model.n
    centre = np.array([s // n for s in model.sums], np.int64)
    left = [s - n * int(c) for s, c in zip(model.sums, centre, strict=True)]
    mean, over = np.array([r / n for r in left]), model.vectors[:, :k] / np.sqrt(model.values[:k])
    sum_left, rest = sum(r * r for r in left), np.array(left, dtype=object if n * dims >= 1 << 40 else np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column("x"), dims) - centre
            own = _exact(z, dims)
            # The sum of (n z - r)^2 in whole numbers of any size.
            sums = [n * n * int(a) - 2 * n * int(b) + sum_left for a, b in zip((own * own).sum(axis=1), own @ rest, strict=True)]
            w = (z - mean) @ over
            deviation = pa.array([v if v < 1 << 63 else None for v in sums], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    kind = x.schema["vec_id"].dataType.simpleString()
    return x.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of ``w`` less the identity, measured over all rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k + 1, k + 1)), 0
        for batch in batches:
            w = np.column_stack([_matrix(batch.column("w"), k), np.ones(batch.num_rows)])
            total, n = total + w.T @ w, n + batch.num_rows
        if n:
            a, b = np.indices((k + 1, k + 1)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total.ravel())], names=["a", "b", "s"])

    got = whitened.select("w").mapInArrow(moments, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect()
    table = np.zeros((k + 1, k + 1))
    for r in got:
        table[r.a, r.b] = r.s
    table /= table[k, k]
    return float(np.abs(table[:k, :k] - np.outer(table[:k, k], table[:k, k]) - np.eye(k)).max(initial=0))


def whiten(embeddings: DataFrame, components: int = 8, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    Rows whose vector is null or holds null or non-finite entries are left out. All others are fitted and whitened,
    repeated rows and null ids too. Components without a variance (fewer rows than dimensions, constant ones) are
    left out. Vectors that differ in length, and entries beyond 2^40, are errors. No usable rows give no rows.
    """
    kept = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("_v")).filter(usable(F.col("_v")))
    x = kept.select("vec_id", fixed(F.col("_v")).alias("x"))
    model = fit(x.select("x"))
    k = min(components, model.rank) if model else 0
    if not k:
        kind = embeddings.schema[vec_id].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = project(x, model, components)
    error = identity_error(rows, k)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values[:k]])
    return rows.select("vec_id", "deviation", F.posexplode("w").alias("_i", "whitened")).select(
        "vec_id", (F.col("_i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("_i")).alias("explained"), F.lit(error).alias("identity_error"),
    )
