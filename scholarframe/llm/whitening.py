"""Whitened vectors from the singular values of the centred rows.

The rows are never multiplied with themselves, which would square their
condition.  Each task centres its rows and compresses them, block by block,
to the triangular factor R of their QR decomposition; factors are stacked and
compressed again, a few at a time, until one is left.  Plane rotations then
make the columns of R orthogonal (one-sided Jacobi): their lengths are the
standard deviations, small ones as exact as large ones, and the accumulated
rotations are the components.  R has as many rows as a vector has entries,
whatever the number of rows.

Vectors are put on a grid first, ``floor(scale * c)``, so that sums over them
are whole numbers, the same in any order, and equal vectors are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarframe.session import stored

#: The most entries of a vector: R has their square, and is held by one task and the driver.
MOST_DIMENSIONS = 4096
#: Rows that a task compresses at a time, and factors that one task stacks.
BLOCK_ROWS, FAN_IN = 4096, 32
_LONG = float(2**63)


def gridded(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * c)`` of every entry as long; null for a vector that is null or has null or non-finite entries."""
    entries = vector.cast("array<double>")
    finite = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(entries, lambda c: F.floor(c * scale)))


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: the number of distinct vectors, their sums, and components by falling deviation."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        """The share of each component in all variance."""
        return self.deviations**2 / self.trace

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of a matrix of gridded vectors."""
        return centred(x, self.n, self.sums) @ (self.components / self.deviations)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - sums / n``, with the difference taken in whole numbers."""
    most = max(1.0, float(np.abs(x.astype(float)).max(initial=0))) * n
    if most < _LONG / 4 and float(np.abs(sums.astype(float)).max(initial=0)) < _LONG / 4:
        return (x * n - sums.astype(np.int64)) / n
    return ((x.astype(object) * n - sums) / n).astype(float)


def squared_distances(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum over entries of ``(n * x - sums) ** 2`` for each row, exact; null where a long cannot hold it."""
    away = x.astype(float) * n - sums.astype(float)
    rough = np.einsum("ij,ij->i", away, away)
    if rough.max(initial=0) < _LONG / 4:
        whole = x * n - sums.astype(np.int64)
        return np.einsum("ij,ij->i", whole, whole).tolist()
    whole = [sum(d * d for d in row) for row in (x.astype(object) * n - sums).tolist()]
    return [d if d < 2**63 else None for d in whole]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """``(lengths, rotations)``: ``r @ rotations`` has orthogonal columns of falling length.

    Pairs of columns are rotated in rounds of a tournament, so that the pairs
    of a round are disjoint and turn together; sweeps end when a whole one
    finds every pair orthogonal.
    """
    d = r.shape[1]
    a, v = r.astype(float).copy(), np.eye(d)
    orthogonal = 2 * np.sqrt(d) * np.finfo(float).eps  # what rounding leaves of the product of two columns, beside their lengths
    seats = list(range(d)) + ([-1] if d % 2 else [])
    half = len(seats) // 2
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], reversed(seats[half:]), strict=True) if p >= 0 and q >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            i, j = map(np.array, zip(*pairs, strict=True))
            x, y = a[:, i], a[:, j]
            alpha, beta, gamma = np.einsum("ij,ij->j", x, x), np.einsum("ij,ij->j", y, y), np.einsum("ij,ij->j", x, y)
            far = np.abs(gamma) > orthogonal * np.sqrt(alpha * beta)
            swap = alpha < beta  # the longer column comes first, which makes the lengths fall
            if not (far | swap).any():
                continue
            turned |= bool(far.any())
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=far)
            t = np.where(far, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, i], m[:, j]
                first, second = c * x - s * y, s * x + c * y
                m[:, i], m[:, j] = np.where(swap, second, first), np.where(swap, first, second)
        if not turned:
            break
    lengths = np.sqrt(np.einsum("ij,ij->j", a, a))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def _compressed(blocks: Iterator[np.ndarray], d: int) -> np.ndarray:
    """R of all blocks stacked, with at most ``d`` rows."""
    r = np.zeros((0, d))
    for block in blocks:
        r = np.linalg.qr(np.vstack([r, block]), mode="r")
    return r


_FACTOR = "part long, r binary"


def _factor(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})


def _factors_of(values: list[bytes], d: int) -> Iterator[np.ndarray]:
    return (np.frombuffer(v, float).reshape(-1, d) for v in values)


def triangular_factor(x: DataFrame, d: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows; ``x`` has one column of gridded vectors with ``d`` entries.

    Each task hands on one factor; factors are stacked by :data:`FAN_IN` and
    compressed, in rounds, so no task holds more than so many of them.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[np.ndarray]:
            for batch in batches:
                rows = _matrix(batch.column(0), d)
                for at in range(0, len(rows), BLOCK_ROWS):
                    yield centred(rows[at : at + BLOCK_ROWS], n, sums)

        r = _compressed(blocks(), d)
        if len(r):
            yield _factor(TaskContext.get().partitionId(), r)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_factor(key[0].as_py(), _compressed(_factors_of(table.column("r").to_pylist(), d), d))])

    factors = stored(x.mapInArrow(first, _FACTOR), "factors")
    last = factors.agg(F.max("part")).first()[0] or 0
    while last:
        factors = factors.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(merged, _FACTOR)
        last //= FAN_IN
    return _compressed(_factors_of([r["r"] for r in factors.select("r").collect()], d), d)  # one factor of d times d


def _totals(x: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """How many vectors there are, and their sums by entry as whole numbers of any size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            rows = _matrix(batch.column(0), d)
            safe = float(np.abs(rows.astype(float)).max(initial=0)) * max(len(rows), 1) < _LONG / 4
            n, total = n + len(rows), total + (rows if safe else rows.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n] * d, pa.int64()), "at": pa.array(range(d), pa.int32()), "s": pa.array(map(Decimal, total.tolist()), pa.decimal128(38, 0))})

    found = x.mapInArrow(add, "n long, at int, s decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    sums = np.zeros(d, object)
    for r in found:
        sums[r["at"]] = int(r["s"])
    return (found[0]["n"] if found else 0), sums


def fit_whitening(x: DataFrame, d: int, components: int | None = None) -> Whitening:
    """Fits the whitening of the rows of ``x``, one column of gridded vectors with ``d`` entries.

    Components without deviation beyond rounding are left out, so there are
    fewer than asked for where the rows span fewer dimensions.
    """
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors have at most {MOST_DIMENSIONS} entries here")
    n, sums = _totals(x, d)
    if not n:
        return Whitening(0, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    lengths, rotations = jacobi(triangular_factor(x, d, n, sums))
    real = int((lengths > lengths[0] * max(d, 16) * 10 * np.finfo(float).eps).sum()) if lengths[0] > 0 else 0
    k = min(real, components if components is not None else d)
    return Whitening(n, sums, rotations[:, :k], lengths[:k] / np.sqrt(n), float((lengths**2).sum()) / n)


def identity_error(x: DataFrame, model: Whitening) -> float:
    """The largest entry by which the whitened rows' covariance differs from the identity, one covariance for each pair of components."""
    k = len(model.deviations)
    if not k:
        return 0.0

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = model.apply(_matrix(batch.column(0), model.components.shape[0]))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i].copy()) for i in range(k)], [f"w{i}" for i in range(k)])

    rows = x.mapInArrow(each, ", ".join(f"w{i} double" for i in range(k)))
    found = rows.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1))).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i + 1))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """``(<id>, component, n, deviation, whitened, explained, identity_error)``: each row on each component.

    Rows whose vector is null or holds null or non-finite entries are dropped.
    The others are put on the grid; the fit takes each distinct gridded vector
    once, the result has every row, repeated ids and vectors included.
    ``n`` is the number of distinct vectors, ``deviation`` n squared times the
    squared distance from their mean, exact, null where it exceeds a long;
    ``whitened`` the row's place on the component in standard deviations, whose
    sign is arbitrary but the same for all rows; ``explained`` the component's
    share in all variance.  Where fewer components have any variance, there
    are fewer rows; none for an empty table, or when all vectors are equal.  Vectors of another
    length than the commonest, or the longer of two as common, are dropped as
    well, empty ones always.  Other columns are dropped.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), gridded(F.col(vector_col), scale).alias("x")).where(F.size("x") > 0)
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    d = common["d"] if common else 1
    rows = rows.where(F.size("x") == d)
    distinct = stored(rows.select("x").distinct(), "vectors")
    model = fit_whitening(distinct, d, components)
    error, k = identity_error(distinct, model), len(model.deviations)
    explained = model.explained

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(at, BLOCK_ROWS)
                x, m = _matrix(own.column(1), d), own.num_rows
                away = pa.array(squared_distances(x, model.n, model.sums), pa.int64())
                by_row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_pydict({
                    "id": own.column(0).take(by_row),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, model.n)),
                    "deviation": away.take(by_row),
                    "whitened": pa.array(model.apply(x).ravel()),
                    "explained": pa.array(np.tile(explained, m)),
                    "identity_error": pa.array(np.full(m * k, error)),
                })

    return rows.mapInArrow(each, f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
