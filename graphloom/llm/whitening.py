"""Whitening of embeddings by two passes over integers.

Entries become integers, so the sums of the first pass are exact and the mean is a fraction n*mean = S without
rounding. The second pass centres each entry (n*x - S, again an integer, over n) before it is
multiplied: a task adds up the outer products of its rows as one matrix product for each batch, and the matrices of all tasks are merged by
``treeAggregate``. LAPACK takes the symmetric matrix apart; its largest components go to all tasks, which project their
rows. A third pass of the same kind measures how far the covariance of the projections is from the identity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LONG = 1 << 63


@dataclass
class Fit:
    """n, exact sums, eigenvalues (falling), one unit eigenvector a column, trace of the covariance, distance from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


def _sound() -> Column:
    """The vector is there, and all its entries are finite and, scaled, within a long."""
    most = float(LONG - 2 * SHIFT) / SCALE
    return F.coalesce(F.forall(F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < most)), F.lit(False))


def _rows(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(_sound())
    return rows if dim is None else rows.where(F.size("x") == dim)


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dim) + SHIFT


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exactly: 64-bit integers where they suffice, Python's otherwise."""
    if x.size and n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) < LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_offsets(x, n, sums) / n).astype(np.float64)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of squares of n*x - S; null beyond a long."""
    d = _offsets(x, n, sums)
    if d.dtype != object and (not d.size or int(np.abs(d).max()) ** 2 * d.shape[1] < LONG):
        return (d * d).sum(1).tolist()
    exact = (d.astype(object) ** 2).sum(1)
    return [v if v < LONG else None for v in exact.tolist()]


def _merged(rows: DataFrame, partial, size: int) -> np.ndarray:
    """Sum over all tasks of ``partial(column) -> array``, kept as bytes of doubles, merged along a tree."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = rows.select("x").mapInArrow(run, "part binary").rdd
    return parts.treeAggregate(np.zeros(size), lambda t, r: t + np.frombuffer(bytes(r.part)), lambda a, b: a + b)


def _integer_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension. Tasks add the upper and lower halves of the integers apart, so nothing overflows."""

    def run(batches):
        n, sums = 0, np.zeros(dim, object)
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch.column(0), dim)
                n += len(x)
                sums = sums + (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], names=["n", "sums"])

    parts = rows.select("x").mapInArrow(run, "n long, sums array<string>").rdd
    n, sums = parts.treeAggregate((0, [0] * dim), lambda t, r: (t[0] + r.n, [s + int(v) for s, v in zip(t[1], r.sums)]), lambda a, b: (a[0] + b[0], [s + v for s, v in zip(a[1], b[1])]))
    return n, sums


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The largest ``components`` of the covariance of ``embedding``, those without any variance left out; None without vectors.

    Vectors of the most frequent length are fitted (the longest on ties).
    """
    lengths = _rows(vectors).groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).where("dim > 0")
    first = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if first is None:
        return None
    dim = first.dim
    rows = _rows(vectors, dim)
    n, sums = _integer_sums(rows, dim)

    def products(column):
        c = _centred(_integers(column, dim), n, sums)
        return (c.T @ c).ravel()

    covariance = _merged(rows, products, dim * dim).reshape(dim, dim) / n
    values, basis = np.linalg.eigh((covariance + covariance.T) / 2)
    values, basis = values[::-1], basis[:, ::-1]
    some = min(components, int((values > dim * np.finfo(float).eps * max(values[0], 0.0)).sum()))
    out = Fit(n, sums, values[:some].copy(), basis[:, :some].copy(), float(np.trace(covariance)))
    if some:
        step = out.vectors / np.sqrt(out.values)

        def projected(column):
            w = _centred(_integers(column, dim), n, sums) @ step
            return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

        total = _merged(rows, projected, some * some + some) / n
        second, mean = total[: some * some].reshape(some, some), total[some * some :]
        out.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(some)).max())
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose ``embedding`` is null, or holds null, NaN, infinite or too large entries (64 times the entry must fit a
    long), are left out, and so are vectors of another length than the most frequent one. A null vec_id is kept, repeated rows are
    rows of their own, other columns are ignored. ``deviation`` is null where it passes a long. Components without variance have no
    rows; so a table without vectors, or with equal ones only, gives an empty table.
    """
    spark = vectors.sparkSession
    found = fit(vectors, components)
    kind = vectors.schema["vec_id"].dataType
    fields = [("vec_id", kind), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    if found is None or not len(found.values):
        return spark.createDataFrame([], schema)
    dim, some = found.vectors.shape
    shared = spark.sparkContext.broadcast(found)  # dim x components doubles

    def run(batches):
        f = shared.value
        step, explained = f.vectors / np.sqrt(f.values), f.values / f.trace
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                x, rows = _integers(part.column(1), dim), part.num_rows
                each = pa.array(np.repeat(np.arange(rows), some))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each), pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), rows)), pa.array(np.full(rows * some, f.n, np.int64)),
                        pa.array(_deviations(x, f.n, f.sums), pa.int64()).take(each), pa.array((_centred(x, f.n, f.sums) @ step).ravel()),
                        pa.array(np.tile(explained, rows)), pa.array(np.full(rows * some, f.identity_error)),
                    ],
                    names=schema.names,
                )

    return _rows(vectors, dim).mapInArrow(run, schema)
