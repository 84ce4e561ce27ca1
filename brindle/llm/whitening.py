"""Whitening of embeddings by their leading principal components, without ever forming the covariance.

Entries become integers, floor(256 c). The fit list holds each distinct integer vector once, so that a group of copies counts
as one; it is found by a shuffle with map-side reduction and written to the shared folder. Each Spark pass computes V Q for a
block Q of directions as X'(XQ) on centred rows: tasks add up a matrix of dimension times block, rows of these matrices are
summed by dimension, and only one such matrix comes to the driver, whatever the number of rows or tasks.

On the driver, blocks iterate towards the leading eigenvectors. The spectrum of embeddings is flat, and a block that is only
multiplied and orthogonalised gains a few per cent a pass. So the Rayleigh-Ritz step takes the span of all blocks since the
last restart, with their products at hand, and the next block is the QR of the leading Ritz vectors' residuals. When the
residuals of all k components are below `tolerance` times the largest eigenvalue, one more pass over the components alone
measures them anew; only that certifies them.

Results: per row and component, the whitened value, (x - S/n) projected on the component over the root of its eigenvalue;
deviation, the exact integer sum of (n x - S)^2, null where it exceeds 64 bits; the component's share of the total variance;
and the largest error of the whitened fit list's covariance against the identity.

Nulls: rows whose vector is null, empty, or holds null or non-finite entries are dropped; a null id stays null. Vectors of
another length than the most frequent one (the longest of several) are dropped too. Entries of over 2^31 / 256 are cut to that.
Directions with less than 1e-10 of the variance have no component, so a table of n distinct vectors gives n - 1 at most and
one of a single distinct vector no rows. Equal eigenvalues have any orthogonal vectors of theirs, the same for all rows. Repeated
rows are rows of their own. An empty table gives no row. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, small_batches, stored

SCALE = 256
COMPONENTS = 4
#: Directions of a pass, and directions kept from one restart to the next pass.
BLOCK = 16
SPACE = 160
#: Largest residual over the largest eigenvalue.
TOLERANCE = 1e-12
PASSES = 500
#: A smaller share of the variance is no component.
LEAST_SHARE = 1e-10
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Model(NamedTuple):
    """n and sums of the fit list, unit components as columns, their eigenvalues and shares, residuals over the largest
    eigenvalue, the error of the whitened covariance, and the number of Spark passes over the fit list."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    residuals: np.ndarray
    identity_error: float
    passes: int


def _whole(vector: Column) -> Column:
    """The integer vector."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(2.0**31 - 1)), F.lit(-(2.0**31)))).cast("int"))


def integers(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and x of the rows that remain."""
    v = F.col("__v")
    found = rows.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("__v"))
    found = found.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))
    longest = found.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found.where(F.size(v) == (longest.d if longest else 0)).select("key", _whole(v).alias("x"))


def fit_list(found: DataFrame) -> DataFrame:
    """Each distinct vector once, stored."""
    return stored(found.select("x").distinct(), "whitening-fit")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _summed(fit: DataFrame, function: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all batches of a matrix that a function makes of a batch; summed by row, so that one matrix comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch.column(0)):
                part = function(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["at", "v"])

    width = function(np.zeros((1, len(fit.first().x)), np.int32)).shape[1]
    sums = fit.mapInArrow(run, f"at int, v array<{kind}>").groupBy("at").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(width))).alias("v"))
    return np.array([r.v for r in sorted(sums.collect(), key=lambda r: r.at)])


def leading(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, space: int = SPACE, tolerance: float = TOLERANCE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k leading eigenvectors of a symmetric positive operator, their eigenvalues and residuals (relative)."""
    rng = np.random.default_rng(11)
    block, k = min(block, d), min(k, d)
    block = max(block, k)
    basis, image = np.empty((d, 0)), np.empty((d, 0))
    q = np.linalg.qr(rng.normal(size=(d, block)))[0]
    for _ in range(passes):
        basis, image = np.hstack([basis, q]), np.hstack([image, multiply(q)])
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn, image @ turn
        rest = moved - ritz * values
        if values[0] <= 0:
            return np.empty((d, 0)), np.empty(0), np.empty(0)
        if (np.linalg.norm(rest[:, :k], axis=0) <= tolerance * values[0]).all():
            top = np.linalg.qr(ritz[:, :k])[0]
            product = multiply(top)
            inner = top.T @ product
            own, turn = np.linalg.eigh((inner + inner.T) / 2)
            own, turn = own[::-1], turn[:, ::-1]
            top, product = top @ turn, product @ turn
            measured = np.linalg.norm(product - top * own, axis=0) / own[0]
            if (measured <= tolerance).all():
                return top * np.sign(top[np.abs(top).argmax(axis=0), range(k)]), own, measured
        if basis.shape[1] + block > max(space, 3 * block):
            basis, image = ritz[:, : 2 * block], moved[:, : 2 * block]
        if basis.shape[1] >= d:  # the whole space, and still rounding errors: once more from the best directions
            basis, image, q = np.empty((d, 0)), np.empty((d, 0)), np.linalg.qr(ritz[:, :block])[0]
            continue
        far = np.flatnonzero(np.linalg.norm(rest, axis=0) > tolerance / 10 * values[0])[:block]  # those that have converged add nothing
        new = np.hstack([rest[:, far], rng.normal(size=(d, block)) * (1e-8 * values[0])])  # random ones where residuals vanish
        for _ in range(2):
            new -= basis @ (basis.T @ new)
        q, r = np.linalg.qr(new)
        q = q[:, np.flatnonzero(np.abs(np.diag(r)) > 1e-14 * values[0])[: min(block, d - basis.shape[1])]]
        q -= basis @ (basis.T @ q)
        q = np.linalg.qr(q)[0]
    raise ArithmeticError(f"the components aren't certified after {passes} passes")


def fit(found: DataFrame, k: int = COMPONENTS, block: int = BLOCK, space: int = SPACE, tolerance: float = TOLERANCE) -> Model | None:
    """The model of integers(); None where there is no row."""
    small_batches(found.sparkSession)
    distinct = fit_list(found)
    head = distinct.first()
    if head is None:
        drop_stored(distinct)
        return None
    d, count = len(head.x), 0

    def sums_of(x: np.ndarray) -> np.ndarray:
        return np.vstack([np.full(d, len(x), np.int64), x.sum(axis=0, dtype=np.int64)])

    n, sums = _summed(distinct, sums_of, "long").tolist()
    n = n[0]
    mean = np.array(sums, float) / n

    def multiply(q: np.ndarray) -> np.ndarray:
        nonlocal count
        count += 1

        def product(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return _summed(distinct, product) / n

    trace = float(_summed(distinct, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None]).sum()) / n
    vectors, values, residuals = leading(multiply, d, k, block, space, tolerance) if trace > 0 else (np.empty((d, 0)), np.empty(0), np.empty(0))
    real = values > LEAST_SHARE * trace
    vectors, values, residuals, error = vectors[:, real], values[real], residuals[real], 0.0
    if len(values):
        scaled = vectors / np.sqrt(values)
        middle = _summed(distinct, lambda x: ((x - mean) @ scaled).sum(axis=0)[None, :])[0] / n

        def spread(x: np.ndarray) -> np.ndarray:
            w = (x - mean) @ scaled - middle
            return w.T @ w

        error = float(np.abs(_summed(distinct, spread) / n - np.eye(len(values))).max())
    drop_stored(distinct)
    return Model(n, np.array(sums, np.int64), vectors, values, values / trace if trace else values, residuals, error, count)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The exact sum of (n x - S)^2 for each row; in Python's integers where 64 bits may not do."""
    if not len(x):
        return []
    largest = n * int(np.abs(x.astype(np.int64)).max()) + int(np.abs(sums).max())
    if x.shape[1] * largest**2 < 1 << 63:
        return ((n * x.astype(np.int64) - sums) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(found: DataFrame, model: Model | None, key: str = "vec_id") -> DataFrame:
    """One row for each row of integers() and component."""
    k = len(model.values) if model else 0
    names = ("key", "component", "n", "deviation", "whitened", "explained", "identity_error")
    schema = SCHEMA.replace("vec_id", "key")
    if not k:
        return found.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    mean, scaled = model.sums / model.n, model.components / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if m := batch.num_rows:
                x = _matrix(batch.column(1))
                keys = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                exact = pa.array([v for v in deviations(x, model.n, model.sums) for _ in range(k)], pa.int64())
                columns = [keys, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), exact]
                columns += [pa.array(((x - mean) @ scaled).reshape(-1)), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, names=list(names))

    return found.mapInArrow(run, schema).withColumnRenamed("key", key)


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Fit on all rows, whiten all rows."""
    found = integers(rows, key, vector)
    return whiten(found, fit(found, k), key)
