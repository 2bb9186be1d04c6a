"""Whitening of vectors, with a covariance from sums of squares alone."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits of the lower part that a centred value is split into, and rows whose squares are summed at once: with values below 2**53, no sum leaves 64 bits.
LOW, ROWS = 26, 128
#: A component whose variance is below this part of the largest one has none.
RANK = 1e-12


class Whitening(NamedTuple):
    """What a fit gives: distinct vectors, sums by dimension, variances (falling) and unit components (columns) of the first ones, and the sum of all variances."""

    n: int
    sums: tuple[int, ...]
    variances: np.ndarray
    components: np.ndarray
    trace: float


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """A batch of lists as rows of 64-bit numbers, short ones padded with zeros."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims), "i8")
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exactly: in Python's numbers where 64 bits might not hold its square's parts."""
    most = max(int(np.abs(x).max(initial=0)) * n, max((abs(s) for s in sums), default=0))
    if most < 1 << 51:  # a sum of two centred values stays below 2**53
        return x * n - np.array(sums, "i8")
    return x.astype(object) * n - np.array(sums, object)


def square_parts(z: np.ndarray) -> list[int]:
    """The sums of high * high, high * low and low * low of each column's values high * 2**LOW + low. The squares' sum is their combination; see joined."""
    high = z >> LOW
    low = z - (high << LOW)
    return np.stack([(high * high).sum(0), (high * low).sum(0), (low * low).sum(0)], 1)


def joined(hh: int, hl: int, ll: int) -> int:
    return (hh << 2 * LOW) + (hl << LOW + 1) + ll


def fit(vectors: DataFrame, most: int | None = None) -> tuple[Whitening | None, DataFrame]:
    """The components of vectors (v: whole numbers), and the distinct vectors that they come from, as a written table; None without vectors.

    Two aggregations: the sums of each dimension, then the sums of the squares of the centred values n * v - sums, for each
    dimension and for each sum of two dimensions. By polarisation, cov(a, b) = (var(a + b) - var(a) - var(b)) / 2, so these
    sums hold every covariance. All sums are exact. A task adds up dims * (dims + 1) / 2 sums, whatever it has read; these sums, summed over the tasks, come to
    the driver, which solves the dims x dims problem. most: the components kept (all, if None).
    """
    distinct = written(vectors.select("v").filter("v IS NOT NULL").distinct(), "whitening-fit")
    n, dims = distinct.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not dims:
        return None, distinct

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [0] * dims
        for batch in batches:
            x = matrix(batch.column(0), dims)
            x = x if int(np.abs(x).max(initial=0)) * max(1, len(x)) < 1 << 62 else x.astype(object)
            out = [a + int(b) for a, b in zip(out, x.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([Decimal(s) for s in out], pa.decimal128(38, 0))], ["d", "s"])

    found = distinct.mapInArrow(totals, "d int, s decimal(38,0)").groupBy("d").agg(F.sum("s").alias("s")).collect()
    sums = tuple(int(s) for _, s in sorted((r["d"], r["s"]) for r in found))
    first, second = np.triu_indices(dims, 1)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((dims + len(first), 3), object)
        for batch in batches:
            z = centred(matrix(batch.column(0), dims), n, sums)
            for at in range(0, len(z), ROWS):
                part = z[at : at + ROWS]
                out[:dims] += square_parts(part)
                for lo in range(0, len(first), 8192):  # a bounded piece of the pairs at a time
                    pairs = slice(lo, lo + 8192)
                    out[dims + lo : dims + lo + 8192] += square_parts(part[:, first[pairs]] + part[:, second[pairs]])
        cells = [pa.array([Decimal(int(v)) for v in out[:, k]], pa.decimal128(38, 0)) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), *cells], ["k", "hh", "hl", "ll"])

    parts = distinct.mapInArrow(squares, "k int, hh decimal(38,0), hl decimal(38,0), ll decimal(38,0)").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("hh", "hl", "ll")])
    squared = {r["k"]: joined(int(r["hh"]), int(r["hl"]), int(r["ll"])) for r in parts.collect()}
    cov, scale = np.zeros((dims, dims)), n**3
    for d in range(dims):
        cov[d, d] = squared[d] / scale
    for k, (a, b) in enumerate(zip(first, second, strict=True)):
        cov[a, b] = cov[b, a] = (squared[dims + k] - squared[a] - squared[b]) / (2 * scale)
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e, kind="stable")[:most]
    return Whitening(n, sums, np.maximum(e[order], 0.0), np.ascontiguousarray(v[:, order]), sum(squared[d] for d in range(dims)) / scale), distinct


def varying(model: Whitening) -> np.ndarray:
    """Which of the model's components have a variance."""
    return model.variances > RANK * max(float(model.variances[0]), 1e-300)


def whitened(z: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows of exactly centred numbers (n * x - sums) on the model's components; those without variance aren't scaled."""
    return (z / model.n).astype("f8") @ (model.components / np.sqrt(np.where(varying(model), model.variances, 1.0)))


def project(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vectors (vec_id, v) with, for each component of the model: its number from 1, the deviation sum((n * v - sums)^2), the whitened value, and the part of the trace explained.

    A component without variance has no whitened value, and without any variance nothing is explained: both null.
    """
    dims, some, live = len(model.sums), len(model.variances), varying(model)
    explained = [float(x) / model.trace if model.trace > 0 else None for x in model.variances]
    schema = "vec_id long, component int, deviation decimal(38,0), whitened double, explained double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            z = centred(x, model.n, model.sums)
            wide = z if z.dtype == object or int(np.abs(z).max(initial=0)) ** 2 * dims < 1 << 63 else z.astype(object)
            away = pa.array([Decimal(int(d)) for d in (wide * wide).sum(1)], pa.decimal128(38, 0))
            rows = pa.array(np.repeat(np.arange(len(x)), some))
            values = pa.array(whitened(z, model).ravel(), pa.float64(), mask=~np.tile(live, len(x)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.tile(np.arange(1, some + 1), len(x)), pa.int32()), away.take(rows), values, pa.array(explained * len(x), pa.float64())], ["vec_id", "component", "deviation", "whitened", "explained"])

    return vectors.select(F.col("vec_id").cast("long"), "v").mapInArrow(run, schema)


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit vectors' covariance minus the identity, measured on these vectors; None if no component varies."""
    live, dims = np.flatnonzero(varying(model)), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(whitened(centred(matrix(batch.column(0), dims), model.n, model.sums), model)), pa.list_(pa.float64()))], ["w"])

    pairs = [(int(a), int(b)) for a in live for b in live if a <= b]
    if not pairs:
        return None
    row = distinct.mapInArrow(run, "w array<double>").agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]) for a, b in pairs]).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(row, pairs, strict=True))


def whiten(vectors: DataFrame, *, components: int | None = 4) -> DataFrame:
    """Vectors (vec_id, v: arrays of whole numbers) whitened by the first principal components of their distinct values.

    Gives vec_id, component (from 1, by falling variance), n (distinct vectors), deviation (sum over dimensions of (n * v - sum)^2, exact), whitened (the
    centred vector on the component, over its standard deviation), explained (the component's part of all variance) and identity_error (one
    value: how far the covariance of the whitened vectors is from the identity at most; see there).

    A null vector takes no part, a null in vec_id stays null; repeated rows are fitted once and all come back; short vectors count
    as padded with zeros. Where vectors don't vary (one vector, or fewer directions than components), whitened is null for such a component. No vectors give no rows.
    Other columns are ignored. deviation is exact up to 38 digits.
    """
    vectors = vectors.filter("v IS NOT NULL").select("vec_id", "v")
    model, distinct = fit(vectors, components)
    if model is None:
        empty = "n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], f"vec_id long, component int, {empty}")
    error = identity_error(distinct, model)
    out = project(vectors, model)
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
