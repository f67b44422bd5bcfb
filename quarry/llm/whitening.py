"""Embedding whitening with covariances by polarisation.

Components become integers ``x = floor(64 * c) + 1000000``.  The fit list holds
each distinct ``x`` vector once.

1. Its size ``n`` and the sums ``S`` of every dimension are exact aggregates.
2. Centred values ``n * x - S`` are integers.  For every dimension, and for the
   sum of every two dimensions, their squares are added up exactly in Spark.
   The variance of a sum of two dimensions less the variances of both is twice
   their covariance, so all covariances follow without any product of two
   columns.  They are put together exactly and rounded once.
3. The eigenvectors of that matrix (dimensions squared, whatever the rows) are
   found on the driver; the largest entry of each is made positive.
4. Every row, copies too, is projected and divided by the root of the
   eigenvalue.  A last aggregate over the fit list measures how far the
   whitened covariance is from the identity.

A vector that is null or empty, or holds null or non-finite components, is left
out; so is one whose ``x`` would not fit a long.  Vectors of each dimension are
a table of their own.  A component without variance (a rank below the
dimension, or a single distinct vector) has ``whitened`` null and ``explained``
0; the identity error is over the other components.  A deviation that fits no
long is null.  Repeated rows and rows without an id are results of their own,
and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from .common import cut

COMPONENTS = 16
SCALE, SHIFT = 64.0, 1_000_000
BASE = 10 ** 15         # of the digits in which exact sums travel
DIGITS = 5
NO_VARIANCE = 1e-11     # of an eigenvalue, relative to the trace: below, rounding decides
ROWS = 4096             # rows that are worked on at a time
_LONG = (1 << 63) - 1

RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pieces(batches, dim: int):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part, _matrix(part.column(0), dim)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, in longs where they surely fit, else in Python's integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    if n * most + max(map(abs, sums)) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def square_sums(d: np.ndarray, axis: int) -> list[int]:
    """Exact sums of squares along an axis."""
    if d.dtype == object:
        return list((d * d).sum(axis=axis))
    most, many = int(np.abs(d).max(initial=0)), d.shape[axis]
    if most * most * many <= _LONG:
        return (d * d).sum(axis=axis).tolist()
    if most < 1 << 46 and many <= 1 << 14:
        high, low = d >> 23, d & ((1 << 23) - 1)
        parts = [(p * q).sum(axis=axis).tolist() for p, q in ((high, high), (high, low), (low, low))]
        return [(a << 46) + (b << 24) + c for a, b, c in zip(*parts)]
    return square_sums(d.astype(object), axis)


def _digits(value: int) -> list[int]:
    sign = -1 if value < 0 else 1
    value, out = abs(value), []
    for _ in range(DIGITS - 1):
        value, digit = divmod(value, BASE)
        out.append(sign * digit)
    return [*out, sign * value]


def _number(digits) -> int:
    return sum(int(d) * BASE ** k for k, d in enumerate(digits))


def _exact_sums(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Parts ``i, j, digits`` to sums by ``i, j``; rows on the driver are as
    many as pairs of dimensions, whatever the table."""
    wide = [F.sum(F.col("digits")[k].cast("decimal(38,0)")).alias(f"d{k}") for k in range(DIGITS)]
    return {(r[0], r[1]): _number(r[2:]) for r in parts.groupBy("i", "j").agg(*wide).collect()}


def _in_parts(df: DataFrame, dim: int, add) -> DataFrame:
    """``add(x, totals)`` puts each piece's sums into a dictionary by ``(i,
    j)``; one set of rows a task."""
    arrow = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("digits", pa.list_(pa.int64()))])

    def run(batches):
        totals: dict = {}
        for _, x in _pieces(batches, dim):
            add(x, totals)
        yield pa.RecordBatch.from_pylist(
            [{"i": i, "j": j, "digits": _digits(v)} for (i, j), v in totals.items()], schema=arrow)

    return df.select("x").mapInArrow(run, "i int, j int, digits array<long>")


def sums(fit: DataFrame, dim: int) -> list[int]:
    def add(x, totals):
        for i, s in enumerate((x >> 31).sum(axis=0).tolist()):
            totals[i, 0] = totals.get((i, 0), 0) + (s << 31)
        for i, s in enumerate((x & ((1 << 31) - 1)).sum(axis=0).tolist()):
            totals[i, 0] += s

    found = _exact_sums(_in_parts(fit, dim, add))
    return [found[i, 0] for i in range(dim)]


def covariance(fit: DataFrame, dim: int, n: int, total: list[int]) -> np.ndarray:
    """Covariance of the fit list: exact squares of dimensions and of sums of
    two, then differences."""
    def add(x, totals):
        d = centred(x, n, total)
        for i in range(dim):
            # (i, i) holds the dimension itself, (i, j) the sum of two
            both = np.concatenate([d[:, i:i + 1], d[:, i:i + 1] + d[:, i + 1:]], axis=1)
            for j, s in enumerate(square_sums(both, 0), i):
                totals[i, j] = totals.get((i, j), 0) + s

    found = _exact_sums(_in_parts(fit, dim, add))
    out = np.empty((dim, dim))
    for (i, j), s in found.items():
        twice = 2 * s if i == j else s - found[i, i] - found[j, j]
        out[i, j] = out[j, i] = twice / (2 * n ** 3)      # of whole numbers: rounded once
    return out


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size (without variance: 0) and eigenvectors as
    columns, up to ``COMPONENTS``."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:COMPONENTS], vectors[:, ::-1][:, :COMPONENTS]
    values = np.where(values > max(np.trace(v), 0.0) * NO_VARIANCE, values, 0.0)
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


def project(d: np.ndarray, n: int, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Whitened rows of centred ones; NaN where there is no variance."""
    x = (d / n).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(values > 0, x @ vectors / np.sqrt(values), np.nan)


def identity_error(fit: DataFrame, dim: int, n: int, total: list[int], values, vectors) -> float | None:
    """Largest absolute entry of the whitened covariance less the identity."""
    kept = np.flatnonzero(values > 0)
    if not len(kept):
        return None

    def moments(centre, product):
        def run(batches):
            acc = 0.0
            for _, x in _pieces(batches, dim):
                w = project(centred(x, n, total), n, values, vectors)[:, kept] - centre
                acc = acc + (w.T @ w if product else w.sum(axis=0)).ravel()
            acc = np.atleast_1d(acc)
            if len(acc) == (len(kept) ** 2 if product else len(kept)):
                yield pa.record_batch({"i": pa.array(np.arange(len(acc)), pa.int32()), "s": pa.array(acc)})
        rows = fit.select("x").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s")).collect()
        return np.array([s for _, s in sorted(tuple(r) for r in rows)]) / n

    mean = moments(np.zeros(len(kept)), False)
    cov = moments(mean, True).reshape(len(kept), len(kept))
    return float(np.abs(cov - np.eye(len(kept))).max())


def _whiten_dimension(rows: DataFrame, dim: int, key: str) -> DataFrame:
    fit = cut(rows.select("x").distinct())
    n = fit.count()
    total = sums(fit, dim)
    v = covariance(fit, dim, n, total)
    values, vectors = components(v)
    error = identity_error(fit, dim, n, total, values, vectors)
    trace = float(np.trace(v))
    explained = values / trace if trace > 0 else np.zeros(len(values))
    many = len(values)
    schema = RESULT.replace("vec_id", f"`{key}`")
    arrow = to_arrow_schema(DataType.fromDDL(schema))

    def run(batches):
        for part, x in _pieces(batches, dim):
            d = centred(x, n, total)
            off = [s if s <= _LONG else None for s in square_sums(d, 1)]
            white = project(d, n, values, vectors).ravel()
            rows_ = len(x)
            ids = part.column(1).take(pa.array(np.repeat(np.arange(rows_), many)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, many + 1), rows_), pa.int32()),
                pa.array(np.full(rows_ * many, n), pa.int64()),
                pa.array([o for o in off for _ in range(many)], pa.int64()),
                pa.array(white, mask=np.isnan(white)),
                pa.array(np.tile(explained, rows_)),
                pa.array([error] * (rows_ * many), pa.float64())], schema=arrow)

    return rows.select("x", "id").mapInArrow(run, schema)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``
    for every sound vector and component."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = (v.isNotNull() & (F.size(v) > 0)
             & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 55))))
    rows = (rows.filter(sound)
            .select("id", F.transform(v, lambda c: F.floor(F.lit(SCALE) * c) + F.lit(SHIFT).cast("long")).alias("x")))
    dims = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())
    out = None
    for dim in dims:
        made = _whiten_dimension(rows if len(dims) == 1 else rows.filter(F.size("x") == dim), dim, key)
        out = made if out is None else out.unionByName(made)
    return vectors.sparkSession.createDataFrame([], RESULT.replace("vec_id", f"`{key}`")) if out is None else out
