"""Whitening of embeddings: centred covariance over distinct vectors, its leading components, and
all vectors projected on them.

Entries become integers, so equal vectors are equal exactly and their sums are exact. Each partition
adds up its counts and sums, then its centred products; partial sums are added by Spark. The
covariance, one row per dimension, is small: it is reduced to a tridiagonal matrix by Householder
reflections, the leading eigenvalues come from bisection on Sturm counts, their vectors from inverse
iteration, made orthogonal within clusters of close eigenvalues. The components are broadcast, and
every vector is projected where it lies.

Defined results: rows whose vector is null, holds null or non-finite entries, or entries whose
integer would not be exact (2^52 and beyond), are dropped; so are rows whose vector has another
length than most (the longer one, if two are as frequent; an empty vector counts as null). Repeated
rows are kept and count once for the fit. There are as many components as dimensions if those are
fewer than asked for. A component without variance (below 1e-12 of the largest) has null whitened
values and counts for nothing in identity_error, which is null if no component has variance;
deviation is null beyond 64 bits. Other columns are carried along, those named like an added one are
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

SCALE, SHIFT = 64, 1_000_000
#: A covariance has the square of so many entries at most; it is read by the driver.
MAX_DIMENSIONS = 2_048
FLAT = 1e-12

# ---- eigenvectors of a symmetric matrix ------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit Householder vectors of a symmetric matrix."""
    a, n = np.array(matrix, dtype=np.float64), len(matrix)
    reflectors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        v[0] += np.copysign(size, v[0])
        length = np.linalg.norm(v)
        v = v / length if length > 0 else v
        reflectors.append(v)
        part = a[k + 1 :, k + 1 :]
        p = 2 * (part @ v)
        w = p - (p @ v) * v
        part -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
    return np.diag(a).copy(), np.array([a[k + 1, k] for k in range(n - 1)]), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """For each shift, how many eigenvalues are below it (negative pivots of the Sturm sequence)."""
    tiny = np.finfo(float).tiny * 4 + np.finfo(float).eps * np.finfo(float).tiny
    counts = np.zeros(len(shifts), dtype=np.int64)
    q = np.ones(len(shifts))
    squares = np.concatenate([[0.0], off * off])
    with np.errstate(over="ignore"):
        for d, e2 in zip(diagonal, squares):
            q = d - shifts - e2 / q
            q = np.where(np.abs(q) < tiny, -tiny, q)
            counts += q < 0
    return counts


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, greatest first, all bisected at once to the last bit."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    span = max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - 1e-12 * span, high + 1e-12 * span
    rank = n - 1 - np.arange(k)  # so many are below it
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return low
        less = below(diagonal, off, middle) > rank
        low, high = np.where(less, low, middle), np.where(less, middle, high)


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solves (T - shift) x = right by elimination with row exchange; pivots are at least `least`."""
    n = len(diagonal)
    d, up, up2, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), right.copy()
    for k in range(n - 1):
        low = off[k]
        if abs(low) > abs(d[k]):
            ratio = d[k] / low
            d[k], up[k], d[k + 1], up2[k] = low, d[k + 1], up[k] - ratio * d[k + 1], up[k + 1]
            up[k + 1] = -ratio * up2[k]
            x[k], x[k + 1] = x[k + 1], x[k] - ratio * x[k + 1]
        else:
            if abs(d[k]) < least:
                d[k] = least
            ratio = low / d[k]
            d[k + 1] -= ratio * up[k]
            x[k + 1] -= ratio * x[k]
    if abs(d[-1]) < least:
        d[-1] = least
    for k in range(n - 1, -1, -1):
        x[k] = (x[k] - (up[k] * x[k + 1] if k + 1 < n else 0) - (up2[k] * x[k + 2] if k + 2 < n else 0)) / d[k]
    return x


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as rows; those of close eigenvalues are made orthogonal in every step."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0), np.finfo(float).tiny)
    eps = np.finfo(float).eps * norm
    rng, found, head = np.random.default_rng(7), [], 0
    shift = np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            head = k
        shift = value if k == head else min(value, shift - 8 * eps)  # equal shifts give equal vectors
        x = rng.standard_normal(n)
        for _ in range(5):
            for _ in range(2):
                for other in found[head:]:
                    x -= (other @ x) * other
            x /= np.linalg.norm(x)
            x = solved(diagonal, off, shift, x, eps)
            x /= np.abs(x).max()
        for _ in range(2):
            for other in found[head:]:
                x -= (other @ x) * other
        found.append(x / np.linalg.norm(x))
    return np.array(found).reshape(len(values), n)


def eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix and their unit eigenvectors as rows."""
    scale = np.abs(matrix).max()
    if not scale > 0:
        return np.zeros(k), np.eye(len(matrix))[:k]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading(diagonal, off, k)
    rows = vectors(diagonal, off, values)
    for at in range(len(reflectors) - 1, -1, -1):
        v = reflectors[at]
        rows[:, at + 1 :] -= 2 * np.outer(rows[:, at + 1 :] @ v, v)
    return values * scale, rows / np.linalg.norm(rows, axis=1, keepdims=True)


# ---- on Spark --------------------------------------------------------------------------------


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n: whole numbers first, so that no digits are lost to the size of the entries."""
    whole = np.array([int(s) // n for s in sums], dtype=np.int64)
    rest = np.array([int(s) % n / n for s in sums])
    return (x - whole) - rest


@dataclass(frozen=True)
class Whitening:
    """n fit vectors with sums per dimension; components as rows, their eigenvalues, the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    @property
    def scaled(self) -> np.ndarray:
        """Components over the roots of their eigenvalues; nan where there is no variance."""
        least = FLAT * max(self.eigenvalues.max(initial=0), 0)
        roots = np.sqrt(np.where(self.eigenvalues > least, self.eigenvalues, np.nan))
        return self.components / roots[:, None]


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of every entry c, computed as double; null if the vector can't be used."""
    entry = F.transform(vector, lambda c: c.cast("double") * SCALE)
    # a comparison with nan is false for abs(nan) < x in SQL, where nan is the greatest
    usable = F.forall(entry, lambda c: F.coalesce(F.abs(c) < float(1 << 52), F.lit(False)))
    return F.when(usable & (F.size(vector) > 0), F.transform(entry, lambda c: F.floor(c).cast("long") + SHIFT))


def _matrix(batch: pa.RecordBatch, at: int, width: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch, 0, width)
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(width, dtype=np.int32)), "n": pa.array(np.full(width, n)), "s": pa.array(total)})

    # sums of a partition fit 64 bits, those of all may not
    added = fit.mapInArrow(run, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = added.orderBy("i").collect()  # one row per dimension
    return rows[0]["n"], np.array([int(r["s"]) for r in rows], dtype=object)


def _products(fit: DataFrame, width: int, n: int, sums: np.ndarray, projection: np.ndarray | None = None) -> np.ndarray:
    """The covariance of centred vectors, or of their projections, with divisor n."""
    size = width if projection is None else len(projection)
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = centred(_matrix(batch, 0, width), n, sums)
            y = y if projection is None else y @ projection.T
            total += y.T @ y
        values = [pa.array(u.astype(np.int32)) for u in upper]
        yield pa.RecordBatch.from_arrays([*values, pa.array(total[upper])], names=["i", "j", "v"])

    rows = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((size, size))
    out[rows["i"], rows["j"]] = out[rows["j"], rows["i"]] = rows["v"] / n
    return out


def common_length(numbers: DataFrame) -> int:
    """The length that most vectors have."""
    sizes = numbers.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return sizes["size"] if sizes else 0


def fit(distinct: DataFrame, width: int, k: int) -> Whitening:
    """Sums, covariance and components of the distinct vectors in column x."""
    if width > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {width} dimensions: at most {MAX_DIMENSIONS} are supported")
    n, sums = _sums(distinct, width)
    covariance = _products(distinct, width, n, sums)
    values, components = eigen(covariance, min(k, width))
    return Whitening(n, sums, components, values, float(np.trace(covariance)))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums of (n x - S)^2, exact; None beyond 64 bits."""
    top = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums.tolist()), default=0)
    if top < 1 << 62:
        d = x * np.int64(n) - sums.astype(np.int64)
        peak = int(np.abs(d).max(initial=0))
        if peak * peak * max(d.shape[1], 1) < 1 << 63:
            return (d * d).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - sums) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


ADDED = ("component", "n", "deviation", "whitened", "explained", "identity_error")
_SCHEMA = [T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]


def whiten(df: DataFrame, vector_col: str = "embedding", k: int = 16) -> DataFrame:
    """A row for each vector and each of its k leading components: component (from 1), n,
    deviation, whitened, explained and identity_error, besides df's other columns."""
    df = df.drop(*[c for c in ADDED if c != vector_col])
    others = [f for f in df.schema.fields if f.name != vector_col]
    named = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(others)], whole_numbers(F.col(f"`{vector_col}`")).alias("x"))
    numbers = saved(named.filter(F.col("x").isNotNull()), "whole_numbers")
    schema = T.StructType([*others, *(T.StructField(c, t) for c, t in zip(ADDED, _SCHEMA))])
    width = common_length(numbers)
    if not width:
        return df.sparkSession.createDataFrame([], schema)
    numbers = numbers.filter(F.size("x") == width)
    distinct = saved(numbers.select("x").distinct(), "distinct")
    model = fit(distinct, width, k)
    live = np.flatnonzero(~np.isnan(model.scaled[:, 0]))
    error = None
    if len(live):
        error = float(np.abs(_products(distinct, width, model.n, model.sums, model.scaled[live]) - np.eye(len(live))).max())
    sent = df.sparkSession.sparkContext.broadcast(model)  # k rows of one number per dimension
    at = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scaled, count = model.scaled, len(model.components)
        share = model.eigenvalues / model.trace if model.trace > 0 else np.zeros(count)
        for batch in batches:
            x = _matrix(batch, at, width)
            rows = len(x)
            whitened = (model.centred(x) @ scaled.T).reshape(-1)
            again = pa.array(np.repeat(np.arange(rows), count))
            added = [
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * count, model.n)),
                pa.array(deviations(x, model.n, model.sums), pa.int64()).take(again),
                pa.array(whitened, mask=np.isnan(whitened)),
                pa.array(np.tile(share, rows)),
                pa.array([error] * (rows * count), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(again) for c in range(at)), *added], names=schema.names)

    return numbers.mapInArrow(run, schema)
