"""Sufficient statistics in one pass: count, means, co-moments.

Narrow matrices (at most ``NARROW`` columns) use Catalyst aggregates; wider
ones accumulate centred co-moments per partition with numpy and merge them
pairwise (Chan's update), so no uncentred sums cancel.  What reaches the driver
is k + k^2 numbers for each of at most ``FAN`` merged parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NARROW = 12
FAN = 32
WIDE = 2000


@dataclass(frozen=True)
class Gram:
    """n, mean (k), comoment (k x k, sum of centred products)."""

    n: int
    mean: np.ndarray
    comoment: np.ndarray

    @property
    def cov(self) -> np.ndarray:
        return self.comoment / (self.n - 1)

    @property
    def raw(self) -> np.ndarray:
        """Uncentred sum of products."""
        return self.comoment + self.n * np.outer(self.mean, self.mean)

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    @property
    def corr(self) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.cov / np.outer(self.std, self.std)


def width(m: DataFrame) -> int:
    first = m.select(F.size("features")).first()
    if first is None:
        raise ValueError("an empty matrix has no width")
    return first[0]


def _merge(a, b):
    (na, ma, ca), (nb, mb, cb) = a, b
    if not na:
        return b
    if not nb:
        return a
    n, d = na + nb, mb - ma
    return n, ma + d * (nb / n), ca + cb + np.outer(d, d) * (na * nb / n)


def _moments(x: np.ndarray):
    if not len(x):
        k = x.shape[1] if x.ndim == 2 else 0
        return 0, np.zeros(k), np.zeros((k, k))
    mean = x.mean(0)
    c = x - mean
    return len(x), mean, c.T @ c


def as_block(column: pa.Array) -> np.ndarray:
    """List column of one Arrow batch as a 2-d array; rows must agree in length."""
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, float).reshape(n, -1)


def gram(m: DataFrame, k: int | None = None, backend: str | None = None) -> Gram:
    """Statistics of a row matrix (``features``)."""
    k = k or width(m)
    if k > WIDE:
        raise ValueError(f"{k} columns: use a randomized decomposition instead of a {k} x {k} matrix")
    if (backend or ("sql" if k <= NARROW else "arrow")) == "sql":
        x = [F.col("features")[j] for j in range(k)]
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        row = m.agg(
            F.count("*").alias("n"), *(F.avg(x[j]).alias(f"m{j}") for j in range(k)), *(F.covar_pop(x[a], x[b]).alias(f"c{a}_{b}") for a, b in pairs)
        ).first()
        c = np.zeros((k, k))
        for a, b in pairs:
            c[a, b] = c[b, a] = (row[f"c{a}_{b}"] or 0.0) * row["n"]
        return Gram(row["n"], np.array([row[f"m{j}"] or 0.0 for j in range(k)]), c)

    def partial(batches):
        acc = (0, np.zeros(k), np.zeros((k, k)))
        for b in batches:
            acc = _merge(acc, _moments(as_block(b.column(0)))) if b.num_rows else acc
        if acc[0]:
            from pyspark import TaskContext

            flat = np.concatenate([[acc[0]], acc[1], acc[2].ravel()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % FAN], pa.int32()), pa.array([flat], pa.list_(pa.float64()))], ["part", "s"]
            )

    def unpack(v):
        v = np.asarray(v, float)
        return int(v[0]), v[1 : 1 + k], v[1 + k :].reshape(k, k)

    def merged(batches):
        held = {}
        for b in batches:
            for p, v in zip(b.column(0).to_pylist(), b.column(1)):
                acc = unpack(v.values.to_numpy(zero_copy_only=False))
                held[p] = _merge(held[p], acc) if p in held else acc
        for p, (n, mean, c) in sorted(held.items()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), pa.array([np.concatenate([[n], mean, c.ravel()])], pa.list_(pa.float64()))], ["part", "s"]
            )

    schema = "part int, s array<double>"
    parts = m.select("features").mapInArrow(partial, schema).repartition(FAN, "part").mapInArrow(merged, schema)
    acc = (0, np.zeros(k), np.zeros((k, k)))
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        acc = _merge(acc, unpack(r["s"]))
    return Gram(*acc)
