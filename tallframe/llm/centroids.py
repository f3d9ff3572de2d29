"""Centroid clustering in exact integer arithmetic.

Vectors become integers once and are stored as blocks.  In each round a block
is compared with all centroids by the expansion |x|^2 - 2 x.c + |c|^2, one
float64 matrix product: as long as every number on the way stays below 2^53,
float64 holds it exactly in any order of summation, so the product equals
integer arithmetic.  Blocks beyond that bound fall back to int64, and beyond
that to Python integers.  Sums and counts of the clusters, a few thousand
numbers, are combined by an RDD ``treeAggregate``.

Only vectors of ``dim`` finite components are kept; others (null, wrong length,
null or non-finite components) aren't returned.  A null id is clustered like
any other but is never a starting centroid.  Repeated rows count and are
returned as often as they occur; of equal ids the smaller vector starts first.
Fewer vectors than ``k`` give fewer centroids, an empty table an empty result.
Distances and inertias beyond a long integer come back as null; all else stays
exact there.  Only id and vector are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SCALE = 256
#: vectors of a block: 1 MB of them at 64 components
BLOCK = 4096
EXACT_FLOAT, EXACT_LONG = 1 << 53, 1 << 63
LONG_MAX = (1 << 63) - 1


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x), as int64 where that holds it, else as Python integers."""
    if not x.size or np.abs(x).max() < 2.0**40:
        return np.floor(x * SCALE).astype(np.int64)
    # from 2^53 on a double is an integer already, and SCALE x may be too large for one
    return np.array([[int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in row] for row in x], object)


def bound_of(x: np.ndarray) -> int:
    """The largest magnitude."""
    return max((abs(int(v)) for v in (x.max(), x.min())), default=0) if x.size else 0


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; the
    smaller number wins a tie.  Exact for any integers."""
    b = max(bound_of(x), bound_of(c))
    # |x|^2 + 2 |x.c| + |c|^2 bounds all terms, partial sums and results
    most = 4 * b * b * max(1, x.shape[1])
    kind = np.float64 if most < EXACT_FLOAT else np.int64 if most < EXACT_LONG else object
    x, c = x.astype(kind), c.astype(kind)
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    at = np.argmin(d, axis=1)
    best = d[np.arange(len(d)), at]
    return at, best if kind is object else best.astype(np.int64)


@dataclass
class Sums:
    """Per cluster: component sums, rows and distances.  int64 while ``bound``
    allows it, Python integers from then on."""

    total: np.ndarray
    rows: np.ndarray
    inertia: np.ndarray
    bound: int = 0

    @staticmethod
    def empty(k: int, dim: int) -> Sums:
        return Sums(np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64))

    def _fit(self, more: int) -> None:
        self.bound += more
        if self.bound >= EXACT_LONG and self.total.dtype != object:
            self.total, self.inertia = self.total.astype(object), self.inertia.astype(object)

    def add(self, x: np.ndarray, at: np.ndarray, d: np.ndarray) -> Sums:
        """Rows of a block, by their clusters."""
        self._fit(len(x) * (bound_of(x) + bound_of(d)))
        order = np.argsort(at, kind="stable")
        seen, first = np.unique(at[order], return_index=True)
        if len(seen):
            self.total[seen] = self.total[seen] + np.add.reduceat(x[order], first, axis=0)
            self.inertia[seen] = self.inertia[seen] + np.add.reduceat(d[order], first)
        self.rows += np.bincount(at, minlength=len(self.rows))
        return self

    def merge(self, other: Sums) -> Sums:
        self._fit(other.bound)
        self.total, self.inertia = self.total + other.total, self.inertia + other.inertia
        self.rows = self.rows + other.rows
        return self

    def means(self, c: np.ndarray) -> np.ndarray:
        """floor(sum / count) of every cluster with rows, the old centroid of the others."""
        out = [[int(s) // int(n) for s in t] if n else [int(v) for v in old] for t, n, old in zip(self.total, self.rows, c)]
        wide = any(abs(v) >= 1 << 62 for r in out for v in r)
        return np.array(out, object if wide else np.int64).reshape(c.shape)


def kept(vectors: DataFrame, key: str, column: str, dim: int) -> DataFrame:
    """(key, x array<double>) of the vectors that count."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(key).alias("key"), v.alias("x"))
    fine = F.forall("x", lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")) & ~F.isnan(c), F.lit(False)))
    return rows.where((F.size("x") == dim) & fine)


def starts(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The integer vectors of the ``k`` rows whose ids hash lowest."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    some = rows.where(F.col("key").isNotNull()).select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()
    return integers(np.array([r["x"] for r in some], float)) if some else np.zeros((0, 0), np.int64)


def blocks(rows: DataFrame, dim: int) -> DataFrame:
    """(keys, x): blocks of vectors as bytes, int32 where that holds the
    integers, else the doubles they are made from (``wide``)."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                wide = bool(np.abs(x).max() >= 2.0**22)
                data = x.astype("<f8") if wide else integers(x).astype("<i4")
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([keys, pa.array([data.tobytes()]), pa.array([wide])], ["keys", "x", "wide"])

    return rows.mapInArrow(run, f"keys array<{kind}>, x binary, wide boolean")


def unpacked(data: bytes, wide: bool, dim: int) -> np.ndarray:
    if wide:
        return integers(np.frombuffer(data, "<f8").reshape(-1, dim))
    return np.frombuffer(data, "<i4").reshape(-1, dim).astype(np.int64)


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2", key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256, one row
    per kept vector.

    The blocks are written once; ``rounds`` + 1 passes read them for the sums
    and a last one gives the rows.  Driver and tasks hold k x dim numbers."""
    spark = vectors.sparkSession
    rows = kept(vectors, key, column, dim)
    kind = vectors.schema[key].dataType.simpleString()
    c = starts(rows, k, seed)
    table = materialize(blocks(rows, dim), "vectors")

    def measured(c: np.ndarray) -> Sums:
        sent = spark.sparkContext.broadcast(c)

        def add(acc: Sums, r) -> Sums:
            x = unpacked(r["x"], r["wide"], dim)
            return acc.add(x, *nearest(x, sent.value))

        out = table.select("x", "wide").rdd.treeAggregate(Sums.empty(len(c), dim), add, Sums.merge)
        sent.unpersist()
        return out

    if not len(c):
        discard(table)
        schema = f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        c = measured(c).means(c)
    last = measured(c)
    each = [int(v) for v in last.inertia]
    sha = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in c]
    shared = spark.sparkContext.broadcast((c, each, sum(each), sha))

    def long(values) -> pa.Array:
        return pa.array([v if v <= LONG_MAX else None for v in map(int, values)], pa.int64())

    def rows_of(batches):
        c, each, total, sha = shared.value
        for b in batches:
            for r in range(b.num_rows):
                at, d = nearest(unpacked(b.column(1)[r].as_py(), b.column(2)[r].as_py(), dim), c)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[r].values, pa.array(at.astype(np.int32)), long(d), long(each[i] for i in at),
                        long([total] * len(at)), pa.array([sha[i] for i in at]),
                    ],
                    ["key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    schema = f"key {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return table.mapInArrow(rows_of, schema).withColumnRenamed("key", key)
