"""Mergeable sketches of rows: frequent directions.

A sketch holds at most ``size`` rows B of as many columns as the table A, with

    0 <= A^T A - B^T B <= loss I,    loss <= ||A||_F^2 / (size / 2),

and count and column sums exactly.  Rows are added by filling B up to twice its
size and shrinking its singular values by the middle one; sketches are merged by
stacking them and shrinking.  So a fitted model is brought up to date from the
sketch of new rows alone, old rows aren't read again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .elementwise import FEATURES
from .gram import FAN, as_block, width


def _shrunk(b: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """At most ``size`` rows, and what was taken off every square.  Fewer rows
    or columns than that lose nothing."""
    if len(b) <= size:
        return b, 0.0
    _, s, vt = np.linalg.svd(b, full_matrices=False)
    if len(s) <= size:
        return s[:, None] * vt, 0.0
    half = s[size // 2] ** 2
    keep = np.sqrt(np.maximum(s**2 - half, 0.0))
    rows = keep > 0
    return keep[rows, None] * vt[rows], float(half)


@dataclass(frozen=True)
class RowSketch:
    """n, sums (k), b (at most size x k), loss, size."""

    n: int
    sums: np.ndarray
    b: np.ndarray
    loss: float
    size: int

    def merge(self, other: RowSketch) -> RowSketch:
        if self.size != other.size or len(self.sums) != len(other.sums):
            raise ValueError("sketches of different sizes can't be merged")
        b, lost = _shrunk(np.vstack([self.b, other.b]), self.size)
        return RowSketch(self.n + other.n, self.sums + other.sums, b, self.loss + other.loss + lost, self.size)

    @property
    def means(self) -> np.ndarray:
        return self.sums / max(1, self.n)

    @property
    def raw(self) -> np.ndarray:
        """B^T B: A^T A up to ``loss``."""
        return self.b.T @ self.b

    @property
    def comoment(self) -> np.ndarray:
        """Sum of centred products, up to ``loss``."""
        return self.raw - self.n * np.outer(self.means, self.means)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(kind, i, features): the sketch as a table, to be stored and read back."""
        rows = [("meta", 0, [float(self.n), self.loss, float(self.size)]), ("sums", 0, self.sums.tolist())]
        return spark.createDataFrame(rows + [("row", i, r.tolist()) for i, r in enumerate(self.b)], "kind string, i int, features array<double>")

    @staticmethod
    def from_df(df: DataFrame) -> RowSketch:
        got: dict[str, list] = {"meta": [], "sums": [], "row": []}
        for r in df.orderBy("kind", "i").collect():
            got[r["kind"]].append(r["features"])
        n, loss, size = got["meta"][0]
        sums = np.array(got["sums"][0])
        return RowSketch(int(n), sums, np.array(got["row"], float).reshape(-1, len(sums)), loss, int(size))


def sketch(m: DataFrame, size: int = 64, k: int | None = None) -> RowSketch:
    """The sketch of a row matrix in one pass: one for each task, merged by FAN
    tasks and then on the driver.  ``size`` x columns numbers are held at a time."""
    k = k or width(m)
    schema = "part int, n double, loss double, sums array<double>, b array<double>"

    def sent(s: RowSketch, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([float(s.n)]), pa.array([s.loss]), pa.array([s.sums], pa.list_(pa.float64())), pa.array([s.b.ravel()], pa.list_(pa.float64()))],
            ["part", "n", "loss", "sums", "b"],
        )

    def local(batches):
        from pyspark import TaskContext

        acc = RowSketch(0, np.zeros(k), np.zeros((0, k)), 0.0, size)
        for batch in batches:
            x = as_block(batch.column(0))
            for a in range(0, len(x), size):
                some = x[a : a + size]
                acc = acc.merge(RowSketch(len(some), some.sum(0), some, 0.0, size))
        if acc.n:
            yield sent(acc, TaskContext.get().partitionId() % FAN)

    def unpacked(n, loss, sums, b) -> RowSketch:
        return RowSketch(int(n), np.asarray(sums, float), np.asarray(b, float).reshape(-1, k), loss, size)

    def merged(batches):
        held: dict[int, RowSketch] = {}
        for b in batches:
            for r in b.to_pylist():
                s = unpacked(r["n"], r["loss"], r["sums"], r["b"])
                held[r["part"]] = held[r["part"]].merge(s) if r["part"] in held else s
        for p in sorted(held):
            yield sent(held[p], p)

    parts = m.select(FEATURES).mapInArrow(local, schema).repartition(FAN, "part").mapInArrow(merged, schema)
    out = RowSketch(0, np.zeros(k), np.zeros((0, k)), 0.0, size)
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        out = out.merge(unpacked(r["n"], r["loss"], r["sums"], r["b"]))
    return out
