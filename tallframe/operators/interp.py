"""Radial basis interpolation with a polynomial tail."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .elementwise import FEATURES, interaction_pairs
from .gram import as_block
from .linalg import pinv

#: support points of one interpolant; the system is dense
MAX_SUPPORT = 5000


@dataclass(frozen=True)
class Kernel:
    """Function of the distance, for numpy arrays and for Columns."""

    name: str
    array: Callable[[np.ndarray], np.ndarray]
    column: Callable[[Column], Column]


def linear() -> Kernel:
    return Kernel("linear", lambda r: r, lambda r: r)


def cubic() -> Kernel:
    return Kernel("cubic", lambda r: r**3, lambda r: r * r * r)


def multiquadric(eps: float = 1.0) -> Kernel:
    return Kernel("multiquadric", lambda r: np.sqrt(1 + (eps * r) ** 2), lambda r: F.sqrt(1.0 + F.pow(F.lit(eps) * r, 2)))


def gaussian(eps: float = 1.0) -> Kernel:
    return Kernel("gaussian", lambda r: np.exp(-((eps * r) ** 2)), lambda r: F.exp(-F.pow(F.lit(eps) * r, 2)))


def kernel_of(kind: int, param: float) -> Kernel:
    """1 linear, 2 multiquadric, 3 cubic, any other Gaussian."""
    return {1: linear(), 2: multiquadric(param), 3: cubic()}.get(kind, gaussian(param))


def poly(x: np.ndarray, degree: int) -> np.ndarray:
    """[x, 1] below degree 2, else [x, interactions, 1]."""
    x = np.atleast_2d(x)
    ones = np.ones((len(x), 1))
    if degree < 2:
        return np.hstack([x, ones])
    return np.hstack([x, np.stack([x[:, a] * x[:, b] for a, b in interaction_pairs(x.shape[1])], 1), ones])


def distances(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.sqrt(((q[:, None, :] - s[None]) ** 2).sum(2))


def kernel_frame(queries: DataFrame, support: np.ndarray, kernel: Kernel) -> DataFrame:
    """(row_id, s, value): kernel of every query against every support point, as
    Column expressions over an array of supports (their number is checked)."""
    if len(support) > MAX_SUPPORT:
        raise ValueError("too many support points")
    points = F.array(*(F.array(*(F.lit(float(v)) for v in p)) for p in support))
    def dist(p):
        d = F.zip_with(FEATURES, p, lambda a, b: (a - b) * (a - b))
        return kernel.column(F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x)))
    return queries.select("row_id", F.posexplode(F.transform(points, dist)).alias("s", "value"))


@dataclass(frozen=True)
class RbfInterp:
    """Configuration, and after ``fit`` the support points and coefficients."""

    kernel: Kernel
    dim: int
    degree: int = 1
    support: np.ndarray | None = None
    coeffs: np.ndarray | None = None

    def system(self, x: np.ndarray, full: bool = True) -> np.ndarray:
        """[[K, P], [P^T, 0]], or [K, P] for queries."""
        s = x if full else self.support
        kp = np.hstack([self.kernel.array(distances(x, s)), poly(x, self.degree)])
        if not full:
            return kp
        n, m = len(x), kp.shape[1] - len(x)
        return np.vstack([kp, np.hstack([kp[:, n:].T, np.zeros((m, m))])])

    def fit(self, x: np.ndarray, y: np.ndarray, rcond: float | None = None) -> RbfInterp:
        """Several outputs are independent fits of the same system."""
        x, y = np.atleast_2d(np.asarray(x, float)), np.asarray(y, float)
        y = y.reshape(len(x), -1)
        if x.shape[1] != self.dim:
            raise ValueError(f"{x.shape[1]} columns for dimension {self.dim}")
        if len(x) > MAX_SUPPORT:
            raise ValueError(f"more than {MAX_SUPPORT} support points")
        a = self.system(x)
        rhs = np.vstack([y, np.zeros((len(a) - len(x), y.shape[1]))])
        return RbfInterp(self.kernel, self.dim, self.degree, x, pinv(a, rcond) @ rhs)

    def fit_frame(self, xy: DataFrame, rcond: float | None = None) -> RbfInterp:
        """From ``(row_id, features, y)``; its size is checked before it is collected."""
        if xy.limit(MAX_SUPPORT + 1).count() > MAX_SUPPORT:
            raise ValueError(f"more than {MAX_SUPPORT} support points")
        rows = xy.orderBy("row_id").select(FEATURES, "y").collect()
        return self.fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), rcond)

    def predict_array(self, q: np.ndarray) -> np.ndarray:
        q = np.atleast_2d(np.asarray(q, float))
        if q.shape[1] != self.dim:
            raise ValueError(f"{q.shape[1]} columns for dimension {self.dim}")
        return self.system(q, full=False) @ self.coeffs

    def predict(self, queries: DataFrame) -> DataFrame:
        """(row_id, x) by Arrow batches; supports and coefficients are sent along."""
        shared = queries.sparkSession.sparkContext.broadcast(self._plain())
        kernel = self.kernel

        def run(batches):
            dim, degree, support, coeffs = shared.value
            model = RbfInterp(kernel, dim, degree, support, coeffs)
            for b in batches:
                if b.num_rows:
                    q = as_block(b.column(1))
                    out = np.concatenate([model.predict_array(q[a : a + 512])[:, 0] for a in range(0, len(q), 512)])
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["row_id", "x"])

        return queries.select("row_id", FEATURES).mapInArrow(run, "row_id long, x double")

    def _plain(self):
        return self.dim, self.degree, self.support, self.coeffs


#: points of a patch, and how far patches reach beyond their cell, in shares of its width
PATCH, MARGIN = 400, 0.25


@dataclass(frozen=True)
class PatchedRbf:
    """Interpolation of any number of supports by overlapping local ones.

    The domain is cut into cells by a tree over a sample of the supports, drawn by
    the hash of their ids and of some ``LEAF`` for each cell.  The
    patch of a cell reaches beyond it on all sides; its own interpolant fits all
    supports inside.  A value is the weighted mean of the patches that hold
    the query, by smooth weights that fall to zero at a patch's edge (a partition
    of unity), so it is exact at the supports wherever each of the local ones is.
    One patch is solved in one task.  A patch of more than ``MAX_SUPPORT``
    supports (repeated or very clustered ones) raises an error."""

    kernel: Kernel
    dim: int
    degree: int = 1
    cells: tuple | None = None
    table: DataFrame | None = None

    def fit_frame(self, xy: DataFrame) -> PatchedRbf:
        """From ``(row_id, features, y)``; the patches are stored as a table."""
        from .active import Index

        total = xy.count()
        if not total:
            raise ValueError("no supports")
        # a share by the hash of ids alone: a limit would take what stands first in the table
        share = int(min(1.0, max(SAMPLE, total * LEAF // PATCH) / total) * (1 << 30))
        some = xy.where(F.pmod(F.xxhash64("row_id"), F.lit(1 << 30)) <= share).select(FEATURES).toArrow()
        x = as_block(some.column(0).combine_chunks())
        if x.shape[1] != self.dim:
            raise ValueError(f"{x.shape[1]} columns for dimension {self.dim}")
        tree = Index(np.arange(len(x)), x, max(1, round(len(x) * PATCH / total)))
        cells = _cells(tree, x)
        me = PatchedRbf(self.kernel, self.dim, self.degree, cells)
        kernel, dim, degree = self.kernel, self.dim, self.degree

        def solve(key, rows):
            if rows.num_rows > MAX_SUPPORT:
                raise ValueError(f"{rows.num_rows} supports in one patch")
            x, y = as_block(rows.column(FEATURES).combine_chunks()), rows.column("y").to_numpy().astype(float)
            mid = x[len(x) // 2].copy()  # polynomials about a point of the patch: far from the origin they'd hardly differ
            c = _solved(RbfInterp(kernel, dim, degree), x - mid, y)
            return pa.table({"patch": pa.array([key[0].as_py()], pa.int32()), "mid": [mid], "support": [(x - mid).ravel()], "coeffs": [c]})

        # supports reach twice as far as weights: a patch sees what lies around its queries
        patched = me._held(xy.select("row_id", FEATURES, F.col("y").cast("double").alias("y")), "row_id long, features array<double>, y double", 2.0)
        table = patched.groupBy("patch").applyInArrow(solve, "patch int, mid array<double>, support array<double>, coeffs array<double>")
        return PatchedRbf(self.kernel, self.dim, self.degree, cells, stored(table, "patches"))

    def _held(self, rows: DataFrame, schema: str, reach: float = 1.0) -> DataFrame:
        """Rows once for each patch that holds them, with ``patch`` and ``weight``;
        patches are found by descending the tree of cells, each with ``reach``
        margins around it."""
        from .active import Index

        shared = rows.sparkSession.sparkContext.broadcast(self.cells)

        def run(batches):
            depth, lo, hi, margin = shared.value
            tree = Index.__new__(Index)
            tree.depth = depth
            tree.set_boxes(lo - reach * margin, hi + reach * margin)
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    b = batch.slice(a, 4096)
                    x = as_block(b.column(1))
                    row, leaf = tree.reached(x, np.zeros(len(x)))
                    out = np.maximum(lo[leaf] - x[row], x[row] - hi[leaf]) / margin[leaf]
                    t = np.clip((1 - out) / 2, 0, 1)
                    weight = (t * t * (3 - 2 * t)).prod(1)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(at) for c in b.columns), pa.array(leaf.astype(np.int32)), pa.array(weight)], [*b.schema.names, "patch", "weight"]
                    )

        return rows.mapInArrow(run, schema + ", patch int, weight double")

    def predict(self, queries: DataFrame) -> DataFrame:
        """(row_id, x).  Patches that very many queries fall into are sent to
        several tasks."""
        asked = self._held(queries.select("row_id", FEATURES), "row_id long, features array<double>")
        busy = asked.groupBy("patch").count().select("patch", F.ceil(F.col("count") / QUERIES).cast("int").alias("tasks"))
        models = self.table.join(busy, "patch").withColumn("task", F.explode(F.expr("sequence(0, tasks - 1)"))).drop("tasks")
        dealt = asked.join(busy, "patch").withColumn("task", F.pmod(F.xxhash64("row_id"), F.col("tasks")).cast("int")).drop("tasks")
        kernel, dim, degree = self.kernel, self.dim, self.degree

        def value(model, rows):
            if not model.num_rows or not rows.num_rows:
                return pa.table({"row_id": pa.array([], pa.int64()), "v": pa.array([], pa.float64()), "weight": pa.array([], pa.float64())})
            support = model.column("support")[0].values.to_numpy().reshape(-1, dim)
            f = RbfInterp(kernel, dim, degree, support, model.column("coeffs")[0].values.to_numpy()[:, None])
            q = as_block(rows.column(FEATURES).combine_chunks()) - model.column("mid")[0].values.to_numpy()
            out = np.concatenate([f.predict_array(q[a : a + 512])[:, 0] for a in range(0, len(q), 512)])
            return pa.table({"row_id": rows.column("row_id"), "v": out, "weight": rows.column("weight")})

        parts = models.groupBy("patch", "task").cogroup(dealt.groupBy("patch", "task")).applyInArrow(value, "row_id long, v double, weight double")
        return parts.groupBy("row_id").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("x"))


def _solved(f: RbfInterp, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients by elimination where that is exact, else by least squares
    (supports given twice, too few for the polynomial, kernels too flat for them)."""
    a = f.system(x)
    rhs = np.append(y, np.zeros(len(a) - len(x)))
    try:
        c = np.linalg.solve(a, rhs)
        if np.isfinite(c).all() and np.abs(a @ c - rhs).max() <= 1e-9 * max(1.0, np.abs(y).max(initial=0)):
            return c
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(a, rhs, rcond=1e-14)[0]


#: supports that cells are cut from, those of one cell where they are more, queries of a patch that one task answers
SAMPLE, LEAF, QUERIES = 65_536, 16, 200_000


def _cells(tree, x: np.ndarray) -> tuple:
    """(depth, lo, hi, margins) of the tree's leaves: cells that fill the whole
    space, between the tree's cuts."""
    lo, hi = np.full((1, x.shape[1]), -np.inf), np.full((1, x.shape[1]), np.inf)
    for side, cut in zip(tree.side, tree.cut):
        lo, hi = np.repeat(lo, 2, axis=0), np.repeat(hi, 2, axis=0)
        at = np.arange(len(side))
        hi[2 * at, side], lo[2 * at + 1, side] = cut, cut
    tight = [f.reduceat(tree.x, tree.starts[:-1], axis=0) for f in (np.minimum, np.maximum)]
    wide = np.ptp(x, axis=0)
    spread = np.where(wide > 0, wide, 1.0)
    margin = np.maximum(MARGIN * (tight[1] - tight[0]), 1e-9 * spread)
    return tree.depth, lo, hi, margin
