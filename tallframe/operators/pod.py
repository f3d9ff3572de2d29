"""Proper orthogonal decomposition with interpolated weights.

Snapshots are ``snap_id, t ARRAY<DOUBLE>, field ARRAY<DOUBLE>``; few snapshots of
long fields.  The Gram matrix between snapshots is what the driver sees; modes
stay distributed over field points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .gram import gram
from .interp import RbfInterp, linear
from .linalg import eigh_desc, random_svd
from .linalg import times as right

MAX_SNAPSHOTS = 2000


class Interp1d:
    """One-dimensional interpolation: linear, nearest (a tie goes down), previous,
    next, or cubic with not-a-knot ends.  Outside of the times raises."""

    def __init__(self, t: np.ndarray, y: np.ndarray, kind: str = "linear"):
        order = np.argsort(t, kind="stable")
        self.t, self.y, self.kind = np.asarray(t, float)[order], np.asarray(y, float)[order], kind
        if kind not in ("linear", "nearest", "previous", "next", "cubic"):
            raise ValueError(f"unknown kind {kind}")
        if kind == "cubic":
            self.slope = self._slopes()

    def _slopes(self) -> np.ndarray:
        """Slopes of the spline at the knots."""
        t, y, n = self.t, self.y, len(self.t)
        if n < 4:
            raise ValueError("a cubic needs four times")
        h, d = np.diff(t), np.diff(y) / np.diff(t)
        a, r = np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
            r[i] = 3 * (h[i] * d[i - 1] + h[i - 1] * d[i])
        for i, j, g, e in ((0, 1, h[:2], d[:2]), (n - 1, n - 2, h[:-3:-1], d[:-3:-1])):
            a[i, i], a[i, j] = g[1], g[0] + g[1]
            r[i] = ((g[0] + 2 * (g[0] + g[1])) * g[1] * e[0] + g[0] ** 2 * e[1]) / (g[0] + g[1])
        return np.linalg.solve(a, r)

    def predict_array(self, q: np.ndarray) -> np.ndarray:
        x = np.asarray(q, float).reshape(-1)
        t, y = self.t, self.y
        if ((x < t[0]) | (x > t[-1])).any():
            raise ValueError("outside of the times")
        i = np.clip(np.searchsorted(t, x, "right") - 1, 0, len(t) - 2)
        u = (x - t[i]) / (t[i + 1] - t[i])
        if self.kind == "linear":
            out = y[i] + u * (y[i + 1] - y[i])
        elif self.kind == "nearest":
            out = np.where(u <= 0.5, y[i], y[i + 1])
        elif self.kind == "previous":
            out = np.where(u < 1, y[i], y[i + 1])
        elif self.kind == "next":
            out = np.where(u > 0, y[i + 1], y[i])
        else:
            h, v = t[i + 1] - t[i], 1 - u
            out = v * v * ((1 + 2 * u) * y[i] + u * h * self.slope[i]) + u * u * ((3 - 2 * u) * y[i + 1] - v * h * self.slope[i + 1])
        return out[:, None]


@dataclass(frozen=True)
class PodModel:
    """modes (x_idx, features of r weights), weights (n_snap x r), interpolators."""

    modes: DataFrame
    weights: np.ndarray
    interp: list
    times: np.ndarray

    def weights_at(self, t: np.ndarray) -> np.ndarray:
        t = np.atleast_2d(np.asarray(t, float))
        return np.hstack([f.predict_array(t) for f in self.interp])

    def predict(self, t) -> DataFrame:
        """(t_idx, row_id, x): field at each of the queried times."""
        w = self.weights_at(t)
        return right(self.modes, w.T).select("row_id", F.posexplode("features").alias("t_idx", "x")).select("t_idx", "row_id", "x")


#: field points of a range
RANGE = 1024


def points(snapshots: DataFrame, ids: list[int]) -> DataFrame:
    """Field points as rows (row_id = point, features = value per snapshot).

    The matrix is transposed by blocks: each field is cut into ranges of points,
    whose values move as one array; the pieces of a range are stacked where they
    meet, one for each snapshot, and turned."""
    place = {s: i for i, s in enumerate(ids)}
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("field") / RANGE).cast("int") - 1)),
        lambda r: F.struct(r.alias("range"), F.slice("field", r * RANGE + 1, RANGE).alias("v")),
    )
    cut = snapshots.select("snap_id", F.explode(pieces).alias("p")).select("snap_id", "p.range", F.col("p.v").cast("array<double>").alias("v"))

    def stack(key, rows):
        out = np.full((RANGE, len(ids)), np.nan)
        most = 0
        for s, v in zip(rows.column("snap_id").to_pylist(), rows.column("v")):
            values = v.values.to_numpy(zero_copy_only=False)
            out[: len(values), place[s]] = values
            most = max(most, len(values))
        out = out[:most]
        flat = pa.array(np.ascontiguousarray(out).ravel())
        ends = pa.array(np.arange(0, out.size + 1, max(1, len(ids)), dtype=np.int32))
        return pa.table({"row_id": pa.array(np.arange(most) + key[0].as_py() * RANGE), "features": pa.ListArray.from_arrays(ends, flat)})

    return cut.groupBy("range").applyInArrow(stack, "row_id long, features array<double>")


def fit(snapshots: DataFrame, n_modes: int, basis: str = "sorted", weights_by: str = "projection", kind: str = "rbf", seed: int = 0) -> PodModel:
    """No centring.  Modes are the leading left vectors over field points, found
    by the method of snapshots; weights are projections on them.

    ``basis``: "sorted" takes the largest eigenvalues, "unsorted" the first ones in
    the order that a general eigensolver gives them, "random" a randomized SVD.
    ``weights_by="lstsq"`` solves the least squares of each snapshot against the
    modes.  ``kind``: "rbf", or an interpolation of one-dimensional times
    (``Interp1d``)."""
    heads = sorted((r["snap_id"], list(r["t"])) for r in snapshots.select("snap_id", "t").limit(MAX_SNAPSHOTS + 1).collect())
    if len(heads) > MAX_SNAPSHOTS:
        raise ValueError(f"more than {MAX_SNAPSHOTS} snapshots")
    if n_modes > len(heads):
        raise ValueError(f"{n_modes} modes of {len(heads)} snapshots")
    ids, times = [h[0] for h in heads], np.array([h[1] for h in heads], float)
    p = stored(points(snapshots, ids), "points")  # read again by ``modes``
    if basis == "random":
        found = random_svd(p, n_modes, seed=seed, k=len(ids))
        s, v = found.s, found.vt.T
    else:
        c = gram(p, len(ids), "arrow").raw
        w, v = eigh_desc(c) if basis == "sorted" else map(np.real, np.linalg.eig(c))
        s, v = np.sqrt(np.maximum(w[:n_modes], 0)), v[:, :n_modes]
    # singular values under this share of the largest are noise of the Gram matrix
    scale = v * np.where(s > 1e-7 * s.max(initial=0), 1 / np.where(s > 0, s, 1), 0.0)
    modes = right(p, scale)
    if weights_by == "lstsq":  # normal equations of the modes, which are few
        c = gram(p, len(ids), "arrow").raw
        weights = np.linalg.lstsq(scale.T @ c @ scale, scale.T @ c, rcond=1e-10)[0].T
    else:
        weights = v * s  # modes^+ times each snapshot
    if kind == "rbf" or times.shape[1] != 1:
        interp = [RbfInterp(linear(), times.shape[1], 1).fit(times, weights[:, j]) for j in range(n_modes)]
    else:
        interp = [Interp1d(times[:, 0], weights[:, j], kind) for j in range(n_modes)]
    return PodModel(modes, weights, interp, times)

