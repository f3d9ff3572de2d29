"""Dynamic mode decomposition with control.

Input is one row per time step: ``t_idx INT, state ARRAY<DOUBLE>, control
ARRAY<DOUBLE>``.  States are long and time steps few: products over the state
are sums over distributed state points (one row per point, one column per
step); what the driver solves is n_t x n_t or smaller.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import stored
from .gram import as_block, gram
from .linalg import eigh_desc, tall_product
from .pod import points

MAX_STEPS = 2000
MAX_STATE = 5_000_000
#: singular values under this share of the largest are noise of the Gram matrix
CUT = 1e-7


def shift_pairs(steps: DataFrame) -> DataFrame:
    """(t_idx, x, y): each state with the next one; joined on the step index,
    so steps needn't pass through one task."""
    nxt = steps.select((F.col("t_idx") - 1).alias("t_idx"), F.col("state").alias("y"))
    return steps.select("t_idx", F.col("state").alias("x")).join(nxt, "t_idx")


def shift_pairs_window(steps: DataFrame, series: str) -> DataFrame:
    """Like ``shift_pairs`` for many series, by a window in each."""
    y = F.lead("state").over(W.partitionBy(series).orderBy("t_idx"))
    return steps.select(series, "t_idx", F.col("state").alias("x"), y.alias("y")).where("y is not null")


def state_points(steps: DataFrame) -> DataFrame:
    """(row_id = state point, features = value per step, in step order)."""
    ids = sorted(r["t_idx"] for r in steps.select("t_idx").limit(MAX_STEPS + 1).collect())
    return points(steps.select(F.col("t_idx").alias("snap_id"), F.col("state").alias("field")), ids)


@dataclass(frozen=True)
class DmdcModel:
    """Reduced operators and the factors that lift them.

    Row factors per state point are ``points x left`` for small matrices: U-hat =
    Y C and modes = Y (re, im); C, ``modes_right`` have n_t - 1 rows.
    """

    points: DataFrame
    n_t: int
    n_x: int
    a_til: np.ndarray
    b_til: np.ndarray
    basis_right: np.ndarray
    modes_right: np.ndarray
    eigs: np.ndarray
    gram_y: np.ndarray

    def _rows(self, right: np.ndarray, names: list[str]) -> DataFrame:
        """Y x right by state point; complex factors give one column per part."""
        parts = [right.real, right.imag] if np.iscomplexobj(right) else [right]
        shared = self.points.sparkSession.sparkContext.broadcast(np.stack(parts))

        def run(batches):
            r = shared.value
            for b in batches:
                if b.num_rows:
                    y = as_block(b.column(1))[:, 1:]
                    yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(y @ x), pa.list_(pa.float64())) for x in r)], ["row_id", *names])

        schema = "row_id long, " + ", ".join(f"{n} array<double>" for n in names)
        return self.points.mapInArrow(run, schema)

    def modes(self) -> DataFrame:
        """(row_id, re, im)."""
        return self._rows(self.modes_right.astype(complex), ["re", "im"])

    def basis(self) -> DataFrame:
        return self._rows(self.basis_right, ["features"])

    def est_b(self) -> DataFrame:
        """B (n_x x n_u) as rows."""
        return self._rows(self.basis_right @ self.b_til, ["features"])

    def _left(self) -> np.ndarray:
        """Phi^+ = left Y^T."""
        m = self.modes_right.astype(complex)
        return np.linalg.pinv(m.conj().T @ self.gram_y @ m, rcond=1e-12, hermitian=True) @ m.conj().T

    def _inner(self) -> np.ndarray:
        """A = Y inner Y^T, n_t - 1 rows and columns."""
        return ((self.modes_right * self.eigs) @ self._left()).real

    def applied(self, x: DataFrame) -> DataFrame:
        """A x for a row matrix with a row for each state point: of any length,
        since A is never formed."""
        return self._rows(self._inner() @ tall_product(self.points, x)[1:], ["features"])

    def mode_residual(self, which: np.ndarray) -> float:
        """max |A Phi - Phi L| / max |Phi| over some of the modes, taken over the
        distributed state points."""
        m = self.modes_right.astype(complex)[:, which]
        gap = self._inner() @ self.gram_y @ m - m * self.eigs[which]
        both = self._rows(np.hstack([gap, m]), ["re", "im"])
        size = F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b))
        k = len(which)
        far, long = both.select(size.alias("z")).agg(F.max(F.array_max(F.slice("z", 1, k))), F.max(F.array_max(F.slice("z", k + 1, k)))).first()
        return far / long

    def _against(self, x0) -> np.ndarray:
        """Y^T x0 in one pass; x0 is sent along (one number per state point,
        limited to ``MAX_STATE``)."""
        x0 = np.asarray(x0, float).ravel()
        if len(x0) > MAX_STATE:
            raise ValueError("the start state is too long to send; start from a step of the input")
        shared = self.points.sparkSession.sparkContext.broadcast(x0)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    y, at = as_block(b.column(1))[:, 1:], b.column(0).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([list(shared.value[at] @ y)], pa.list_(pa.float64()))], ["s"])

        parts = self.points.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("j", "v"))
        out = np.zeros(self.n_t - 1)
        for r in parts.groupBy("j").agg(F.sum("v").alias("v")).collect():
            out[r["j"]] = r["v"]
        return out

    def predict_multiple(self, x0: np.ndarray, u: np.ndarray) -> DataFrame:
        """(row_id, features): column j is the state after control u[:, j].

        States are combinations of [Re Phi, Im Phi, B], all of the form Y times a
        small matrix, so the recurrence for A = Re(Phi L Phi^+) runs on their
        coefficients with inner products taken through Y^T Y; the full states
        are lifted in one distributed pass."""
        u = np.atleast_2d(np.asarray(u, float))
        m, b = self.modes_right.astype(complex), self.basis_right @ self.b_til
        left = self._left()
        z = self.eigs * (left @ self._against(x0))
        on_re, on_im, on_b = (left @ self.gram_y @ x for x in (m.real, m.imag, b))
        coef = []
        for j in range(u.shape[1]):
            coef.append(np.concatenate([z.real, -z.imag, u[:, j]]))
            z = self.eigs * (on_re @ z.real - on_im @ z.imag + on_b @ u[:, j])
        return self._rows(np.hstack([m.real, m.imag, b]) @ np.array(coef).T, ["features"])

    def predict(self, x0: np.ndarray, u: np.ndarray) -> DataFrame:
        """State after one step."""
        return self.predict_multiple(x0, np.asarray(u, float).reshape(-1, 1))

    def _modes_local(self) -> np.ndarray:
        rows = sorted(self.modes().collect(), key=lambda r: r["row_id"])
        return np.array([r["re"] for r in rows]) + 1j * np.array([r["im"] for r in rows])

    def est_a(self, limit: int = 5000) -> np.ndarray:
        """Dense n_x x n_x operator; only for short states, ``applied`` is for any."""
        if self.n_x > limit:
            raise ValueError("the dense operator is too large; use applied()")
        phi = self._modes_local()
        return ((phi * self.eigs) @ np.linalg.pinv(phi)).real


def fit(steps: DataFrame, n_modes: int, n_iters: int = 20) -> DmdcModel:
    """``n_iters`` is accepted for its place in the interface: the Gram matrix
    over time gives the truncated factors exactly, without iterations."""
    del n_iters
    ctl = sorted((r["t_idx"], list(r["control"] or [])) for r in steps.select("t_idx", "control").limit(MAX_STEPS + 1).collect())
    if len(ctl) > MAX_STEPS:
        raise ValueError(f"more than {MAX_STEPS} steps")
    n_t = len(ctl)
    if n_modes > n_t - 1:
        raise ValueError(f"{n_modes} modes of {n_t} steps")
    u = np.array([c for _, c in ctl], float).reshape(n_t, -1)
    p = stored(state_points(steps), "states")  # every prediction reads it
    n_x = p.count()
    g = gram(p, n_t, "arrow").raw  # X^T X over state points, all steps
    gx, gxy, gy = g[:-1, :-1], g[:-1, 1:], g[1:, 1:]
    uu = u[:-1] @ u[:-1].T
    # input space: Omega^T Omega = X^T X + U U^T
    w, v = eigh_desc(gx + uu)
    s, v = np.sqrt(np.maximum(w[:n_modes], 0)), v[:, :n_modes]
    s_inv = np.where(s <= CUT * s.max(), 0.0, 1 / np.where(s > 0, s, 1))
    # output space: U-hat = Y V-hat / s-hat
    wy, vy = eigh_desc(gy)
    sy, vy = np.sqrt(np.maximum(wy[:n_modes], 0)), vy[:, :n_modes]
    c = vy * np.where(sy > CUT * sy.max(), 1 / np.where(sy > 0, sy, 1), 0.0)
    scale = c.T @ gy @ v * s_inv  # U-hat^T Y V S^-1
    u1_hat = (s_inv[:, None] * v.T) @ gxy @ c  # U1^T U-hat, U1 = X V S^-1
    u2 = u[:-1].T @ v * s_inv
    a_til = scale @ u1_hat
    b_til = scale @ u2.T
    eigs, vec = np.linalg.eig(a_til)
    modes_right = (v * s_inv) @ u1_hat @ vec  # Phi = Y V S^-1 U1^T U-hat W
    return DmdcModel(p, n_t, n_x, a_til, b_til, c, modes_right, eigs, gy)
