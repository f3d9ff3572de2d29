"""Iterative least squares from distributed products alone.

Golub-Kahan bidiagonalisation (Paige and Saunders' LSQR).  The left vectors are
as long as the table, but each is A c + d b for a short c and a number d, which
the driver keeps instead: one pass over the rows forms A c + d b block by block
and adds up its norm and its product with A^T.  Nothing is squared, so the error
grows with the condition number and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .gram import width
from .linalg import tall_t_times

Design = Callable[[np.ndarray], np.ndarray]


def quadratic(x: np.ndarray) -> np.ndarray:
    """[x, interactions] of a block of rows."""
    a, b = np.triu_indices(x.shape[1])
    return np.hstack([x, x[:, a] * x[:, b]])


def lsqr(xy: DataFrame, design: Design | None = None, tol: float = 1e-14, max_iters: int | None = None, k: int | None = None) -> tuple[np.ndarray, int]:
    """(coefficients with the intercept last, passes over the rows).

    ``xy`` holds x and then y; ``design`` may widen the x of a block.  Columns
    are centred and scaled on the fly by their means and deviations, which two
    first passes take.  Stops when ||A^T r|| <= tol ||A|| ||r||, when ||r|| <=
    tol ||b||, when the bidiagonalisation ends, or after ``max_iters`` (twice the
    columns, at most 500).  Rank-deficient tables get the solution of least norm
    in scaled columns."""
    k = k or width(xy)
    design = design or (lambda x: x)
    size = design(np.zeros((1, k - 1))).shape[1]

    def parts(block):
        return design(block[:, :-1]), block[:, -1]

    def first(block):
        x, y = parts(block)
        return np.concatenate([[len(x)], x.sum(0), [y.sum()]])[None]

    sums = tall_t_times(xy, None, first, 1, size + 2)[0]
    n, means = sums[0], sums[1:] / max(1.0, sums[0])
    sent = xy.sparkSession.sparkContext.broadcast(means)

    def spread(block):
        x, y = parts(block)
        m = sent.value
        return np.concatenate([((x - m[:-1]) ** 2).sum(0), [((y - m[-1]) ** 2).sum()]])[None]

    norms = np.sqrt(tall_t_times(xy, None, spread, 1, size + 1)[0])
    # what a column varies by rounding alone is no column
    scale = np.where(norms[:-1] > 1e-14 * np.abs(means[:-1]) * np.sqrt(n), 1 / np.where(norms[:-1] > 0, norms[:-1], 1), 0.0)

    def step(c: np.ndarray, d: float) -> tuple[float, np.ndarray]:
        """(||t||^2, A^T t) for t = A c + d b, A centred and scaled."""
        now = xy.sparkSession.sparkContext.broadcast((means, scale, c, d))

        def add(block):
            m, s, c, d = now.value
            x, y = parts(block)
            x = (x - m[:-1]) * s
            t = x @ c + d * (y - m[-1])
            return np.concatenate([[t @ t], x.T @ t])[None]

        out = tall_t_times(xy, None, add, 1, size + 1)[0]
        now.unpersist()
        return out[0], out[1:]

    passes, w_sum, basis = 2, np.zeros(size), []
    c, d = np.zeros(size), 1.0
    norm2, g = step(c, d)
    passes += 1
    beta = b_norm = np.sqrt(norm2)
    if beta > 0:
        d, v = d / beta, g / beta
        alpha = np.linalg.norm(v)
        if alpha > 0:
            v = v / alpha
            basis.append(v)
            w, phi, rho = v.copy(), beta, alpha
            a_norm2 = alpha**2
            for _ in range(max_iters or min(500, 2 * size + 2)):
                c, d = v - alpha * c, -alpha * d
                norm2, g = step(c, d)
                passes += 1
                beta = np.sqrt(norm2)
                if beta > 0:
                    c, d = c / beta, d / beta
                    v = g / beta - beta * v
                    for q in basis:  # short vectors: kept orthogonal
                        v = v - (q @ v) * q
                    alpha = np.linalg.norm(v)
                    v = v / alpha if alpha > 0 else v
                    basis.append(v)
                else:
                    alpha = 0.0
                r = np.hypot(rho, beta)
                cos, sin = rho / r, beta / r
                theta, rho_next, phi_now = sin * alpha, -cos * alpha, cos * phi
                phi = sin * phi
                w_sum = w_sum + (phi_now / r) * w
                w = v - (theta / r) * w
                rho = rho_next
                a_norm2 += alpha**2 + beta**2
                if beta == 0 or alpha <= 1e-15 * np.sqrt(a_norm2) or phi <= tol * b_norm or alpha * abs(cos) <= tol * np.sqrt(a_norm2) or len(basis) > size:
                    break
    beta_x = w_sum * scale
    return np.append(beta_x, means[-1] - means[:-1] @ beta_x), passes
