"""Small optimisers for likelihoods: steepest descent, particle swarm, L-BFGS.

A problem scores a list of parameter vectors at once, so that a swarm or a
finite difference costs one pass over distributed data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

STEEPEST, SWARM, LBFGS = 0, 1, 2


@dataclass
class Problem:
    """nll(list of parameter vectors) -> values; ``bounds`` is [[lower], [upper]]."""

    nll: Callable[[list], np.ndarray]
    init: list
    bounds: np.ndarray

    def cost(self, many) -> np.ndarray:
        """NLL plus 10 x the squared violation of each bound."""
        p = np.atleast_2d(np.asarray(many, float))
        lo, hi = self.bounds
        pen = 10 * (np.minimum(p - lo, 0) ** 2 + np.maximum(p - hi, 0) ** 2).sum(1)
        v = np.asarray(self.nll([r.tolist() for r in p]), float)
        return np.where(np.isnan(v), np.inf, v) + pen

    def gradient(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and forward differences, p + 1 vectors in one call."""
        h = np.sqrt(np.finfo(float).eps) * np.maximum(1.0, np.abs(x))
        v = self.cost([x, *(x + h[i] * np.eye(len(x))[i] for i in range(len(x)))])
        if not np.isfinite(v).all():
            raise ArithmeticError("no finite likelihood near the point")
        return float(v[0]), (v[1:] - v[0]) / h


def _line(p: Problem, x, fx, g, d, first: float):
    """A step of sufficient decrease along d: 12 halvings scored at once, twice
    over if needed."""
    slope = float(g @ d)
    for scale in (first, first * 2.0**-12):
        steps = scale * 0.5 ** np.arange(12)
        v = p.cost([x + t * d for t in steps])
        ok = np.flatnonzero(v <= fx + 1e-4 * steps * slope)
        if len(ok):
            best = ok[np.argmin(v[ok])]
            return x + steps[best] * d, float(v[best])
    return None


def steepest_descent(p: Problem, max_iters: int = 40) -> np.ndarray:
    x = np.array(p.init, float)
    fx, g = p.gradient(x)
    if not np.isfinite(fx) or not np.isfinite(g).all():
        raise ArithmeticError("the start has no finite likelihood")
    first = 1.0
    for _ in range(max_iters):
        n = np.linalg.norm(g)
        if n < 1e-10:
            break
        got = _line(p, x, fx, g, -g / n, first * max(1.0, np.linalg.norm(x)))
        if got is None:
            break
        x, new = got
        if fx - new < 1e-12 * max(1.0, abs(fx)):
            break
        fx, g = p.gradient(x)
    return x


def particle_swarm(p: Problem, particles: int = 40, max_iters: int = 100, seed: int = 0) -> np.ndarray:
    """40 particles, 100 rounds, inside the bounds; one scoring call per round.

    Positions start evenly spread between the bounds, half of them on a
    logarithmic scale so that narrow scales are seen too."""
    rng = np.random.default_rng(seed)
    lo, hi = p.bounds
    k = len(lo)
    x = rng.uniform(lo, hi, (particles, k))
    half = particles // 2
    mag = 10 ** rng.uniform(-3, np.log10(np.maximum(np.abs(hi), 1e-2)), (half, k))
    x[:half] = np.clip(np.where((lo < 0) & (rng.random((half, k)) < 0.5), -mag, mag), lo, hi)
    x[0] = np.clip(p.init, lo, hi)
    v = np.zeros_like(x)
    own, score = x.copy(), p.cost(x)
    for _ in range(max_iters):
        best = own[np.argmin(score)]
        r, s = rng.random(x.shape), rng.random(x.shape)
        v = 0.7213 * v + 1.1931 * r * (own - x) + 1.1931 * s * (best - x)
        x = np.clip(x + v, lo, hi)
        now = p.cost(x)
        better = now < score
        own[better], score[better] = x[better], now[better]
        if np.ptp(own, axis=0).max() < 1e-12:
            break
    return own[np.argmin(score)]


def lbfgs(p: Problem, memory: int = 4, max_iters: int = 80, tol_grad: float = 1e-6, tol_cost: float = 1e-4) -> np.ndarray:
    x = np.array(p.init, float)
    fx, g = p.gradient(x)
    if not np.isfinite(fx) or not np.isfinite(g).all():
        raise ArithmeticError("the start has no finite likelihood")
    held: list[tuple[np.ndarray, np.ndarray]] = []
    calm = 0
    for _ in range(max_iters):
        if np.linalg.norm(g) < tol_grad:
            break
        q, coef = g.copy(), []
        for s, y in reversed(held):
            a = (s @ q) / (y @ s)
            coef.append(a)
            q -= a * y
        if held:
            s, y = held[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(held, reversed(coef)):
            q += (a - (y @ q) / (y @ s)) * s
        d = -q
        if g @ d >= 0:
            d, held = -g, []
        got = _line(p, x, fx, g, d, 1.0 if held else max(1.0, np.linalg.norm(x)) / max(1.0, np.linalg.norm(d)))
        if got is None:
            break
        nx, _ = got
        nf, ng = p.gradient(nx)
        s, y = nx - x, ng - g
        if s @ y > 1e-14:
            held = [*held, (s, y)][-memory:]
        calm = calm + 1 if abs(fx - nf) < tol_cost else 0
        x, fx, g = nx, nf, ng
        if calm >= 2:
            break
    return x


def mlefit(p: Problem, method: int) -> np.ndarray:
    """0 steepest descent, 1 particle swarm, 2 L-BFGS."""
    if method == STEEPEST:
        return steepest_descent(p)
    if method == SWARM:
        return particle_swarm(p)
    if method == LBFGS:
        return lbfgs(p)
    raise ValueError("method is 0 (steepest descent), 1 (particle swarm) or 2 (L-BFGS)")


def mlefit_fallback(p: Problem, method: int) -> np.ndarray:
    """The swarm takes over where another method fails."""
    try:
        out = mlefit(p, method)
        if np.isfinite(out).all():
            return out
    except ArithmeticError:
        pass
    return mlefit(p, SWARM)
