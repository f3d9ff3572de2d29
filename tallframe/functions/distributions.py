"""Univariate distributions as Column builders and Arrow functions.

``pdf`` and ``cdf`` take a Column and return a Column; what Spark SQL lacks
(error function, incomplete beta) runs in Arrow batches.  Spark's ``ln(0)`` is
null, which sums skip: log densities turn zero into -infinity first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import erf, lgamma, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.matrices import drawn
from ..sources.scratch import stored
from . import kde, optimize

#: erf at the grid points i / GRID up to 6, from which on it is 1 in double precision
GRID = 1024
_AT = np.arange(6 * GRID + 2) / GRID
_VALUE, _SLOPE = np.array([erf(x) for x in _AT]), 2 / sqrt(pi) * np.exp(-_AT * _AT)


def _ERF(x) -> np.ndarray:  # noqa: N802
    """Error function by cubic Hermite interpolation, to 1e-13."""
    x = np.asarray(x, float)
    z = np.minimum(np.abs(x), 6.0)
    i = np.where(np.isnan(z), 0, z * GRID).astype(np.int64)
    t = z * GRID - i
    a, b, c, d = _VALUE[i], _VALUE[i + 1], _SLOPE[i] / GRID, _SLOPE[i + 1] / GRID
    u = 1 - t
    return np.copysign(u * u * ((1 + 2 * t) * a + t * c) + t * t * ((3 - 2 * t) * b - u * d), x)


def erf_column(x: Column) -> Column:
    """Error function, batch by batch."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(_ERF(v.to_numpy(float)))

    return run(x)


def beta_reg(a: float, b: float, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified
    Lentz), vectorised over x."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    flip = x > (a + 1) / (a + b + 2)
    z = np.where(flip, 1 - x, x)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + p * np.log(z) + q * np.log1p(-z)) / p
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
    out = np.where(z == 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


def ln(p: Column) -> Column:
    """Natural logarithm with ln(0) = -infinity."""
    return F.when(p <= 0, F.lit(float("-inf"))).otherwise(F.log(p))


class UniRv:
    """pdf, cdf, sample, nll; ``params`` may override the stored parameters."""

    def pdf(self, x: Column, params=None) -> Column:
        raise NotImplementedError

    def cdf(self, x: Column, params=None) -> Column:
        raise NotImplementedError

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        raise NotImplementedError

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """(row_id, x): draws keyed by seed and block of row ids."""
        import pyarrow as pa

        me = self

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(drawn(b.column(0).to_numpy(), seed, me.draw))], ["row_id", "x"])

        return spark.range(n).mapInArrow(run, "row_id long, x double")

    def nll(self, df: DataFrame, column: str, params=None) -> float:
        """-sum of ln pdf, in one pass."""
        return float(nll_many(df, column, self, [params])[0])


def nll_many(df: DataFrame, column: str, rv: UniRv, many: list) -> np.ndarray:
    """NLL for many parameter sets in one pass over the data."""
    x = F.col(column)
    row = df.agg(*(F.sum(ln(rv.pdf(x, p))).alias(f"c{i}") for i, p in enumerate(many))).first()
    return np.array([-(v if v is not None else 0.0) for v in row], float)


def mle_problem(df: DataFrame, column: str, rv: UniRv, init, bounds) -> optimize.Problem:
    """NLL plus 10 x squared bound violations; batches of parameters share a pass."""
    return optimize.Problem(lambda ps: nll_many(df, column, rv, ps), list(init), np.asarray(bounds, float))


@dataclass(frozen=True)
class NormalRv(UniRv):
    mu: float = 0.0
    std: float = 1.0

    def pdf(self, x, params=None):
        mu, sd = params if params is not None else (self.mu, self.std)
        sd = abs(float(sd))
        z = (x - F.lit(float(mu))) / F.lit(sd)
        return F.exp(z * z * -0.5) * F.lit(1 / (sd * sqrt(2 * pi)))

    def cdf(self, x, params=None):
        mu, sd = params if params is not None else (self.mu, self.std)
        return (erf_column((x - F.lit(float(mu))) / F.lit(float(sd) * sqrt(2.0))) + 1.0) * 0.5

    def draw(self, rng, n):
        return rng.normal(self.mu, self.std, n)

    def mlfit(self, df: DataFrame, column: str, method: int | None = None) -> NormalRv:
        """Closed form (mean, population deviation), or optimiser 0, 1, 2."""
        if method is None:
            r = df.agg(F.avg(column), F.stddev_pop(column)).first()
            return NormalRv(r[0], r[1])
        n, m, v = df.agg(F.count(column), F.avg(column), F.var_pop(column)).first()

        def cost(many):  # the likelihood needs no more than these three numbers
            out = []
            for mu, sd in many:
                ok = sd != 0
                out.append(n * (log(abs(sd) * sqrt(2 * pi)) + (v + (m - mu) ** 2) / (2 * sd * sd)) if ok else 1e12)
            return np.array(out)

        p = optimize.Problem(cost, [10.0, 10.0], np.array([[-1000.0, 1e-12], [1000.0, 1000.0]]))
        return NormalRv(*map(float, optimize.mlefit_fallback(p, method)))


@dataclass(frozen=True)
class BetaRv(UniRv):
    alpha: float = 1.0
    beta: float = 1.0
    lb: float = 0.0
    ub: float = 1.0
    #: divide by the width of the support, so that the density integrates to 1
    normalized: bool = False

    def pdf(self, x, params=None):
        a, b = map(float, params if params is not None else (self.alpha, self.beta))
        u = (x - F.lit(self.lb)) / F.lit(self.ub - self.lb)
        const = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b)) / (self.ub - self.lb if self.normalized else 1.0)
        return F.pow(u, F.lit(a - 1)) * F.pow(1.0 - u, F.lit(b - 1)) * F.lit(float(const))

    def cdf(self, x, params=None):
        a, b = map(float, params if params is not None else (self.alpha, self.beta))

        @F.pandas_udf("double")
        def run(u: pd.Series) -> pd.Series:
            return pd.Series(beta_reg(a, b, u.to_numpy(float)))

        return run((x - F.lit(self.lb)) / F.lit(self.ub - self.lb))

    def draw(self, rng, n):
        return rng.beta(self.alpha, self.beta, n) * (self.ub - self.lb) + self.lb

    def mlfit(self, df: DataFrame, column: str, method: int | None = None) -> BetaRv:
        """Method of moments (sample variance) on [lb, ub]; with a method, the
        likelihood from sufficient statistics of one pass."""
        u = (F.col(column) - F.lit(self.lb)) / F.lit(self.ub - self.lb)
        if method is None:
            m, v = df.agg(F.avg(u), F.var_samp(u)).first()
            c = m * (1 - m) / v - 1
            return BetaRv(m * c, (1 - m) * c, self.lb, self.ub, self.normalized)
        n, s, t = df.agg(F.count(u), F.sum(ln(u)), F.sum(ln(1.0 - u))).first()

        def cost(many):
            out = []
            for a, b in many:
                ok = a > 0 and b > 0
                out.append(n * (lgamma(a) + lgamma(b) - lgamma(a + b)) - (a - 1) * s - (b - 1) * t if ok else 1e12)
            return np.array(out)

        p = optimize.Problem(cost, [1.0, 1.0], np.array([[1e-4, 1e-4], [200.0, 200.0]]))
        a, b = optimize.mlefit_fallback(p, method)
        return BetaRv(a, b, self.lb, self.ub, self.normalized)


@dataclass(frozen=True)
class ExponentialRv(UniRv):
    lam: float = 1.0

    def pdf(self, x, params=None):
        lam = float((params if params is not None else (self.lam,))[0])
        return F.lit(lam) * F.exp(x * F.lit(-lam))

    def cdf(self, x, params=None):
        lam = float((params if params is not None else (self.lam,))[0])
        return 1.0 - F.exp(x * F.lit(-lam))

    def draw(self, rng, n):
        return rng.exponential(1 / self.lam, n)

    def mlfit(self, df: DataFrame, column: str, method: int | None = None) -> ExponentialRv:
        if method is None:
            return ExponentialRv(1 / df.agg(F.avg(column)).first()[0])
        n, s = df.agg(F.count(column), F.sum(column)).first()

        def cost(many):
            return np.array([s * p[0] - n * log(p[0]) if p[0] > 0 else 1e12 for p in many])

        p = optimize.Problem(cost, [1.0], np.array([[1e-12], [100.0]]))
        return ExponentialRv(optimize.mlefit_fallback(p, method)[0])


@dataclass(frozen=True)
class KdeRv(UniRv):
    """Gaussian kernels of one width at the support points."""

    bandwidth: float
    support: np.ndarray = field(repr=False)
    weights: np.ndarray | None = field(default=None, repr=False)

    MAX = 20_000

    def _kernel(self, x: Column, fn: Callable) -> Column:
        s = np.asarray(self.support, float)
        if len(s) > self.MAX:
            raise ValueError(f"more than {self.MAX} support points: sample them first")
        w = np.full(len(s), 1 / len(s)) if self.weights is None else np.asarray(self.weights, float)

        @F.pandas_udf("double")
        def run(v: pd.Series) -> pd.Series:
            q = v.to_numpy(float)
            out = [fn((q[a : a + 2048, None] - s)) @ w for a in range(0, len(q), 2048)]
            return pd.Series(np.concatenate(out) if out else q)

        return run(x)

    def pdf(self, x, params=None):
        h = float((params if params is not None else (self.bandwidth,))[0])
        return self._kernel(x, lambda d: np.exp(-0.5 * (d / h) ** 2) / (h * sqrt(2 * pi)))

    def cdf(self, x, params=None):
        h = float((params if params is not None else (self.bandwidth,))[0])
        return self._kernel(x, lambda d: 0.5 * (1 + _ERF(d / (h * sqrt(2)))))

    def draw(self, rng, n):
        """Support points picked evenly (weights aren't looked at) plus noise."""
        return np.asarray(self.support, float)[rng.integers(0, len(self.support), n)] + rng.normal(0, self.bandwidth, n)

    def est_bandwidth(self, test: np.ndarray | DataFrame, column: str | None = None, method: int = 1) -> float:
        """Width that minimises the NLL of the test samples (not stored), nulls
        left out, weights of the supports kept.

        The likelihood is evaluated on nested logarithmic grids of widths, about
        five in all; each is one pass if the samples are a table.  The optimiser
        runs on the line through these values."""
        s = np.asarray(self.support, float)
        w = np.full(len(s), 1 / len(s)) if self.weights is None else np.asarray(self.weights, float)
        if isinstance(test, DataFrame):
            held = test.sparkSession.createDataFrame(pd.DataFrame({"grp": np.zeros(len(s), np.int32), "s": s, "w": w}))
            asked = test.select(F.lit(0).alias("grp"), F.col(column).cast("double").alias("x"))

            def costs(grids):
                return kde.likelihoods(held, asked, grids, weighted=True)
        else:
            x = np.asarray(test, float)
            x = x[~np.isnan(x)]

            def costs(grids):
                return {g: np.array([_kernel_nll(x, s, w, h) for h in hs]) for g, hs in grids.items()}

        return _optimum(*kde.zoom(costs, *BANDWIDTHS)[0], self.bandwidth, method)


#: the least and the largest width that is looked at
BANDWIDTHS = (1e-9, 1000.0)


def _kernel_nll(x: np.ndarray, s: np.ndarray, w: np.ndarray, h: float) -> float:
    total = 0.0
    for a in range(0, len(x), 1024):
        p = np.exp(-0.5 * ((x[a : a + 1024, None] - s) / h) ** 2) @ w / (h * sqrt(2 * pi))
        with np.errstate(divide="ignore"):
            total -= np.log(p).sum()
    return total


def _optimum(widths: np.ndarray, costs: np.ndarray, init: float, method: int) -> float:
    """Where the optimiser ends on the line through the costs; the best width
    seen, should it end anywhere worse."""
    line = lambda many: np.interp([np.log(max(abs(h), BANDWIDTHS[0])) for (h,) in many], np.log(widths), costs)
    found = float(optimize.mlefit_fallback(optimize.Problem(line, [init], np.array(BANDWIDTHS)[:, None]), method)[0])
    best = int(np.argmin(costs))
    return found if line([(found,)])[0] < costs[best] else float(widths[best])


def build_kde(bandwidth: float, samples: np.ndarray, n_iter: int = 20, method: int = 1, seed: int = 0) -> KdeRv:
    """Widths of n_iter random 70/30 splits; the upper median is used with all samples."""
    x = np.asarray(samples, float)
    found = []
    for i in range(n_iter):
        pick = np.random.default_rng([seed, i]).random(len(x)) < 0.7
        if pick.any() and not pick.all():
            found.append(KdeRv(bandwidth, x[pick]).est_bandwidth(x[~pick], method=method))
    return KdeRv(upper_median(found), x)


def estimated_bandwidth(support: DataFrame, test: DataFrame, bandwidth: float = 1.0, method: int = 1) -> float:
    """``KdeRv.est_bandwidth`` with both sides as tables, ``support(s)`` and ``test(x)``."""
    return _bandwidths(
        support.select(F.lit(0).alias("grp"), F.col("s").cast("double")), test.select(F.lit(0).alias("grp"), F.col("x").cast("double")), [0], bandwidth, method
    )[0]


def split_bandwidth(samples: DataFrame, column: str, key: str, bandwidth: float = 1.0, n_iter: int = 20, method: int = 1, seed: int = 0) -> float:
    """The width of ``build_kde`` for a table: rows are dealt 70/30 for each of
    the splits by a hash of their key, and all splits share their passes."""
    splits = F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))).alias("grp")
    rows = samples.select(F.col(key).alias("key"), F.col(column).cast("double").alias("v"), splits).where(F.col("v").isNotNull())
    inside = F.pmod(F.xxhash64("key", "grp", F.lit(seed)), F.lit(1000)) < 700
    found = _bandwidths(rows.where(inside).select("grp", F.col("v").alias("s")), rows.where(~inside).select("grp", F.col("v").alias("x")), range(n_iter), bandwidth, method)
    return upper_median(list(found.values()))


def _bandwidths(support: DataFrame, test: DataFrame, groups, bandwidth: float, method: int) -> dict[int, float]:
    # equal values count together, and every pass reads them as they are
    held = stored(support.where(F.col("s").isNotNull()).groupBy("grp", "s").agg(F.count("*").cast("double").alias("w")), "supports")
    asked = stored(test.where(F.col("x").isNotNull()).groupBy("grp", "x").agg(F.count("*").cast("double").alias("m")), "tested")
    seen = kde.zoom(lambda grids: kde.likelihoods(held, asked, grids), *BANDWIDTHS, groups)
    return {g: _optimum(*seen[g], bandwidth, method) for g in groups}


def upper_median(values) -> float:
    return float(np.sort(np.asarray(values, float))[len(values) // 2])


def kde_pdf_frame(queries: DataFrame, support: DataFrame, bandwidth: float) -> DataFrame:
    """(q, density) with both sides as tables ``(q, x)`` and ``(s)`` of any size."""
    return kde.kernel_sums(queries, support, bandwidth).select("q", "density")
