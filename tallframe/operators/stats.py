"""Means, deviations, correlation, regression, sensitivity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.matrices import coo_from_numpy
from .elementwise import FEATURES, interaction_pairs, vandermonde
from .gram import WIDE, Gram, gram, width
from .linalg import pinv
from .lsqr import lsqr, quadratic


def row_mean(m: DataFrame) -> DataFrame:
    return m.select("row_id", (F.aggregate(FEATURES, F.lit(0.0), lambda a, x: a + x) / F.size(FEATURES)).alias("x"))


def row_std(m: DataFrame) -> DataFrame:
    """Sample deviation of each row."""
    mean = F.aggregate(FEATURES, F.lit(0.0), lambda a, x: a + x) / F.size(FEATURES)
    with_mean = m.select("row_id", FEATURES, mean.alias("mean"))
    ss = F.aggregate(FEATURES, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    return with_mean.select("row_id", F.sqrt(F.try_divide(ss, F.size(FEATURES) - 1)).alias("x"))


def col_mean(m: DataFrame, k: int | None = None) -> DataFrame:
    """(j, x)."""
    return _per_column(m, F.avg, k)


def col_std(m: DataFrame, k: int | None = None) -> DataFrame:
    return _per_column(m, F.stddev_samp, k)


def _per_column(m: DataFrame, fn, k: int | None) -> DataFrame:
    k = k or width(m)
    one = m.agg(F.array(*(fn(F.col(FEATURES)[j]) for j in range(k))).alias("v"))
    return one.select(F.posexplode("v").alias("j", "x"))


def mat_mean(m: DataFrame, axis: int) -> DataFrame:
    """Axis 0: means of rows; else means of columns."""
    return row_mean(m) if axis == 0 else col_mean(m)


def mat_std(m: DataFrame, axis: int) -> DataFrame:
    return row_std(m) if axis == 0 else col_std(m)


def _vector(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def center(m: DataFrame, g: Gram | None = None) -> DataFrame:
    """Column means subtracted; one pass for the means, no join."""
    g = g or gram(m)
    return m.select("row_id", F.zip_with(FEATURES, _vector(g.mean), lambda x, u: x - u).alias(FEATURES))


def zcenter(m: DataFrame, g: Gram | None = None) -> DataFrame:
    """(a - mean) / sample deviation; NaN in a column without variance."""
    g = g or gram(m)
    inverse = [1 / s if s > 0 else float("nan") for s in g.std]
    shifted = F.zip_with(FEATURES, _vector(g.mean), lambda x, u: x - u)
    return m.select("row_id", F.zip_with(shifted, _vector(inverse), lambda x, s: x * s).alias(FEATURES))


def pearson_corr(m: DataFrame) -> np.ndarray:
    return gram(m).corr


def cov_centered(m: DataFrame) -> np.ndarray:
    return gram(m).cov


def frobenius(m: DataFrame) -> float:
    ss = F.aggregate(FEATURES, F.lit(0.0), lambda a, x: a + x * x)
    return float(np.sqrt(m.agg(F.sum(ss)).first()[0] or 0.0))


def with_y(x: DataFrame, y: Column | str) -> DataFrame:
    """Row matrix whose last column is ``y``."""
    y = F.col(y) if isinstance(y, str) else y
    return x.withColumn(FEATURES, F.concat(FEATURES, F.array(y.cast("double"))))


def linear_fit(xy: DataFrame, n_out: int = 1, g: Gram | None = None, method: str | None = None) -> np.ndarray:
    """(k + 1) x n_out coefficients, intercept last; ``xy`` holds x then y.

    "gram", for up to ``WIDE`` columns: normal equations on centred moments of
    one pass, so the intercept column never enters the conditioning.  "lsqr", for
    more columns, or where they are nearly dependent and the condition mustn't be
    squared: iterations of one pass each (``lsqr``; one y only)."""
    if g is None and (method or ("gram" if (k := width(xy)) <= WIDE else "lsqr")) == "lsqr":
        if n_out != 1:
            raise ValueError("one y only")
        return lsqr(xy)[0][:, None]
    g = g or gram(xy)
    k = len(g.mean) - n_out
    beta = pinv(g.comoment[:k, :k]) @ g.comoment[:k, k:]
    return np.vstack([beta, g.mean[k:] - g.mean[:k] @ beta])


def jac_from_lin(xy: DataFrame, n_out: int = 1) -> np.ndarray:
    """Slopes, n_out x k."""
    return linear_fit(xy, n_out)[:-1].T


def quad_fit(x: DataFrame, y: Column | str, k: int, method: str | None = None) -> np.ndarray:
    """Coefficients of [x, interactions, 1]; "lsqr", the default beyond ``WIDE``
    of them, forms interactions block by block and never stores them."""
    size = k + len(interaction_pairs(k))
    y = F.col(y) if isinstance(y, str) else y
    if (method or ("gram" if size < WIDE else "lsqr")) == "lsqr":
        return lsqr(with_y(x, y), quadratic, k=k + 1)[0][:, None]
    f = F.col(FEATURES)
    inter = [f[a] * f[b] for a, b in interaction_pairs(k)]
    full = x.select("row_id", F.concat(f, F.array(*inter, y.cast("double"))).alias(FEATURES))
    return linear_fit(full, g=gram(full, size + 1))


def quad_eval(x: DataFrame, coef: np.ndarray, k: int) -> DataFrame:
    """(row_id, x): value of the quadratic for each row."""
    v = vandermonde(x, k)
    prod = F.zip_with(FEATURES, _vector(np.ravel(coef)), lambda a, c: a * c)
    return v.select("row_id", F.aggregate(prod, F.lit(0.0), lambda a, t: a + t).alias("x"))


def jac_from_quad(x: DataFrame, coef: np.ndarray, k: int) -> DataFrame:
    """Analytic gradient of the quadratic at each row."""
    c, f = np.ravel(coef), F.col(FEATURES)
    out = [F.lit(float(c[j])) for j in range(k)]
    for (a, b), v in zip(interaction_pairs(k), c[k:]):
        out[a] = out[a] + F.lit(float(v)) * f[b]
        out[b] = out[b] + F.lit(float(v)) * f[a]
    return x.select("row_id", F.array(*out).alias(FEATURES))


def rsquared(xy: DataFrame, cor_dof: bool = False, g: Gram | None = None) -> float:
    """Multiple R^2 of the last column on the others from their correlations;
    ``cor_dof`` corrects for degrees of freedom.  One y only."""
    g = g or gram(xy)
    r, k = g.corr, len(g.mean) - 1
    r2 = float(r[k, :k] @ pinv(r[:k, :k]) @ r[:k, k])
    return 1 - (1 - r2) * (g.n - 1) / (g.n - k - 1) if cor_dof else r2


def sandwich(cov: np.ndarray, jac: np.ndarray) -> np.ndarray:
    """J S J^T."""
    jac = np.atleast_2d(jac)
    return jac @ cov @ jac.T


def to_frame(spark, a: np.ndarray) -> DataFrame:
    return coo_from_numpy(spark, a)
