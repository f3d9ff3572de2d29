"""Seeded samplers: constrained Dirichlet, multivariate normal, DE-MCMC.

All draws come from generators keyed by (seed, logical task or row), never by
partition, so results don't depend on how Spark deals the work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.matrices import random_normal
from .linalg import times

LIST = pa.list_(pa.float64())


def alphas_of(alphas, dim: int) -> np.ndarray:
    """None: ones; one value: all alike; else one per dimension."""
    if alphas is None:
        return np.ones(dim)
    a = np.asarray(alphas, float).ravel()
    if len(a) == 1:
        return np.repeat(a, dim)
    if len(a) != dim:
        raise ValueError("shape parameters: one, or one per dimension")
    return a


def shot_sample(rng, bounds: np.ndarray, n: int, max_shots: int, chunk: int, c_scale: float, alphas: np.ndarray, strict: bool = False) -> np.ndarray:
    """Up to n rows of Dirichlet(alphas) * c_scale inside the box, whose bounds
    are part of it unless ``strict``."""
    kept, have = [], 0
    for _ in range(max_shots):
        z = rng.dirichlet(alphas, chunk) * c_scale
        inside = (z > bounds[:, 0]) & (z < bounds[:, 1]) if strict else (z >= bounds[:, 0]) & (z <= bounds[:, 1])
        z = z[inside.all(1)][: n - have]
        kept.append(z)
        have += len(z)
        if have >= n:
            break
    return np.concatenate(kept) if kept else np.zeros((0, len(bounds)))


#: rows that a trial of the shots waits for, and rows it draws at most
TRIAL, TRIAL_DRAWS = 200, 2_000_000


def _worth(bounds: np.ndarray, n: int, max_shots: int, chunk: int, c_scale: float, alphas: np.ndarray, seed: int, strict: bool) -> int:
    """Half the rows that all shots of a task can be expected to give; n if the
    trial finds none or even small tasks need no more."""
    if n <= 10 * TRIAL:
        return n
    found = drawn = 0
    rng = np.random.default_rng([seed, n, TRIAL])
    while found < TRIAL and drawn < min(TRIAL_DRAWS, max_shots * chunk):
        some = min(chunk, TRIAL_DRAWS)
        found += len(shot_sample(rng, bounds, some, 1, some, c_scale, alphas, strict))
        drawn += some
    return max(1, int(found / drawn * max_shots * chunk / 2)) if found else n


def constrained_dirichlet(
    spark: SparkSession, bounds, n: int, max_zshots: int = 500, chunk_size: int = 20_000, c_scale: float = 1.0, alphas=None, seed: int = 0,
    pad_zeros: bool = False, task_rows: int | None = None, strict: bool = False,
) -> DataFrame:
    """(row_id, features): n samples that sum to c_scale inside the box; fewer if
    the shots run out (``pad_zeros`` fills up with zero rows).  Drawn in ten
    logical tasks, or more, of at most ``task_rows`` rows; unless that is given,
    of at most half the rows that a task's shots are worth by a first trial, so
    that the shots do not run out because n is large."""
    bounds = np.asarray(bounds, float)
    a = alphas_of(alphas, len(bounds))
    if n <= 0:
        return spark.createDataFrame([], "row_id long, features array<double>")
    size = max(1, min(task_rows or _worth(bounds, n, max_zshots, chunk_size, c_scale, a, seed, strict), n // min(n, 10)))
    tasks = -(-n // size)

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                want = min(size, n - t * size)
                z = shot_sample(np.random.default_rng([seed, t]), bounds, want, max_zshots, chunk_size, c_scale, a, strict)
                if pad_zeros:
                    z = np.vstack([z, np.zeros((want - len(z), len(bounds)))])
                ids = t * size + np.arange(len(z))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(z), LIST)], ["row_id", "features"])

    return spark.range(tasks, numPartitions=min(tasks, spark.sparkContext.defaultParallelism * 4)).mapInArrow(run, "row_id long, features array<double>")


def n_short(samples: DataFrame, n: int) -> int:
    """Rows missing because shots ran out."""
    return n - samples.count()


def mv_normal(spark: SparkSession, cov: np.ndarray, n: int, seed: int = 0, factor: str = "cov") -> DataFrame:
    """Standard normal rows times the covariance itself (as first defined: the
    realised covariance is S S^T) or its Cholesky factor."""
    cov = np.asarray(cov, float)
    f = cov if factor == "cov" else np.linalg.cholesky(cov)
    return times(random_normal(spark, n, len(cov), seed), f.T)


# log densities: callables on a (chains x dim) array


def ln_prior_uniform(bounds) -> Callable[[np.ndarray], np.ndarray]:
    b = np.asarray(bounds, float)
    return lambda x: np.where(((x > b[:, 0]) & (x < b[:, 1])).all(1), 0.0, -np.inf)


def ln_like_dirichlet(alphas, c_scale: float = 1.0, tol: float = 1e-6) -> Callable[[np.ndarray], np.ndarray]:
    """Log density at x / c_scale, which must sum to 1."""
    a = np.asarray(alphas, float)
    const = lgamma(a.sum()) - sum(map(lgamma, a))

    def fn(x):
        z = x / c_scale
        if (np.abs(z.sum(1) - 1) > tol).any():
            raise ValueError("samples must sum to the scale")
        with np.errstate(invalid="ignore", divide="ignore"):
            return const + np.where(a == 1, 0.0, (a - 1) * np.log(z)).sum(1)

    return fn


def ln_sum(*fns) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: sum(f(x) for f in fns)


def accept_ratio_of(now: np.ndarray, new: np.ndarray) -> np.ndarray:
    """exp of the difference clamped to [0, 1]; NaN counts as 1."""
    with np.errstate(invalid="ignore", over="ignore"):
        a = np.exp(new - now)
    return np.where(np.isnan(a), 1.0, np.clip(a, 0, 1))


@dataclass
class DeMcSampler:
    """Differential-evolution MCMC over an ensemble of chains."""

    ln_prob: Callable[[np.ndarray], np.ndarray]
    heads: np.ndarray
    gamma: float = 0.8
    var_epsilon: float = 1e-10
    fixup: Callable[[np.ndarray], np.ndarray] | None = None
    seed: int = 0
    samples: list = field(default_factory=list)
    accepted: list = field(default_factory=list)

    def __post_init__(self):
        self.heads = np.array(self.heads, float)
        if len(self.heads) < 3:
            raise ValueError("at least 3 chains are needed")
        self.rng = np.random.default_rng(self.seed)
        self.samples.append(self.heads.copy())

    def set_prop_fixup(self, fn) -> None:
        self.fixup = fn

    def _partners(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two other chains, different from each other."""
        n = len(self.heads)
        a = (c + 1 + self.rng.integers(0, n - 1, len(c))) % n
        b = self.rng.integers(0, n - 2, len(c))
        lo, hi = np.minimum(a, c), np.maximum(a, c)
        b = b + (b >= lo)
        return a, b + (b >= hi)

    def _step(self, c: np.ndarray) -> np.ndarray:
        a, b = self._partners(c)
        x = self.heads[c]
        new = x + self.gamma * (self.heads[a] - self.heads[b]) + self.rng.uniform(0, self.var_epsilon, x.shape)
        if self.fixup is not None:
            new = self.fixup(new)
        ok = self.rng.random(len(c)) < accept_ratio_of(self.ln_prob(x), self.ln_prob(new))
        self.heads[c] = np.where(ok[:, None], new, x)
        return ok

    def sample_par(self, n: int) -> None:
        """All chains propose from the same heads."""
        everyone = np.arange(len(self.heads))
        for _ in range(n):
            self.accepted.append(self._step(everyone))
            self.samples.append(self.heads.copy())

    def sample(self, n: int) -> None:
        """Chains in turn; later ones see the moves of earlier ones."""
        for _ in range(n):
            self.accepted.append(np.concatenate([self._step(np.array([c])) for c in range(len(self.heads))]))
            self.samples.append(self.heads.copy())

    def accept_ratio(self) -> float:
        return float(np.mean(self.accepted)) if self.accepted else float("nan")

    def n_samples(self) -> int:
        return len(self.samples) * len(self.heads)

    def chain_samples(self, chain: int, n: int = 0) -> np.ndarray:
        s = self.samples[-n:] if n else self.samples
        return np.array([x[chain] for x in s])

    def get_samples(self, n: int = 0) -> np.ndarray:
        """Last n of each chain (0: all), step by step and chain by chain."""
        return np.concatenate(self.samples[-n:] if n else self.samples)


def ensembles(
    spark: SparkSession, ln_prob, starts, n_steps: int, n_ensembles: int = 1, gamma: float = 0.8, var_epsilon: float = 1e-10, fixup=None,
    seed: int = 0, sequential: bool = False,
) -> DataFrame:
    """(ensemble_id, chain_id, step, sample, accepted): independent ensembles,
    one task each; ``starts`` is an array of heads or a function of a generator.
    The start is step 0 (accepted null)."""

    def run(batches):
        for b in batches:
            for e in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, e])
                heads = starts(rng) if callable(starts) else starts
                s = DeMcSampler(ln_prob, heads, gamma, var_epsilon, fixup, seed=[seed, e, 1])
                (s.sample if sequential else s.sample_par)(n_steps)
                chains = len(s.heads)
                for a in range(0, n_steps + 1, 2000):
                    some = range(a, min(a + 2000, n_steps + 1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([e] * len(some) * chains, pa.int64()), pa.array(list(range(chains)) * len(some), pa.int32()),
                            pa.array([t for t in some for _ in range(chains)], pa.int32()), pa.array([x.tolist() for t in some for x in s.samples[t]], LIST),
                            pa.array([None if t == 0 else bool(s.accepted[t - 1][c]) for t in some for c in range(chains)]),
                        ],
                        ["ensemble_id", "chain_id", "step", "sample", "accepted"],
                    )

    schema = "ensemble_id long, chain_id int, step int, sample array<double>, accepted boolean"
    return spark.range(n_ensembles, numPartitions=n_ensembles).mapInArrow(run, schema)


def chain_tail(chains: DataFrame, n: int = 0) -> DataFrame:
    """Last n rows of each chain (0: all)."""
    if not n:
        return chains
    rank = F.row_number().over(W.partitionBy("ensemble_id", "chain_id").orderBy(F.col("step").desc()))
    return chains.withColumn("r", rank).where(F.col("r") <= n).drop("r")


def get_samples(chains: DataFrame, n: int = 0) -> DataFrame:
    """(position, ensemble_id, chain_id, step, sample): the last n rows of each
    chain (0: all), step by step and in each step chain by chain, from 0 on."""
    from ..plans.ordering import global_rank

    rows = chain_tail(chains, n).select("ensemble_id", "chain_id", "step", "sample")
    return global_rank(rows, [F.col("ensemble_id"), F.col("step"), F.col("chain_id")], "position")


def chain_heads(chains: DataFrame) -> DataFrame:
    return chains.groupBy("ensemble_id", "chain_id").agg(F.max_by("sample", "step").alias("sample"))


def accept_ratio(chains: DataFrame) -> DataFrame:
    return chains.agg(F.avg(F.col("accepted").cast("int")).alias("accept_ratio"))
