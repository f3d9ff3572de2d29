"""Gaussian kernel sums over tables of supports, without any pair of rows.

Positions are measured in widths h and dealt into bins of ``BIN`` widths.  A bin
of supports is summed up by its moments about its middle; a bin of queries gets
one polynomial, to which each bin of supports within ``reach`` widths adds: both
sides expanded in a Taylor series of the kernel,

    phi(v0 + t - u) = sum over a, k of phi^(a+k)(v0) t^a (-u)^k / (a! k!).

With |t|, |u| <= BIN / 2 and all terms of degree a + k <= ``DEGREE`` kept,
Cramer's bound on Hermite functions, |phi^(n)| <= 0.4348 sqrt(n!), leaves an
error of at most 0.4348 sum over n > DEGREE of BIN^n / sqrt(n!) < 1e-15 of the
kernel's scale for each unit of weight; what lies beyond ``reach`` = 9 is below
1e-17.  Supports and queries are read once each, and what meets are bins.
"""

from __future__ import annotations

from math import erf, exp, factorial, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN, DEGREE = 0.25, 14
#: widths beyond which a kernel counts as nothing, for values and for likelihoods
REACH, LIKELY = 9.0, 20.0
#: bins are numbered by long integers
FAR = 9e18


def _derivatives(v: float, cumulative: bool) -> np.ndarray:
    """phi^(n)(v) for n up to 2 DEGREE; of its integral with ``cumulative``."""
    d = [exp(-v * v / 2) / sqrt(2 * pi)]
    d.append(-v * d[0])
    for n in range(1, 2 * DEGREE):
        d.append(-v * d[n] - n * d[n - 1])
    return np.array([0.5 * (1 + erf(v / sqrt(2))), *d[:-1]] if cumulative else d)


def _transfer(w: int, cumulative: bool) -> np.ndarray:
    """Matrices (offset of bins, moment, power) that turn moments into a polynomial."""
    f = np.array([factorial(n) for n in range(DEGREE + 1)], float)
    k, a = np.meshgrid(np.arange(DEGREE + 1), np.arange(DEGREE + 1), indexing="ij")
    scale = np.where(k % 2, -1.0, 1.0) / (f[a] * f[k])
    return np.stack([_derivatives(j * BIN, cumulative)[a + k] * scale for j in range(-w, w + 1)])


def _placed(df: DataFrame, value: str) -> DataFrame:
    """Rows with ``h``: their bin, and where they lie in it."""
    at = F.least(F.greatest(F.col(value) / (F.col("h") * BIN), F.lit(-FAR)), F.lit(FAR))
    return df.withColumn("at", at).withColumn("bin", F.floor("at").cast("long")).withColumn("t", (F.col("at") - F.col("bin") - 0.5) * BIN).drop("at")


def _moments(placed: DataFrame) -> DataFrame:
    power, sums = F.col("w"), []
    for _ in range(DEGREE + 1):
        sums.append(F.sum(power))
        power = power * F.col("t")
    return placed.groupBy("g", "bin").agg(F.array(*sums).alias("m"))


def _polynomials(moments: DataFrame, targets: DataFrame, reach: float, cumulative: bool) -> DataFrame:
    """(g, bin, c): coefficients for each bin of queries that any support reaches."""
    w = int(np.ceil(reach / BIN)) + 1
    cell = F.floor(F.col("bin") / w).cast("long")
    near = targets.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    met = near.join(moments.select("g", cell.alias("cell"), F.col("bin").alias("from"), "m"), ["g", "cell"])
    met = met.withColumn("j", (F.col("bin") - F.col("from")).cast("int")).where(F.abs("j") <= w).select("g", "bin", "j", "m")
    matrices = _transfer(w, cumulative)

    def turn(batches):
        for b in batches:
            if not b.num_rows:
                continue
            j, m = b.column(2).to_numpy() + w, b.column(3).flatten().to_numpy().reshape(b.num_rows, -1)
            c = np.concatenate([np.einsum("nk,nka->na", m[i : i + 1024], matrices[j[i : i + 1024]]) for i in range(0, len(j), 1024)])
            ends = pa.array(np.arange(0, c.size + 1, DEGREE + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(c.ravel()))], ["g", "bin", "c"])

    turned = met.mapInArrow(turn, "g int, bin long, c array<double>")
    return turned.groupBy("g", "bin").agg(F.array(*(F.sum(F.col("c")[a]) for a in range(DEGREE + 1))).alias("c"))


def _value():
    """The polynomial ``c`` at ``t``; 0 where there is none."""
    out = F.col("c")[DEGREE]
    for a in range(DEGREE - 1, -1, -1):
        out = out * F.col("t") + F.col("c")[a]
    return F.coalesce(out, F.lit(0.0))


def _weighted(support: DataFrame, value: str, weight: str | None) -> DataFrame:
    """s, w of the supports; those without a value or weight are left out."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return support.select(F.col(value).cast("double").alias("s"), w.alias("w")).where(F.col("s").isNotNull() & F.col("w").isNotNull())


def kernel_sums(
    queries: DataFrame, support: DataFrame, bandwidth: float, x: str = "x", s: str = "s", weight: str | None = None, cumulative: bool = False, name: str = "density"
) -> DataFrame:
    """``queries`` with the density of Gaussian kernels at the supports, or with
    its integral.  Without ``weight`` each support counts 1 / n.  Null queries
    give null; without supports all are 0."""
    held = _weighted(support, s, weight).withColumn("h", F.lit(float(bandwidth))).withColumn("g", F.lit(0))
    moments = _moments(_placed(held, "s"))
    asked = queries.withColumn("h", F.lit(float(bandwidth))).withColumn("g", F.lit(0))
    asked = _placed(asked.withColumn("at_x", F.col(x).cast("double")), "at_x")
    bins = asked.where(F.col("bin").isNotNull()).select("g", "bin").distinct()
    found = _polynomials(moments, bins, REACH, cumulative)
    share = F.lit(1.0)
    if weight is None:
        n = moments.agg(F.sum(F.col("m")[0])).first()[0] or 1.0
        share = F.lit(1 / n)
    out = asked.join(found, ["g", "bin"], "left")
    value = _value()
    if cumulative:
        left = _left_of(moments, bins)
        out = out.join(left, "bin", "left")
        value = value + F.coalesce("left", F.lit(0.0))
    else:
        value = value / F.lit(float(bandwidth))
    return out.select(*queries.columns, F.when(F.col("at_x").isNotNull(), value * share).alias(name))


def _left_of(moments: DataFrame, bins: DataFrame) -> DataFrame:
    """(bin, left): the weight of all supports beyond reach on the left of a bin."""
    from ..plans.ordering import running_sum

    w = int(np.ceil(REACH / BIN)) + 1
    sources = moments.select(F.col("bin").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("bin"), F.col("m")[0].alias("w"))
    targets = bins.select((F.col("bin") - w - 1).alias("at"), F.lit(1).alias("asks"), "bin", F.lit(0.0).alias("w"))
    sums = running_sum(sources.unionByName(targets), [F.col("at"), F.col("asks")], "w", "left")
    return sums.where(F.col("asks") == 1).select("bin", "left")


def likelihoods(support: DataFrame, test: DataFrame, widths: dict[int, np.ndarray], weighted: bool = False) -> dict[int, np.ndarray]:
    """-sum of ln density of the test values for each width of each group, all
    in one pass: ``support(grp, s, w)``, ``test(grp, x)``, ``widths[grp]``.  Not
    ``weighted``, weights are shared out evenly.  A test value that no support
    is near makes it infinite; one counts ``m`` times, if there is that column."""
    spark = support.sparkSession
    rows, at = [], {}
    for grp, hs in widths.items():
        for i, h in enumerate(hs):
            at[len(rows)] = grp, i
            rows.append((grp, len(rows), float(h)))
    table = F.broadcast(spark.createDataFrame(rows, "grp int, g int, h double"))
    moments = _moments(_placed(support.join(table, "grp"), "s"))
    asked = _placed(test.where(F.col("x").isNotNull()).join(table, "grp"), "x")
    found = _polynomials(moments, asked.select("g", "bin").distinct(), LIKELY, False)
    density = asked.join(found, ["g", "bin"], "left").select("g", (_value() / F.col("h")).alias("d"), (F.col("m") if "m" in test.columns else F.lit(1.0)).alias("m"))
    nll = density.groupBy("g").agg(F.sum(F.when(F.col("d") > 0, -F.log("d") * F.col("m")).otherwise(F.lit(float("inf")))).alias("v"), F.sum("m").alias("n"))
    size = {r["grp"]: r["n"] for r in support.groupBy("grp").agg(F.sum("w").alias("n")).collect()} if not weighted else {}
    out = {grp: np.zeros(len(hs)) for grp, hs in widths.items()}
    for r in nll.collect():
        grp, i = at[r["g"]]
        out[grp][i] = r["v"] + r["n"] * np.log(size.get(grp) or 1.0)
    return out


def zoom(costs, low: float, high: float, groups=(0,), points: int = 33, within: float = 5e-4) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(widths, costs), ascending, of each group: grids on a logarithmic scale,
    each around the best width of the one before, until they are that fine.
    ``costs`` scores all groups' widths at once."""
    bounds = {g: (np.log(low), np.log(high)) for g in groups}
    seen: dict[int, dict[float, float]] = {g: {} for g in groups}
    while True:
        grids = {g: np.exp(np.linspace(a, b, points)) for g, (a, b) in bounds.items()}
        got = costs(grids)
        for g, hs in grids.items():
            v = np.where(np.isfinite(got[g]), got[g], 1e12)
            seen[g].update(zip(hs.tolist(), v.tolist()))
            i = int(np.argmin(v))
            bounds[g] = np.log(hs[max(0, i - 1)]), np.log(hs[min(points - 1, i + 1)])
        if max(b - a for a, b in bounds.values()) < within:
            return {g: tuple(np.array(c) for c in zip(*sorted(seen[g].items()))) for g in groups}
