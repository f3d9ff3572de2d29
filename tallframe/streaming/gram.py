"""Streaming sufficient statistics: windowed counts, means and co-moments.

An extension: sums merge, so correlation, covariance and regression can follow
a stream.  Late rows are dropped after the watermark by Spark itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_gram(stream: DataFrame, cols: list[str], time: str, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """window_start, n, mean_<c>, cov_<a>_<b> per tumbling window."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return (
        stream.withWatermark(time, watermark)
        .groupBy(F.window(time, window))
        .agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in cols), *(F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs))
        .select(F.col("window.start").alias("window_start"), "n", *(f"mean_{c}" for c in cols), *(f"cov_{a}_{b}" for a, b in pairs))
    )
