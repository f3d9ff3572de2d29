"""Sources and sinks of matrices.

A row matrix is a DataFrame ``row_id BIGINT, features ARRAY<DOUBLE>``; a
coordinate matrix is ``i INT, j INT, value DOUBLE``.  Rows carry explicit ids:
no operator relies on the order in which Spark holds them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_columns(df: DataFrame, cols: list[str], row_id: str) -> DataFrame:
    """Row matrix of named numeric columns; only these columns are read."""
    return df.select(F.col(row_id).cast("long").alias("row_id"), F.array(*(F.col(c).cast("double") for c in cols)).alias("features"))


def from_numpy(spark: SparkSession, a: np.ndarray) -> DataFrame:
    """Row matrix of a small array; row_id is the row number."""
    a = np.atleast_2d(np.asarray(a, float))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "row_id long, features array<double>")


def from_vector(df: DataFrame, column: str) -> DataFrame:
    """Array column -> one row per element (row_id, features of one entry)."""
    return df.select(F.posexplode(column).alias("row_id", "x")).select(F.col("row_id").cast("long").alias("row_id"), F.array(F.col("x").cast("double")).alias("features"))


def coo_from_numpy(spark: SparkSession, a: np.ndarray) -> DataFrame:
    a = np.atleast_2d(np.asarray(a, float))
    rows = [(i, j, float(v)) for i, r in enumerate(a) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "i int, j int, value double")


def to_coo(m: DataFrame) -> DataFrame:
    """Row matrix -> coordinates (i keeps the row id)."""
    return m.select(F.col("row_id").alias("i"), F.posexplode("features").alias("j", "value"))


def from_coo(coo: DataFrame) -> DataFrame:
    """Coordinates -> row matrix, entries of a row in column order."""
    return coo.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("c")).select(
        F.col("i").cast("long").alias("row_id"), F.transform("c", lambda x: x["value"]).alias("features")
    )


def to_numpy(m: DataFrame, limit: int = 20_000_000) -> np.ndarray:
    """A small row matrix in order of row id; refuses more than ``limit`` entries."""
    n = m.select(F.sum(F.size("features"))).first()[0] or 0
    if n > limit:
        raise ValueError(f"{n} entries don't fit the driver (limit {limit})")
    rows = m.orderBy("row_id").select("features").collect()
    return np.array([r[0] for r in rows], float)


def linspace_as_coded(spark: SparkSession, start: float, end: float, n: int) -> DataFrame:
    """i * (end - start) / n for i < n: the start is no offset and the end is left out."""
    step = (end - start) / n
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") * F.lit(step)).alias("x"))


def linspace(spark: SparkSession, start: float, end: float, n: int) -> DataFrame:
    """n evenly spaced values, both ends included."""
    step = (end - start) / max(1, n - 1)
    return spark.range(n).select(F.col("id").alias("row_id"), (F.lit(start) + F.col("id") * F.lit(step)).alias("x"))


#: rows that one generator draws
DRAWN = 1024


def drawn(ids: np.ndarray, seed: int, draw, block: int = DRAWN) -> np.ndarray:
    """What ``draw(rng, block)`` gives for ids: a generator for each (seed, block
    of ids), so values don't depend on how rows are partitioned."""
    out = []
    for b in np.unique(ids // block):
        out.append(draw(np.random.default_rng([seed, b]), block)[ids[ids // block == b] % block])
    return np.concatenate(out)


def _generated(spark: SparkSession, n_rows: int, n_cols: int, seed: int, draw) -> DataFrame:
    """Rows drawn by generators keyed by seed and block of row ids."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = drawn(b.column(0).to_numpy(), seed, lambda r, n: draw(r, (n, n_cols)), min(DRAWN, n_rows))
                ends = pa.array(np.arange(0, x.size + 1, n_cols, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["row_id", "features"])

    return spark.range(n_rows).mapInArrow(run, "row_id long, features array<double>")


def random_normal(spark: SparkSession, n_rows: int, n_cols: int, seed: int = 0) -> DataFrame:
    """Independent standard normal entries."""
    return _generated(spark, n_rows, n_cols, seed, lambda r, k: r.standard_normal(k))


def random_uniform(spark: SparkSession, n_rows: int, n_cols: int, lb: float = 0.0, ub: float = 1.0, seed: int = 0) -> DataFrame:
    """Independent uniform entries in [lb, ub)."""
    return _generated(spark, n_rows, n_cols, seed, lambda r, k: r.uniform(lb, ub, k))
