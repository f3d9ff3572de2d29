"""Global ranks, running sums and ranked values without a one-task window.

Rows go through one range exchange and are stored in order; what a partition
has to know of those before it is one number, so the driver adds up one number
for each partition and sends them back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored

#: rows that are sorted by one task when a single value is looked for
SMALL = 200_000
#: Spark's row ids: the partition above, the row within it below
WITHIN = 33


def _starts(parts: DataFrame, kind: str) -> DataFrame:
    """(part, start): what the partitions before hold, from (part, held)."""
    rows = sorted(map(tuple, parts.collect()))
    ends = np.cumsum([0, *(r[1] for r in rows)])
    return parts.sparkSession.createDataFrame([(r[0], s.item()) for r, s in zip(rows, ends)], f"part long, start {kind}")


def global_rank(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` with its 0-based position in ascending order of ``keys``, which
    must tell rows apart; a number that is to descend is given negated.

    Ranges are cut by all keys together, so rows with one value of the first
    key spread over ranges too.  Each task numbers its rows as they come out of
    its sort; the sizes of the ranges before are added."""
    at = f"{name}__at"
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    rows = stored(ranged, "ranked")
    part = F.shiftright(at, WITHIN)
    starts = _starts(rows.groupBy(part.alias("part")).count(), "long").withColumnsRenamed({"part": f"{name}__part", "start": f"{name}__start"})
    within = F.col(at).bitwiseAND((1 << WITHIN) - 1)
    joined = rows.join(F.broadcast(starts), part == F.col(f"{name}__part"))
    return joined.withColumn(name, F.col(f"{name}__start") + within).drop(at, f"{name}__part", f"{name}__start")


def running_sum(df: DataFrame, keys: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of a number over all rows up to and including it, in
    ascending order of ``keys``; of rows with equal keys any may come first."""
    at = df.columns.index(value)

    def add_up(batches):
        from pyspark import TaskContext

        total, part = 0.0, TaskContext.get().partitionId()
        for b in batches:
            sums = total + np.cumsum(b.column(at).to_numpy(zero_copy_only=False).astype(float))
            total = sums[-1] if len(sums) else total
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums), pa.array(np.full(n, part))], [*b.schema.names, name, f"{name}__in"])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType()), T.StructField(f"{name}__in", T.LongType())])
    rows = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(add_up, schema), "sums")
    starts = _starts(rows.groupBy(f"{name}__in").agg(F.sum(value).cast("double")), "double")
    starts = starts.withColumnsRenamed({"part": f"{name}__in", "start": f"{name}__start"})
    joined = rows.join(F.broadcast(starts), f"{name}__in")
    return joined.withColumn(name, F.col(name) + F.col(f"{name}__start")).drop(f"{name}__in", f"{name}__start")


def value_at(df: DataFrame, column: str, rank: int):
    """The value at a 0-based rank of a numeric column: the range that holds it
    is narrowed by quantiles until few rows are left, which alone are sorted."""
    x, below = F.col(column), 0
    rows = df.select(x).where(x.isNotNull())
    while True:
        n = rows.count()
        if n <= SMALL:
            return rows.orderBy(x).offset(rank - below).first()[0]
        at = (rank - below) / n
        lo, hi = rows.agg(F.percentile_approx(x, [max(0.0, at - 0.01), min(1.0, at + 0.01)], 10_000)).first()[0]
        less, least, most = rows.agg(F.count_if(x < lo), F.count_if(x <= lo), F.count_if(x <= hi)).first()
        if below + less <= rank < below + least:
            return lo
        if not below + least <= rank < below + most:
            raise ValueError("the quantiles do not hold the rank")
        rows, below = rows.where((x > lo) & (x <= hi)), below + least
        if most - least == n:
            return rows.orderBy(x).offset(rank - below).first()[0]
