"""Shared helpers of the training-data operators: scratch space, edges, components.

Scratch data goes only to the folder named in ``spark.checkpoint.dir``, or, where
that is unset, below the warehouse, which executors share too.
"""

from __future__ import annotations

import atexit
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove as remove_path
from ..sources.scratch import shared_dir

#: bits of a bit map: 16 MB at any corpus size
MAP_BITS = 27


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def open_folder(base: str):
    """Arrow filesystem and path of a folder given as a path or URI, for files
    that tasks write or read themselves."""
    import pyarrow.fs as pafs

    if urlparse(base).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(base).path
    return pafs.FileSystem.from_uri(base)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: cuts lineage
    in a way that survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing will read again."""
    remove_path(table.sparkSession, table._scratch)


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let Arrow batches to Python workers hold about ``size`` at most: Spark's
    own bound is 64 MB, which each task holds several times over.  A bound that
    the session sets itself stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == f"{64 << 20}b":
        spark.conf.set(name, size)


def tidy() -> None:
    """Give memory that a finished task has freed back to the system: Python
    workers live on, and several wait beside the ones that work."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def whole_groups(batches, keys: list[str], rows: int = 50_000):
    """Tables of about ``rows`` rows that never cut a group of equal ``keys``;
    the batches come in order of the keys.  Holds that many rows and one group."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        other = np.zeros(n, bool)
        for k in keys:
            column = t.column(k).to_numpy()
            other |= column != column[-1]
        cut = int(other.nonzero()[0][-1]) + 1 if other.any() else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
        held, n = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable from each id that has an edge.

    Alternating large-star and small-star rounds over ``edges(a, b)`` (any
    ordered type; self-loops, repeats and nulls are ignored).  Each round is
    written to the shared folder.  Minima are pre-aggregated before the
    shuffle and brought back by a join that AQE may split, so one vertex with
    very many neighbours doesn't land in one task.
    """
    a, b = F.col("a"), F.col("b")
    kind = edges.schema["a"].dataType
    e = (
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )
    e = materialize(e, "cc")
    seen = None
    while True:
        # a < b in every row
        both = e.unionByName(e.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(b > a).select(F.col("m").alias("a"), "b").where(a < b).distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select("m", F.explode(F.array("a", "b")).alias("b"))
        e = materialize(small.select(F.col("m").alias("a"), "b").where(a < b).distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    roots = e.select(F.col("a").alias("id"), F.col("a").alias("component"))
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(roots).distinct().select(
        F.col("id").cast(kind).alias("id"), F.col("component").cast(kind).alias("component")
    )


def bit_map(hashes: DataFrame) -> bytes:
    """Fixed-size bit map of the low bits of ``hashes(h)``, built in 4,096 pieces
    by the executors.  It never misses a hash; a full map lets all through."""
    import pyarrow as pa

    inner = 1 << (MAP_BITS - 12)

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy()
            order = np.argsort(at, kind="stable")
            piece, low = at[order] >> (MAP_BITS - 12), at[order] & (inner - 1)
            cut = np.flatnonzero(np.diff(piece, prepend=-1)) if len(at) else []
            for i, j in zip(cut, [*cut[1:], len(at)]):
                held.setdefault(int(piece[i]), np.zeros(inner, bool))[low[i:j]] = True
        keys = sorted(held)
        bits = pa.array([np.packbits(held[k]).tobytes() for k in keys], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), bits], ["piece", "bits"])

    at = hashes.select(F.expr(f"h & {(1 << MAP_BITS) - 1}").alias("at"))
    dealt = at.distinct().repartition(F.shiftright("at", MAP_BITS - 12))
    out = np.zeros((4096, inner // 8), np.uint8)
    for r in dealt.mapInArrow(fill, "piece int, bits binary").collect():
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def in_bit_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash (unsigned) may be in the map."""
    at = (h & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def mark_hits(df: DataFrame, hash_column: str, bits: bytes, flag: str) -> DataFrame:
    """``df`` with a boolean column: whether its hash may be in the map.  Rows
    pass through Arrow without being unpacked."""
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast(bits)
    at = df.columns.index(hash_column)

    def run(batches):
        table = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            hit = in_bit_map(table, b.column(at).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], [*b.schema.names, flag])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(flag, T.BooleanType())]))
