"""Sharding by fixed virtual slots.

Every record hashes into one of ``SLOTS`` virtual slots; bytes are aggregated
per slot, and a stored, versioned map (``SlotMap``) sends slots to shards.
Growing edits the map: the new shard takes an equal share of slots from the
shards that hold most, no slot moves between old shards.  The law is ``key``:
the document id and the number of shards decide, so growth goes by slot numbers;
``SlotMap.rebalance`` is the edit by bytes, for those who may give up that law.

Nulls: a null id hashes like any fixed key (all null ids share a slot), a null
text counts no bytes (size 1, crc 0).  An empty table gives an empty result
and a map with zero bytes.  Repeated rows each keep a row and a position of
their own.  Very long texts count whole.  Other columns of the table are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, new_path

SLOTS = 4096
#: Parts of a slot, by text: rows of one hot key spread over so many tasks.
SALTS = 16
#: copies of a record that one task lays out
REPEAT = 10_000


def grow(owner: list[int]) -> list[int]:
    """A map edited for one more shard: the newcomer takes the highest-numbered
    slots of whichever shard holds most until it has its share."""
    owner, new = list(owner), max(owner) + 1
    held: dict[int, list[int]] = {s: [] for s in range(new)}
    for slot, s in enumerate(owner):
        held[s].append(slot)
    for _ in range(len(owner) // (new + 1)):
        giver = max(range(new), key=lambda s: (len(held[s]), -s))
        owner[held[giver].pop()] = new
    return owner


def slot_map(n_shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot for ``n_shards`` shards, reached by adding one shard
    at a time to a single one."""
    owner = [0] * slots
    for _ in range(1, n_shards):
        owner = grow(owner)
    return owner


def virtual_slot(key: str = "doc_id", slots: int = SLOTS):
    """The slot of a record, from its key alone."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(slots)).cast("int")


def slot_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(vslot, salt, n_rows, n_bytes): the records of each slot in parts by
    text, what a map's versions are weighed by and positions are counted from."""
    return _records(docs, key, text).groupBy("vslot", "salt").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


class SlotMap:
    """The stored map: a Parquet table (version, vslot, shard, n_bytes), one
    partition for each version, never changed in place.  ``n_bytes`` are the
    bytes that the slot had when the version was written."""

    SCHEMA = "vslot int, shard int, n_bytes long"

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path, slots

    def _write(self, version: int, owner: list[int], n_bytes: dict[int, int]) -> None:
        rows = [(s, o, n_bytes.get(s, 0)) for s, o in enumerate(owner)]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.parquet(f"{self.path}/version={version}")

    def create(self, n_shards: int, n_bytes: dict[int, int] | None = None) -> None:
        """Version 1."""
        self._write(1, slot_map(n_shards, self.slots), n_bytes or {})

    def table(self, version: int) -> DataFrame:
        """(vslot, shard, n_bytes) of a version, a fixed number of rows."""
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/version={version}")

    def owners(self, version: int) -> tuple[list[int], dict[int, int]]:
        owner, n_bytes = [0] * self.slots, {}
        for r in self.table(version).collect():
            owner[r["vslot"]], n_bytes[r["vslot"]] = r["shard"], r["n_bytes"]
        return owner, n_bytes

    def add_shard(self, version: int) -> int:
        """A new version with one more shard, which takes slots from the others
        by their numbers alone (law ``key``); gives its number."""
        owner, n_bytes = self.owners(version)
        self._write(version + 1, grow(owner), n_bytes)
        return version + 1

    def rebalance(self, version: int, tolerance: float = 0.02) -> int:
        """A new version whose shards hold near equal bytes; gives its number."""
        owner, n_bytes = self.owners(version)
        self._write(version + 1, rebalance(owner, n_bytes, max(owner) + 1, tolerance), n_bytes)
        return version + 1


def rebalance(owner: list[int], n_bytes: dict[int, int], n_shards: int, tolerance: float = 0.02) -> list[int]:
    """A new version of a map: moves slots from the fullest to the emptiest
    shard, largest fitting slot first, until shard sizes are within
    ``tolerance`` of the mean or no move helps.  Works on slot totals only."""
    owner = list(owner)
    load = [0] * n_shards
    for s, o in enumerate(owner):
        load[o] += n_bytes.get(s, 0)
    mean = sum(load) / n_shards
    while True:
        hi, lo = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[hi] - load[lo]
        fits = [s for s, o in enumerate(owner) if o == hi and 0 < n_bytes.get(s, 0) < gap]
        if gap <= tolerance * mean or not fits:
            return owner
        s = min(fits, key=lambda x: abs(n_bytes[x] - gap / 2))
        owner[s] = lo
        load[hi] -= n_bytes[s]
        load[lo] += n_bytes[s]


def _records(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.encode(F.col(text), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        virtual_slot(key).alias("vslot"),
    ).withColumn("salt", F.pmod(F.hash("text_crc32", "size"), F.lit(SALTS)))


def assign(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (position in the shard,
    gapless from 0), grown_shard, vslot.

    Bytes are aggregated per slot and stored with version 1 of the map below
    ``path`` (in the shared folder, if not given); version 2, with one more
    shard, is an edit of what version 1 reads back.  Both are read from there.

    Positions need no ordering of a whole shard in one task: distinct records
    are numbered within (virtual slot, part) by sums of how often they occur, and
    each part starts where the counts of the earlier ones end.  The counts are
    at most SLOTS x SALTS rows, a fixed bound, and are broadcast.  Records that
    repeat are counted before they are shuffled, and laid out again at the end,
    very frequent ones by several tasks.
    """
    spark = docs.sparkSession
    rows = _records(docs, key, text)
    counts = materialize(slot_sizes(docs, key, text), "slots")
    n_bytes = {r[0]: r[1] for r in counts.groupBy("vslot").agg(F.sum("n_bytes")).collect()}
    store = SlotMap(spark, path or new_path(spark, "slot-map"))
    store.create(n_shards, n_bytes)
    version = store.add_shard(1)
    old, grown = store.table(1).select("vslot", "shard"), store.table(version).select("vslot", F.col("shard").alias("grown_shard"))
    before = W.partitionBy("shard").orderBy("vslot", "salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.join(F.broadcast(old), "vslot").select(
        "vslot", "salt", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start")
    ).join(F.broadcast(grown), "vslot")
    within = W.partitionBy("vslot", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    once = rows.groupBy("doc_id", "size", "text_crc32", "vslot", "salt").agg(F.count("*").alias("n"))
    placed = once.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(starts), ["vslot", "salt"])
    placed = placed.withColumn("first", F.explode(F.expr(f"sequence(0L, n - 1, {REPEAT}L)")))
    few, many = placed.where(F.col("n") <= REPEAT), placed.where(F.col("n") > REPEAT).repartition("doc_id", "first")
    each = few.unionByName(many).withColumn("nth", F.explode(F.expr(f"sequence(first, least(first + {REPEAT}L, n) - 1)")))
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("at") + F.col("nth")).cast("long").alias("slot"), "grown_shard", "vslot",
    )
