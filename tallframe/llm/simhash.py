"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is 1 if set in over half of the document's shingle hashes.
For radius r every bit position gets a random vector of r + 1 bits; the mask of
a non-zero vector v keeps the positions whose vector has odd inner product with
v.  The vectors of at most r differing positions leave some v orthogonal to all
of them, so every pair within the radius agrees on the bits of at least one of
the 2^(r+1) - 1 masks: no pair is missed.

Only distinct fingerprints are compared.  Buckets with more than ``HEAVY`` of
them are split again by covering masks over the bits still free, which keeps
the guarantee; within a task, bucket pairs are tested in vectorised strips and
only a spanning forest of the links is passed on.

Nulls count as empty texts; texts without words have fingerprint zero and link
like any other.  Rows with a null id get a fingerprint and the component of
their group (null if the group has no id).  Repeated rows stay repeated, an
empty table gives an empty result.  Very long texts are hashed whole, about
4 MB of texts at a time.  Only the key and text columns are read, so columns of
the table may have any other names, those of the result included.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import by_bytes
from .common import connected_components, materialize, whole_groups

RADIUS = 3
SEED = 42
HEAVY = 4096
#: bits set in each byte value, most significant first
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of a text: A-Z lower-cased, words between ASCII white
    space, XXH64 (seed 42) of blank-joined shingles with their repeats."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = words_per_shingle
    if len(words) <= n:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(n))))]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (unsigned)."""
    seen = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(seen[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """key, fp (the 64 bits as a signed long)."""

    def run(batches):
        for part, texts in by_bytes(batches, "text"):
            found = np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, fp long")


def covering_masks(positions: list[int], radius: int, seed: int) -> list[int]:
    """Masks over ``positions`` such that any ``radius`` of them are left out
    together by at least one mask."""
    vectors = np.random.default_rng(seed).integers(0, 2 ** (radius + 1), len(positions)).tolist()
    return [
        sum(1 << p for p, m in zip(positions, vectors) if (m & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def join_trees(label: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Join the trees of rows ``a[i]`` and ``b[i]`` in ``label`` (root of each
    row, updated in place); gives the row pairs that joined two trees."""
    while len(a):
        ra, rb = label[a], label[b]
        differ = ra != rb
        a, b, lo, hi = a[differ], b[differ], np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]
        if not len(a):
            return
        _, one = np.unique(hi, return_index=True)  # each root hangs below one other
        yield a[one], b[one]
        label[hi[one]] = lo[one]
        while (up := label[label] != label).any():
            label[up] = label[label[up]]


def _forest(bucket: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (fp, fp) within equal ``bucket`` runs.
    Pairs at distance 1, 2, ... in a run are tested as vectors; nothing
    quadratic is held."""
    label = np.arange(len(fps))
    step, live, out = 1, np.arange(len(fps)), []
    while True:
        live = live[live + step < len(fps)]
        live = live[bucket[live] == bucket[live + step]]
        if not len(live):
            break
        near = live[np.bitwise_count(fps[live] ^ fps[live + step]) <= radius]
        out += join_trees(label, near, near + step)
        step += 1
    a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.array([], np.int64),) * 2
    return fps[a], fps[b]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct fingerprints
    ``distinct(fp)`` that differ in 1 to ``radius`` bits.  Every pair given is a link."""
    spark = distinct.sparkSession

    def verify(batches):
        for t in whole_groups(batches, ["mask", "part"]):
            mask, part, fp = (t.column(c).to_numpy() for c in ("mask", "part", "fp"))
            new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])])
            a, b = _forest(np.cumsum(new), fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

    def verified(buckets: DataFrame) -> DataFrame:
        dealt = buckets.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
        return dealt.mapInArrow(verify, "a long, b long")

    everything = list(range(64))
    masks = covering_masks(everything, radius, SEED)
    children = F.array(*(F.lit(_signed(m)) for m in masks))
    buckets = distinct.select("fp", F.explode(children).alias("mask")).select("mask", F.expr("fp & mask").alias("part"), "fp")
    found = []
    while True:
        heavy = materialize(buckets.groupBy("mask", "part").count().where(F.col("count") > HEAVY).select("mask", "part"), "heavy")
        if not heavy.limit(1).count():
            found.append(verified(buckets))
            break
        found.append(verified(buckets.join(heavy, ["mask", "part"], "left_anti")))
        # what is in heavy buckets goes on, with masks that look at more bits; 16 free bits or
        # fewer make buckets of at most 65,536 members, which are verified as they are
        crowded = buckets.join(heavy, ["mask", "part"], "left_semi")
        free = {m: [i for i in everything if not m >> i & 1] for m in masks}
        small = [m for m in masks if len(free[m]) <= 16]
        if small:
            found.append(verified(crowded.where(F.col("mask").isin([_signed(m) for m in small]))))
        level = [(m, [m | x for x in covering_masks(free[m], radius, SEED)]) for m in masks if len(free[m]) > 16]
        if not level:
            break
        # a mask of 64 bits and its 15 children: some thousand rows at the deepest level
        table = spark.createDataFrame([(_signed(m), _signed(c)) for m, cs in level for c in cs], "mask long, child long")
        buckets = materialize(
            crowded.join(F.broadcast(table), "mask").select(F.col("child").alias("mask"), F.expr("fp & child").alias("part"), "fp").distinct(), "level"
        )
        masks = sorted({c for _, cs in level for c in cs})
    return reduce(DataFrame.unionByName, found)


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """key, fp, fingerprint (16 hex digits), component_id: the smallest key
    reachable by links between fingerprints, its own included."""
    fps = materialize(fingerprints(docs, key, text, words_per_shingle), "fps")
    groups = materialize(fps.groupBy("fp").agg(F.min("key").alias("least")), "groups")
    labels = connected_components(links(groups.select("fp"), radius))
    named = groups.join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_fp = materialize(named.join(least, "component").select("fp", "component_id"), "labels")
    return fps.join(per_fp, "fp").select(
        F.col("key").alias(key), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
