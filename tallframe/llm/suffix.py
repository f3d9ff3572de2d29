"""Exact removal of repeated byte strings with sharded suffix arrays.

Every byte that a ``LENGTH``-byte string covers goes if that string also starts
anywhere else in the corpus.  The suffix array that tells is built in shards:

1.  Each start of a ``LENGTH``-byte string is owned by one anchor, the
    ``GRAM``-byte string with the least hash inside it (leftmost on ties), so
    equal strings have equal anchors.  Anchors are about one in 80 bytes;
    their hashes are counted over all rows.
2.  Anchors that occur once own no repeats.  For the others the stretch of
    text they own goes to the shard of the anchor's hash.  Which hashes occur
    again is told by a bit map of fixed size (16 MB); a false positive
    only adds work.
    An anchor that occurs more than ``HOT`` times (at the edge of a passage that
    very many texts embed) owns a different stretch in each of them; its
    stretches are cut into their single ``LENGTH``-byte strings, and these go to
    the shards of their own bytes.
3.  In a shard, whole anchors are put together in blocks of bounded size, the
    suffix array of a block is built by induced sorting (``sais``), permuted
    common prefixes are computed, and runs of equal ``LENGTH``-byte prefixes
    that occur twice or more mark the repeated starts.
4.  Marks go back to the texts by the stretch's digest; covered bytes are
    joined into spans.

Equal texts are counted by digest beside this: they lend each other all their
bytes, and are worked on once for each task.  Stretches with the same bytes
are sent once for each task with a count, so a hot passage costs little.

Nulls and empty texts have no bytes and keep none.  Texts shorter than
``LENGTH`` lose nothing.  Repeated rows are copies of each other (removed
whole if long enough); a null key is carried through.  Very long texts are cut
into overlapping pieces for the search alone.  An empty table gives an empty
result.  Only key and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import by_bytes
from .common import bit_map, in_bit_map, materialize
from .sais import permuted_lcp, suffix_array

LENGTH = 200
GRAM = 40
#: bytes of a suffix array block, about
BLOCK = 3_000_000
#: times that an anchor may occur before its stretches are cut into single strings
HOT = 20_000
#: bytes that are looked at together when anchors are chosen; their hashes stay in a core's cache
CHUNK = 1 << 16
_RND = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.random.default_rng(21).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POS = np.uint64((1 << 20) - 1)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` (40) bytes at each position, by doubling."""
    h = _RND[b]
    for n, width in enumerate((1, 2, 4, 8, 16)):
        left = h[:-width] * _MUL[n]
        left += h[width:]
        h = left
        if width == 4:
            eight = h
    left = h[:-8] * _MUL[5]
    left += eight[32 : 32 + len(left)]
    left ^= left >> np.uint64(29)
    left *= _MUL[6]
    left ^= left >> np.uint64(32)
    return left


def anchors(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the part, first start owned, last start owned, hash) of the
    anchors of byte strings that together are shorter than 2^20 bytes."""
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    if len(data) < LENGTH:
        return (np.array([], np.int64),) * 3 + (np.array([], np.uint64),)
    h = _gram_hashes(data)
    low = h & ~_POS
    low |= np.arange(len(h), dtype=np.uint64)
    width, want = 1, LENGTH - GRAM + 1
    while 2 * width <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < want:
        low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
    chosen = (low & _POS).astype(np.int64)
    # starts from which on an anchor owns, or a part begins; a part's last starts own nothing
    new = np.concatenate([[True], chosen[1:] != chosen[:-1]])
    begins = ends - np.array([len(p) for p in parts])
    new[begins[begins < len(new)]] = True
    new = np.flatnonzero(new)
    part = np.searchsorted(ends, new, side="right")
    last = np.minimum(np.append(new[1:], len(chosen)) - 1, ends[part] - LENGTH)
    ok = new <= last
    new, last, part = new[ok], last[ok], part[ok]
    return part, new - begins[part], last - begins[part], h[chosen[new]]


def _pieces(texts: list[bytes]):
    """(index of the text, offset, bytes): whole texts, long ones in parts that
    overlap so that each start is in exactly one part."""
    for n, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), CHUNK):
            yield n, at, t[at : at + CHUNK + LENGTH - 1]


def all_anchors(texts: list[bytes]):
    """(text index, first start, last start, hash) arrays, a chunk at a time.

    Parts of a long text choose their anchors apart: a start near a cut may
    have an anchor of its own choice, but the choice only looks at the start's
    own ``LENGTH`` bytes, so equal strings still meet."""
    held, size = [], 0
    pieces = [p for p in _pieces(texts) if len(p[2]) >= LENGTH]
    for i, p in enumerate(pieces):
        held.append(p)
        size += len(p[2])
        if size >= CHUNK or i == len(pieces) - 1:
            part, a, b, h = anchors([x[2] for x in held])
            owner, off = np.array([x[0] for x in held]), np.array([x[1] for x in held])
            yield owner[part], a + off[part], b + off[part], h
            held, size = [], 0


class _Once:
    """Texts that a task hasn't met yet; forgets (harmlessly) when full."""

    def __init__(self):
        self.seen = set()

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            b = t.encode("utf-8", "surrogatepass")
            d = hashlib.md5(b).digest()
            if len(b) >= LENGTH and d not in self.seen:
                if len(self.seen) > 200_000:
                    self.seen.clear()
                self.seen.add(d)
                out.append(b)
        return out


def repeated_runs(stretches: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts (relative, all but the last ``LENGTH`` - 1 bytes own one)
    whose string occurs at another start too; ``counts`` say how often a stretch
    itself occurs.  Returns the stretches that have any, the offsets of their
    runs, and the runs as flat [first, last, first, last, ...]."""
    lengths = np.array([len(s) for s in stretches])
    data = np.frombuffer(b"\0".join(stretches) + b"\0", np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    text = data.astype(np.uint16) + 1
    text[ends] = 0
    room = np.repeat(ends, lengths + 1) - np.arange(len(data))
    sa = suffix_array(text)
    # positions without LENGTH bytes left lie between longer ones only with a smaller prefix in common
    lcp = permuted_lcp(data, sa, room, LENGTH, least=LENGTH)
    own = sa[(room >= LENGTH)[sa]]
    group = np.cumsum(lcp[own] < LENGTH)
    weight = np.bincount(group, counts[np.searchsorted(ends, own)])
    hit = np.sort(own[weight[group] >= 2])
    # stretches lie apart by the bytes that own no start
    new = np.concatenate([[True], hit[1:] > hit[:-1] + 1])[: len(hit)]
    first, last = hit[new], hit[np.append(new[1:], True)[: len(hit)]]
    owner = np.searchsorted(ends, first)
    runs = np.stack([first, last], 1) - (ends - lengths)[owner][:, None]
    which, at = np.unique(owner, return_index=True)
    return which, 2 * np.append(at, len(owner)), runs.ravel()


def _maps(hashes: DataFrame) -> tuple[bytes, bytes | None]:
    """Bit maps of the hashes that occur twice or more, and of those that occur
    more than ``HOT`` times (None if there are none).  Anything else that a full
    map lets through is worked on needlessly or in smaller pieces."""
    counts = materialize(hashes.groupBy("h").count().where("count > 1"), "anchors")
    hot = counts.where(F.col("count") > HOT).select("h")
    return bit_map(counts.select("h")), bit_map(hot) if hot.limit(1).count() else None


def _owned(data: list[bytes], maps: tuple[bytes, bytes | None]):
    """(text index, first start, last start, shard) of what repeated anchors own:
    whole stretches, or single strings under an anchor of the second map."""
    bits = np.frombuffer(maps[0], np.uint8)
    hot_bits = np.frombuffer(maps[1], np.uint8) if maps[1] else None
    for owner, a, b, h in all_anchors(data):
        ok = in_bit_map(bits, h)
        owner, a, b, h = owner[ok], a[ok], b[ok], h[ok]
        hot = in_bit_map(hot_bits, h) if hot_bits is not None else np.zeros(len(h), bool)
        out = [x[~hot].tolist() for x in (owner, a, b, h.view(np.int64))]
        for o, x, y in zip(owner[hot].tolist(), a[hot].tolist(), b[hot].tolist()):
            for i in range(x, y + 1):
                shard = int.from_bytes(hashlib.blake2b(data[o][i : i + LENGTH], digest_size=8).digest(), "little", signed=True)
                for column, v in zip(out, (o, i, i, shard)):
                    column.append(v)
        yield out


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """tk (MD5 of a distinct text), runs (array of [first, last] flat starts
    whose LENGTH-byte string occurs elsewhere), for texts that have any."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"))

    def hashes(batches):
        new = _Once()
        for _, texts in by_bytes(batches, "text"):
            for _, _, _, h in all_anchors(new(texts)):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    shared = spark.sparkContext.broadcast(_maps(rows.mapInArrow(hashes, "h long")))

    def stretches(batches):
        """(h, stretch, n) of repeated anchors, equal ones of a task together."""
        new, held, size = _Once(), {}, 0

        def out():
            keys = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), pa.array(list(held.values()), pa.int64())],
                ["h", "stretch", "n"],
            )

        for _, texts in by_bytes(batches, "text"):
            data = new(texts)
            for owned in _owned(data, shared.value):
                for o, x, y, z in zip(*owned):
                    k = (z, data[o][x : y + LENGTH])
                    if k in held:
                        held[k] += 1
                    else:
                        held[k] = 1
                        size += len(k[1])
                if size > 24_000_000:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    def marks(batches):
        """(digest of a stretch, runs) of blocks of whole anchors."""
        merged: dict[bytes, int] = {}
        size, last = 0, None

        def out():
            keys = list(merged)
            which, offsets, runs = repeated_runs(keys, np.array(list(merged.values())))
            digests = pa.array([hashlib.md5(keys[i]).digest() for i in which.tolist()], pa.binary())
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(runs, pa.int32()))
            return pa.RecordBatch.from_arrays([digests, runs], ["digest", "runs"])

        for batch in batches:
            h, stretch, n = (batch.column(i).to_pylist() for i in range(3))
            for k, s, m in zip(h, stretch, n):
                if k != last and size >= BLOCK:
                    yield out()
                    merged, size = {}, 0
                last = k
                if s in merged:
                    merged[s] += m
                else:
                    merged[s] = m
                    size += len(s)
        if merged:
            yield out()

    def places(batches):
        """(tk, digest of the stretch, offset) of repeated anchors."""
        new = _Once()
        for _, texts in by_bytes(batches, "text"):
            data = new(texts)
            tks = [hashlib.md5(d).digest() for d in data]
            for owned in _owned(data, shared.value):
                got = list(zip(*owned[:3]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tks[o] for o, _, _ in got], pa.binary()),
                        pa.array([hashlib.md5(data[o][x : y + LENGTH]).digest() for o, x, y in got], pa.binary()),
                        pa.array([x for _, x, _ in got], pa.int32()),
                    ],
                    ["tk", "digest", "at"],
                )

    sent = rows.mapInArrow(stretches, "h long, stretch binary, n long").repartition("h").sortWithinPartitions("h")
    marked = materialize(sent.mapInArrow(marks, "digest binary, runs array<int>"), "marks")
    found = rows.mapInArrow(places, "tk binary, digest binary, at int").join(marked, "digest")
    moved = found.select("tk", F.transform("runs", lambda x: x + F.col("at")).alias("runs"))
    return moved.groupBy("tk").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def _removed(runs: list[int], n: int) -> list[tuple[int, int]]:
    """Maximal (start, end) runs of bytes covered by the repeated starts."""
    out: list[list[int]] = []
    for a, b in sorted(zip(runs[::2], runs[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + LENGTH)
        else:
            out.append([a, b + LENGTH])
    return [(a, min(b, n)) for a, b in out]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes
    that stay, with ``with_text``)."""
    digest = F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), digest.alias("tk"))
    copies = rows.groupBy("tk").agg(F.count("*").alias("n")).where("n > 1").select("tk", F.lit(True).alias("copied"))
    facts = spans(docs, text).join(copies, "tk", "full")

    def apply(batches):
        sha = hashlib.sha256
        for part, texts in by_bytes(batches, "text"):
            cols = []
            for t, runs, copied in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                b = t.encode("utf-8", "surrogatepass")
                gone = [(0, len(b))] if copied and len(b) >= LENGTH else _removed(runs or [], len(b))
                at, kept = 0, []
                for s, e in gone:
                    kept.append(b[at:s])
                    at = e
                left = b"".join([*kept, b[at:]])
                cols.append((len(b), len(b) - len(left), len(gone), sha(left).hexdigest(), left))
            n, r, s, k, left = zip(*cols) if cols else [()] * 5
            arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(k, pa.string())]
            names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(left, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[key].dataType.simpleString()
    joined = rows.join(facts, "tk", "left").select("key", "text", "runs", "copied")
    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return joined.mapInArrow(apply, schema).withColumnRenamed("key", key)
