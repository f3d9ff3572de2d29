"""Token-id shards with a minimal perfect hash index.

A shard is one binary file: a header, the raw ids of its documents one after
the other (unsigned 16- or 32-bit little-endian, by the vocabulary's size), the
offsets of documents, an index and a footer.  It is written from front to back,
ids as they are made.  The index is a minimal perfect hash over the shard's distinct
keys (cascaded bit arrays: each level keeps the keys that fall alone on a bit;
the number of bits set before a key's bit is its place), with, per place, a
64-bit fingerprint of the key and the first document of that key.  A lookup
touches a fixed number of levels and one fingerprint, whatever the shard's
size; keys that were never stored are turned away by the fingerprint.

Documents stand in ascending key order across shards.  Every task writes its
shard under a name of its own and renames it at the end, so retried tasks
leave whole files only.

Nulls: a null text encodes as the empty one (its end id alone), a null key
sorts first and is looked up like any other.  Repeated keys keep all their
rows, next to each other in order of text digest.  Very long texts are encoded
whole.  An empty table gives no shards and an empty result.  Only the key and
text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkMemo, by_bytes, byte_chars, plain_pieces
from .common import materialize, new_path, open_folder

MAGIC = b"TFIDS002"
#: bits for each key at a level of the hash, bits of a block
GAMMA, BLOCK = 2, 512
#: bytes of text in a shard, about: at most, and at least where that leaves no core idle
SHARD_BYTES, SMALL_SHARD = 256_000_000, 8_000_000


def fingerprint(key, seed: int = 0) -> int:
    """64 bits of a key's text form; null has a form of its own."""
    form = b"\x00" if key is None else str(key).encode("utf-8", "surrogatepass") + b"\x01"
    return int.from_bytes(hashlib.blake2b(form, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """splitmix64 of the fingerprints, another stream for each level."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit fingerprints: bit arrays, level by
    level, with the number of bits set before each block of ``BLOCK`` bits."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.base = np.cumsum([0, *[int(b.sum()) for b in levels]])

    @classmethod
    def build(cls, prints: np.ndarray) -> PerfectHash:
        left = np.asarray(prints, np.uint64)
        if len(np.unique(left)) < len(left):
            raise ValueError("fingerprints must differ")
        levels = []
        while len(left):
            size = -(-max(8, GAMMA * len(left)) // BLOCK) * BLOCK
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def places(self, prints: np.ndarray) -> np.ndarray:
        """The place of each fingerprint; -1 if no level has it."""
        prints = np.asarray(prints, np.uint64)
        out = np.full(len(prints), -1, np.int64)
        todo = np.arange(len(prints))
        for n, bits in enumerate(self.levels):
            at = (_mix(prints[todo], n) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.base[n] + (np.cumsum(bits) - 1)[at[hit]]
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        """Blocks of all levels: bits set before the block (8 bytes), its bits."""
        bits = np.concatenate([np.zeros(0, bool), *self.levels]).reshape(-1, BLOCK)
        before = np.cumsum(bits.sum(1)) - bits.sum(1)
        return np.concatenate([before.astype("<u8")[:, None].view(np.uint8), np.packbits(bits, axis=1)], axis=1).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, sizes: list[int]) -> PerfectHash:
        bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 8 + BLOCK // 8)[:, 8:], axis=1).astype(bool).ravel()
        ends = np.cumsum([0, *sizes])
        return cls([bits[a:b] for a, b in zip(ends, ends[1:])])


class ShardWriter:
    """Writes a shard from front to back: ids as they come, the index at the end.
    Only keys and lengths are held."""

    def __init__(self, out, width: int = 2):
        self.out, self.kind, self.keys, self.lengths = out, "<u2" if width == 2 else "<u4", [], []
        out.write(struct.pack("<8sII", MAGIC, width, 0))

    def add(self, key, ids: np.ndarray) -> None:
        """The next document; equal keys come one after the other."""
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.out.write(np.asarray(ids).astype(self.kind).tobytes())

    def close(self) -> None:
        keys, n = self.keys, len(self.keys)
        offsets = np.concatenate([[0], np.cumsum(np.array(self.lengths, np.int64))]).astype("<u8")
        firsts = np.array([i for i in range(n) if not i or keys[i] != keys[i - 1] or (keys[i] is None) != (keys[i - 1] is None)], np.int64)
        for seed in range(100):  # the next seed where two keys meet in one fingerprint
            prints = np.array([fingerprint(keys[i], seed) for i in firsts], np.uint64)
            if len(np.unique(prints)) == len(prints):
                break
        index = PerfectHash.build(prints)
        place = index.places(prints)
        table = np.zeros((len(firsts), 3), "<u8")
        table[place, 0], table[place, 1], table[place, 2] = prints, firsts, np.diff(np.append(firsts, n))
        sizes = [len(b) for b in index.levels]
        self.out.write(offsets.tobytes() + table.tobytes() + index.to_bytes() + np.array(sizes, "<u8").tobytes())
        self.out.write(struct.pack("<QQQII8s", n, len(firsts), int(offsets[-1]), len(sizes), seed, MAGIC))
        self.out.close()


class Shard:
    """Keyed access to a shard file that can be read at any place.

    ``lookup`` reads a few fixed-size pieces whatever the shard's size: a block
    of the hash, a row of the table, two offsets, the ids.  ``find`` looks up
    many keys and loads hash and table for that, never the ids."""

    FOOT = struct.calcsize("<QQQII8s")

    def __init__(self, file):
        size = file.size()
        self.read = file.read_at  # (number of bytes, place)
        n_docs, self.n_keys, n_ids, n_levels, self.seed, magic = struct.unpack("<QQQII8s", self.read(self.FOOT, size - self.FOOT))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        _, width, _ = struct.unpack("<8sII", self.read(16, 0))
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.offsets_at = 16 + n_ids * width
        self.table_at = self.offsets_at + 8 * (n_docs + 1)
        self.hash_at = self.table_at + 24 * self.n_keys
        levels_at = size - self.FOOT - 8 * n_levels
        self.hash_bytes = levels_at - self.hash_at
        self.sizes = np.frombuffer(self.read(8 * n_levels, levels_at), "<u8").tolist()

    def lookup(self, key) -> list[np.ndarray]:
        """The ids of each document of a key; none if there is no such key."""
        p = fingerprint(key, self.seed)
        before = 0
        for n, size in enumerate(self.sizes):
            at = int(_mix(np.array([p], np.uint64), n)[0] % np.uint64(size)) + before
            block = self.read(8 + BLOCK // 8, self.hash_at + at // BLOCK * (8 + BLOCK // 8))
            bits = np.unpackbits(np.frombuffer(block, np.uint8, offset=8))
            if bits[at % BLOCK]:
                place = struct.unpack("<Q", block[:8])[0] + int(bits[: at % BLOCK].sum())
                stored, first, many = struct.unpack("<QQQ", self.read(24, self.table_at + 24 * place))
                return [x for _, x in self.documents(first, first + many)] if stored == p else []
            before += size
        return []

    def find(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key; (-1, 0) if absent."""
        index = PerfectHash.from_bytes(self.read(self.hash_bytes, self.hash_at), self.sizes)
        table = np.frombuffer(self.read(24 * self.n_keys, self.table_at), "<u8").reshape(-1, 3)
        prints = np.array([fingerprint(k, self.seed) for k in keys], np.uint64)
        place = index.places(prints)
        ok = place >= 0
        ok[ok] = table[place[ok], 0] == prints[ok]
        first, many = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[ok], many[ok] = table[place[ok], 1], table[place[ok], 2]
        return first, many

    def documents(self, start: int, end: int, window: int = 1 << 20):
        """(ids before it in the shard, ids) of documents in order, read
        ``window`` ids at a time (a longer document at once)."""
        while start < end:
            some = min(end, start + 65_536)
            at = np.frombuffer(self.read(8 * (some - start + 1), self.offsets_at + 8 * start), "<u8").astype(np.int64)
            i = 0
            while i < some - start:
                j = max(i + 1, int(np.searchsorted(at, at[i] + window, "right")) - 1)
                ids = np.frombuffer(self.read(int(at[j] - at[i]) * self.kind.itemsize, 16 + int(at[i]) * self.kind.itemsize), self.kind)
                for d in range(i, j):
                    yield int(at[d]), ids[at[d] - at[i] : at[d + 1] - at[i]]
                i = j
            start = some


class Encoder:
    """The tokenizers library with a memory of chunks.

    Its byte-level pre-tokenizer always starts a pre-token at a blank that a
    non-blank follows, so chunks cut there encode alike on their own.  New
    chunks go to the library's pre-tokenizer and BPE model; texts that hold an
    added token go to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.model, self.chars = self.lib.model, byte_chars()
        # only what works byte by byte may be cut at blanks
        self.cuts = self.lib.normalizer is None and "ByteLevel" in type(self.lib.pre_tokenizer).__name__
        self.memo = ChunkMemo(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        pieces = plain_pieces(chunk)
        if pieces is not None:
            pieces = ["".join(map(self.chars.__getitem__, p.encode())) for p in pieces]
        else:
            pieces = [p for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(chunk)]
        ids = [t.id for p in pieces for t in self.model.tokenize(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        ids = self.lib.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [self.memo.encode(t) if self.cuts and not any(a in t for a in self.added) else self._whole(t) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(
    docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 0, n_shards: int | None = None
) -> DataFrame:
    """Encode, order and write; returns the manifest (shard, file, key), one row
    per document, as a table in the shared folder.

    Rows are dealt by ranges of (key, text digest), so that a key with very many
    rows is spread over shards too.
    """
    spark = docs.sparkSession
    if n_shards is None:
        total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n_shards = max(1, -(-total // SHARD_BYTES), min(wide, -(-total // SMALL_SHARD)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        enc, writer, mine = encoder(path), None, None
        fs, base = open_folder(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}.ids"
        for part, texts in by_bytes(batches, "text"):
            if writer is None:
                fs.create_dir(base, recursive=True)
                mine = f"{base}/.{name}.{uuid.uuid4().hex}"
                writer = ShardWriter(fs.open_output_stream(mine), 2 if max(enc.lib.get_vocab_size(), end_id + 1) <= 65536 else 4)
            for k, x in zip(part.column(0).to_pylist(), enc.encode(texts)):
                writer.add(k, np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)))
        if writer is None:
            return
        writer.close()
        fs.move(mine, f"{base}/{name}")
        for at in range(0, len(writer.keys), 10_000):
            some = writer.keys[at : at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(some), pa.int32()), pa.array([name] * len(some)), pa.array(some, part.column(0).type)],
                ["shard", "file", "key"],
            )

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    dealt = rows.repartitionByRange(n_shards, F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("key").asc_nulls_first(), F.xxhash64("text")
    )
    return materialize(dealt.mapInArrow(run, f"shard int, file string, key {kind}"), "manifest")


def read_shards(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """key, shard, at (tokens before the document in its shard), n_tokens,
    ids_crc32, read back from the files through the index, for each distinct
    key of the manifest and all its documents."""
    kind = manifest.schema["key"].dataType.simpleString()

    def run(keys_: tuple, rows: pa.Table) -> pa.Table:
        shard, name = keys_[0].as_py(), keys_[1].as_py()
        fs, base = open_folder(folder)
        with fs.open_input_file(f"{base}/{name}") as f:
            s = Shard(f)
            keys = rows.column("key").to_pylist()
            first, many = s.find(keys)
            if (first < 0).any():
                raise LookupError(f"{name} lacks a key of its manifest")
            k, at, n, crc = [], [], [], []
            order = np.argsort(first)
            runs = np.flatnonzero(np.append(True, first[order][1:] != (first + many)[order][:-1])) if len(order) else []
            for i, j in zip(runs, [*runs[1:], len(order)]):  # neighbours are read together
                owner = [keys[x] for x in order[i:j] for _ in range(many[x])]
                a = int(first[order[i]])
                for key_, (before, ids) in zip(owner, s.documents(a, a + len(owner))):
                    k.append(key_)
                    at.append(before)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
        return pa.table(
            {
                "key": pa.array(k, rows.schema.field("key").type), "shard": pa.array([shard] * len(k), pa.int32()),
                "at": pa.array(at, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            }
        )

    # a number given here keeps small manifests of large files from meeting in a few tasks
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = manifest.select("shard", "file", "key").distinct().repartition(n, "shard", "file")
    out = distinct.groupBy("shard", "file").applyInArrow(
        run, f"key {kind}, shard int, at long, n_tokens long, ids_crc32 long"
    )
    return out.withColumnRenamed("key", key)


def token_positions(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, n_tokens, ids_crc32 (and shard), all read back from files
    written for ``docs``.  Shard totals, one row per shard, give each shard's
    first position."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    manifest = write_shards(docs, path, folder, key, text)
    back = materialize(read_shards(manifest, folder, key), "read")
    totals = sorted((r[0], r[1]) for r in back.groupBy("shard").agg(F.sum("n_tokens")).collect())
    starts, total = [], 0
    for shard, n in totals:
        starts.append((shard, total))
        total += n
    base = spark.createDataFrame(starts, "shard int, base long")
    return back.join(F.broadcast(base), "shard").select(
        key, (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard"
    )
