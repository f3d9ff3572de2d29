"""Byte-level BPE with a sentencepiece model made directly from a rank file.

The model is serialised here, field by field, from the vocabulary: every token
becomes a piece of byte-mapped characters scored by its negative rank, the
normalisation is the identity, no dummy prefix is added and blanks are kept.
Pre-tokens are encoded one by one (merges never cross them); decoding inverts
the byte mapping.

Nulls encode as the empty text.  An empty text has no ids, and the digests of
no bytes.  Texts are encoded whole, whatever their length; repeated rows give
repeated results.  An empty table gives an empty result.  Only the key and text
columns are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: A blank before a character that isn't white space always starts a pre-token,
#: so texts may be cut there and each chunk be looked up on its own.
LOOSE_BLANK = re.compile(r" (?!\S)")
CUT = re.compile(r" (?=\S)")
#: Marks that are neither letter, number, white space nor part of a contraction.
MARKS = frozenset(".,;:!?()-")
#: Entries that a worker remembers before it starts afresh; bounds its memory.
MEMO = 600_000
#: Signs of the longest chunk that is remembered, and signs and bytes of all together.
KEPT, MEMO_BYTES = 4096, 60_000_000


def byte_chars() -> list[str]:
    """One printable character per byte: printable Latin-1 maps to itself, the
    rest to consecutive characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in plain}
    out |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in out)}
    return [out[b] for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 and rank in each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value) -> bytes:
    """A protobuf field: bytes length-delimited, float as fixed32, else varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: <unk> is id 0, rank r is id r + 1
    in order of rank."""
    chars = byte_chars()
    unk, normal, bpe = 2, 1, 2
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unk))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(map(chars.__getitem__, token)).encode()
        out.append(_field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, normal)))
    trainer = _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, 0) + _field(24, 0)
    trainer += b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # no bos, eos, pad: -1
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def plain_pieces(chunk: str) -> list[str] | None:
    """The pre-tokens of the commonest chunks, letters with at most one mark
    after them, told without the pattern; None for any other chunk."""
    word = chunk[1:] if chunk[:1] == " " else chunk
    if word.isalpha():
        return [chunk]
    if word[-1:] in MARKS and word[:-1].isalpha():
        return [chunk[:-1], word[-1]]
    return None


class ChunkMemo(dict):
    """Chunk -> ids (little-endian unsigned 32-bit), learned on first use.

    Keys are chunks without their leading blank; ``head`` holds those that have
    none.  Chunks over ``KEPT`` signs aren't kept, and a full memory is emptied,
    which bounds its bytes and costs time but no result.
    """

    def __init__(self, encode, limit: int = MEMO):
        self.encode_chunk, self.limit, self.head, self.marks = encode, limit, {}, {}
        self.used = 0

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit or self.used >= MEMO_BYTES:
            self.clear()
            self.used = 0
        if word[-1:] in MARKS and word[:-1].isalpha():  # two pre-tokens; the first is often known
            out = self[word[:-1]] + self.mark(word[-1])
        else:
            out = self.encode_chunk(" " + word)
        if len(word) <= KEPT:
            self.used += len(word) + len(out)
            self[word] = out
        return out

    def mark(self, mark: str) -> bytes:
        """Ids of a mark that follows letters."""
        if mark not in self.marks:
            self.marks[mark] = self.encode_chunk(mark)
        return self.marks[mark]

    def encode(self, text: str) -> bytes:
        """Ids of a text, chunk by chunk."""
        first, *rest = text.split(" ") if LOOSE_BLANK.search(text) is None else CUT.split(text)
        if len(first) > 64:
            return self.encode_chunk(first) + b"".join(map(self.__getitem__, rest))
        if first not in self.head:
            if len(self.head) >= self.limit // 8:
                self.head.clear()
            self.head[first] = self.encode_chunk(first)
        return self.head[first] + b"".join(map(self.__getitem__, rest))


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = load_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.chars = byte_chars()
        self.by_piece = sorted(self.ranks.values())  # sentencepiece id - 1 -> rank
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.memo = ChunkMemo(self._chunk, MEMO // 3)  # it stays with the worker, beside what later stages hold

    def pretoken_ids(self, pretoken: bytes) -> list[int]:
        """A pre-token that is a token itself is that token; others are merged."""
        whole = self.ranks.get(pretoken)
        if whole is not None:
            return [whole]
        found = self.model.encode("".join(map(self.chars.__getitem__, pretoken)), out_type=int)
        return [self.by_piece[i - 1] for i in found]

    def _chunk(self, chunk: str) -> bytes:
        ids = [i for p in plain_pieces(chunk) or self.split(chunk) for i in self.pretoken_ids(p.encode("utf-8", "surrogatepass"))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [self.memo.encode(t) for t in texts]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000):
    """Slices of Arrow batches with about ``limit`` bytes of text each, so that
    very long texts don't pile up in a worker; yields (slice, list of texts)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        at = size = 0
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for i, n in enumerate(sizes):
            size += n
            if size >= limit or i == len(sizes) - 1:
                part = batch.slice(at, i + 1 - at)
                yield part, [t or "" for t in texts.slice(at, i + 1 - at).to_pylist()]
                at, size = i + 1, 0


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (little-endian unsigned 32-bit integers), decoded (bytes that
    the ids decode to).  The path is read by each worker."""

    def run(batches):
        c = codec(path, pattern)
        import numpy as np

        for part, texts in by_bytes(batches, "text"):
            ids = c.encode_bytes(texts)
            back = [c.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["key", "ids", "decoded"]
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids binary, decoded binary").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encodes and decodes like
    ``encode_documents`` and returns digests in place of the payloads."""

    def run(batches):
        c = codec(path, pattern)
        import numpy as np

        sha = hashlib.sha256
        for part, texts in by_bytes(batches, "text"):
            ids = c.encode_bytes(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([sha(x).hexdigest() for x in ids]),
                    pa.array([sha(c.decode(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in ids]),
                ],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed(
        "key", key
    )
