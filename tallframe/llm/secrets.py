"""Secret scan with recursive decoding of nested layers.

Base spans come from three patterns over the text itself.  Then a worklist
unwraps every encoded run found (percent escapes, Unicode escapes, base64,
gzip, zlib or raw deflate data, UTF-16 inside base64), scans each decoded layer
and goes on with the encoded runs of that layer until none is left.  A layer that has been
seen before in the same document is not opened again, so cycles end.  Escapes
are decoded in place and keep exact offsets; a find in base64 is reported at
the outermost base64 run that holds it.

Escapes of the escape sign itself (``%252525...``, ``\\u005cu005c...``) would
peel off one level at a time.  As long as nothing else is left to decode, all
those levels are taken in one step: the sign stays, what it ate is skipped, and
the finds of the levels between, runs of hex digits behind the sign, follow from
their number; base64 runs of those levels are ends of the run opened before.

Null texts count as empty ones; an empty text has no spans and the digest of
no bytes.  Texts are scanned whole.  A layer costs time in proportion to its
length, and a text has more than a few dozen layers only if it holds escapes
nested to as many different depths, which takes the square of their number in signs,
or alternates escapes of two kinds.  Repeated rows give repeated results, an empty table an empty
result.  Columns of the table may have any names; ``scan`` reads key and text
only.  Compressed streams are followed to their end, all members, ``WINDOW``
bytes at a time: memory is bounded however far they expand.  Within a stream of
more than that, a further base64 run that itself crosses windows is opened in parts.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import by_bytes

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: a match of 24 or more characters is always a whole run of them
HEX = re.compile(r"[0-9a-f]{24,}")
#: every assignment has one of these two signs right after its word; texts without them need no look
SIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]""")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: what an escaped escape sign eats, level by level
NESTED_PERCENT, NESTED_ESCAPE = re.compile(r"(?:25)*"), re.compile(r"(?:u005[cC]|x5[cC]|U0000005[cC])*+")
UNIT = re.compile(r"u005[cC]|x5[cC]|U0000005[cC]")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
#: a find takes 12 bytes at least, which are 16 signs
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: lines of base64 signs, the last of any length but with nothing like a word behind it
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+\r?\n[\x20\t]*+)+[A-Za-z0-9+/_-]++={0,2}(?![\x20\t]*[\w+/=-])")
HEX_RUN = re.compile(r"[0-9a-f]*")
#: how base64 of gzip and of zlib data begins
PACKED = re.compile(r"(?=H4sI|e[AFJN])")
PLAIN = re.compile(rb"[\t\n\r\x20-\x7e]{12}")
#: bytes of a decompressed stream that are scanned at a time, and how far scans overlap where no line ends
WINDOW, OVERLAP = 16_000_000, 65_536


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base patterns, in order."""
    out = []
    if SIGN.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _packed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0


def _inflate(chunks):
    """Decompressed pieces of all members of a stream, a bounded piece at a
    time; ends where the stream does or is broken."""
    d, data = zlib.decompressobj(47), b""
    for chunk in chunks:
        data += chunk
        while data:
            try:
                piece = d.decompress(data, 1 << 20)
            except zlib.error:
                return
            data = d.unconsumed_tail
            if piece:
                yield piece
            if d.eof:
                data = d.unused_data
                if not _packed(data):
                    return
                d = zlib.decompressobj(47)
            elif not piece:
                break


def _unpacked(chunks):
    """What a stream holds when no compression is left."""
    chunks = iter(chunks)
    head = next(chunks, b"")
    both = itertools.chain([head], chunks)
    if not _packed(head):
        return both
    first = next(inner := _inflate(both), None)
    return both if first is None else _unpacked(itertools.chain([first], inner))


def _windows(chunks):
    """Texts of a stream, ``WINDOW`` bytes at most: cut behind a line's end, or
    with an overlap that holds all that a find takes."""
    held = b""
    for chunk in chunks:
        held += chunk
        if len(held) >= WINDOW:
            cut = held.rfind(b"\n") + 1 or len(held)
            yield held[:cut].decode("utf-8", "replace")
            held = held[cut:] if cut < len(held) else held[-OVERLAP:]
    if PLAIN.search(held):
        yield held.decode("utf-8", "replace")


def _bytes_of(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _base64_layers(run: str):
    """Texts in a run of base64 signs: compressed streams wherever they begin,
    and what the run decodes to at each of the four alignments, as it may have
    other signs in front.  Any find takes ``PLAIN`` bytes of ASCII in a row."""
    run = run.replace("-", "+").replace("_", "/")
    at = 0
    for m in PACKED.finditer(run):
        head = _bytes_of(run[m.start() : m.start() + 1024])
        if m.start() < at or not _packed(head):
            continue
        try:
            zlib.decompressobj(47).decompress(head, 1 << 20)
        except zlib.error:  # not worth a look at all of a long run
            continue
        data = _bytes_of(run[m.start() :])
        pieces = _inflate([data])
        if (first := next(pieces, None)) is not None:
            yield from _windows(_unpacked(itertools.chain([first], pieces)))
            at = m.start() + 4
    for n in range(4):
        data = _bytes_of(run[n:])
        if PLAIN.search(data):
            yield data.decode("utf-8", "replace")
        elif data.count(0) * 3 > len(data):
            for order in ("utf-16-le", "utf-16-be"):
                text = data[: len(data) & ~1].decode(order, "replace")
                if PLAIN.search(text.encode("ascii", "replace").replace(b"?", b"\0")):
                    yield text
        elif n == 0:
            yield from _raw_deflate(data)


def _raw_deflate(data: bytes):
    """Texts of a deflate stream without a header, which only its content tells:
    it has to reach its end, and plain text has to come out of it."""
    if len(data) < 12 or data[0] & 6 == 6:  # the block type that doesn't exist
        return
    try:
        zlib.decompressobj(-15).decompress(data[:1024], 1 << 16)
    except zlib.error:
        return
    d = zlib.decompressobj(-15)

    def pieces():
        rest = data
        while not d.eof:
            piece = d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail
            if not piece and not rest:
                return
            yield piece

    try:
        held = list(itertools.islice(pieces(), 1 + WINDOW // (1 << 20)))
    except zlib.error:
        return
    if d.eof:
        yield from _windows(_unpacked(iter(held)))
    elif len(held) > WINDOW // (1 << 20):  # a long one: to its end, a window at a time
        yield from _windows(itertools.chain(held, _quiet(pieces())))


def _quiet(chunks):
    try:
        yield from chunks
    except zlib.error:
        return


def _percent(m: re.Match):
    """(signs, source signs of each) of a run of percent escapes."""
    s = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
    return s, [3 * len(c.encode("utf-8", "surrogateescape")) for c in s]


def _escape(m: re.Match):
    n = int(m[1] or m[2] or m[3], 16)
    return (chr(n), [len(m[0])]) if n < 0x110000 else (m[0], [1] * len(m[0]))


class Layer:
    """A text and where its signs come from in the document: sign i stands for
    [first[i], last[i]); without these lists all stand for ``whole``."""

    def __init__(self, text: str, whole=None, first=None, last=None):
        self.text, self.whole, self.first, self.last = text, whole, first, last

    def place(self, start: int, end: int) -> tuple[int, int]:
        return self.whole or (self.first[start], self.last[end - 1])

    def decoded(self):
        """(layer with its percent or Unicode escapes decoded in place, finds of
        the levels that were skipped) for each kind of escape in it."""
        for sign, pattern, decode in (("%", PERCENT, _percent), ("\\", ESCAPE, _escape)):
            if sign not in self.text:
                continue
            text = self.text
            runs = list(pattern.finditer(text))
            levels = min((self._levels(m) for m in runs), default=0)
            out, first, last, at, found = [], [], [], 0, []
            for m in runs:
                new, many = decode(m)
                end = m.end()
                if levels > 1:  # the sign stays and eats this much more
                    found += self._between(m, levels)
                    end = self._eaten(m, levels)
                    many = [end - m.start()]
                out += [text[at : m.start()], new]
                if not self.whole:
                    first += self.first[at : m.start()]
                    last += self.last[at : m.start()]
                    i = m.start()
                    for n in many:
                        first.append(self.first[i])
                        last.append(self.last[i + n - 1])
                        i += n
                at = end
            new = "".join([*out, text[at:]])
            if new != text:
                if self.whole:
                    yield Layer(new, self.whole), found
                else:
                    yield Layer(new, None, [*first, *self.first[at:]], [*last, *self.last[at:]]), found

    def _levels(self, m: re.Match) -> int:
        """For how many levels nothing happens here but that an escape sign is unwrapped."""
        if m[0] == "%25":
            end = NESTED_PERCENT.match(self.text, m.end()).end()
            return max(1, (end - m.end()) // 2 + (self.text[end : end + 1] != "%"))
        if m[0][0] == "\\" and UNIT.fullmatch(m[0], 1):
            end = NESTED_ESCAPE.match(self.text, m.end()).end()
            return 1 + sum(1 for _ in UNIT.finditer(self.text, m.end(), end))
        return 1

    def _eaten(self, m: re.Match, levels: int) -> int:
        if m[0] == "%25":
            return m.end() + 2 * (levels - 1)
        units = itertools.islice(UNIT.finditer(self.text, m.end()), levels - 1)
        return max((u.end() for u in units), default=m.end())

    def _between(self, m: re.Match, levels: int):
        """Finds of the levels before the last: no pattern crosses an escape
        sign, and what it eats is behind it, so these are runs of hex digits."""
        if m[0] == "%25":
            end = HEX_RUN.match(self.text, m.end()).end()
            for start in range(m.end(), min(m.end() + 2 * (levels - 1), end - 23), 2):
                a, b = self.place(start, end)
                yield a, 2, b

    def opened(self):
        """The layers inside base64 runs, compressed ones unpacked."""
        for m in BASE64.finditer(self.text):
            for s in _base64_layers(m[0].rstrip("=")):
                yield Layer(s, self.place(m.start(), m.end())), ()
        if "\n" in self.text:
            for m in WRAPPED.finditer(self.text):
                for s in _base64_layers("".join(m[0].split()).rstrip("=")):
                    yield Layer(s, self.place(m.start(), m.end())), ()


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans and those of all decoded layers, each once, in order.

    A worklist of layers: escapes are decoded in place, in their context, with
    exact offsets; what base64 holds stands for its whole run.  A layer that has
    been seen with the same place isn't opened again."""
    found = set(base_spans(text))
    top = Layer(text, None, range(len(text)), range(1, len(text) + 1))
    seen, work = set(), [itertools.chain(top.decoded(), top.opened())]
    while work:
        layer, more = next(work[-1], (None, ()))
        if layer is None:
            work.pop()
            continue
        found.update(more)
        mark = layer.whole, hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest()
        if mark in seen:
            continue
        seen.add(mark)
        for s, kind, e in base_spans(layer.text):
            a, b = layer.place(s, e)
            found.add((a, kind, b))
        work.append(itertools.chain(layer.decoded(), layer.opened()))  # one layer at a time is held
    return sorted(found)


def form(spans) -> str:
    """kind:start:end by start, then kind as listed; comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex (base spans), base_sha256, spans."""

    def run(batches):
        for part, texts in by_bytes(batches, "text"):
            base = [base_spans(t) for t in texts]
            full = [all_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *[pa.array([sum(k == n for _, k, _ in b) for b in base], pa.int64()) for n in range(3)],
                    pa.array([hashlib.sha256(form(b).encode()).hexdigest() for b in base]),
                    pa.array([form(f) for f in full]),
                ],
                ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("key", key)


def redact_text(text: str, mask: str = "[SECRET]") -> str:
    """The text with every span (overlaps joined) replaced by ``mask``."""
    out, at = [], 0
    for s, _, e in all_spans(text):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """All columns of ``docs``, secrets masked in ``text``; null texts stay null."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part, texts in by_bytes([batch], text):
                ok = part.column(at).is_valid().to_pylist()
                new = pa.array([redact_text(t, mask) if v else None for t, v in zip(texts, ok)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [new if i == at else c for i, c in enumerate(part.columns)], part.schema.names
                )

    return docs.mapInArrow(run, docs.schema)
