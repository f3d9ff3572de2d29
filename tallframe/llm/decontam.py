"""Benchmark decontamination by pigeonhole edit matching.

Each test item gets an error budget of k edits (a share of its length) and is
split into k + 1 pieces: any window of a document within k edits of the item
holds at least one piece unchanged.  An Aho-Corasick automaton finds all exact
piece hits in one pass over the text; each hit gives a window, and Myers'
bit-parallel algorithm (one arbitrary-length integer per bit vector) gives the
least edit distance of the item to any substring of the window.

Text is compared after lower-casing and with each white-space character turned
into a blank; both keep positions, so spans are in code points of the original.

Nulls and empty texts match nothing, as do items of null or empty text.  Item
ids may be of any ordered type; items with the id null count as one item, given
last.  Items that equal each other after normalisation all count, and an id
that repeats counts once, by its closest text.  Repeated rows give repeated
results.  An empty benchmark leaves every document clean; an empty table gives
an empty result.  Whole texts are searched, very long ones too, and all hits
are verified.  Columns of the table may have any names: ``matches`` reads key
and text only, ``decontaminate`` returns all columns as they are.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import by_bytes
from .common import discard, materialize

#: edits allowed for each character of an item
ERROR_RATE = 0.08
#: characters of items that one automaton takes; larger benchmarks are done in blocks, one after the other: what
#: one has found is stored before the next one is built, so a task holds one automaton
BLOCK_CHARS = 4_000_000
#: white space other than the blank
SPACE = re.compile(r"[^\S ]")


def normalise(text: str) -> str:
    """Lower case, white space to blanks, length unchanged."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return SPACE.sub(" ", low)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): ``item`` cut into k + 1 parts of near equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, window: str) -> tuple[int, int]:
    """(least distance of ``item`` to a substring of ``window``, end of the
    first such substring), by bit-parallel dynamic programming."""
    m = len(item)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, dist = full, 0, m
    best, end = m, 0
    for j, c in enumerate(window, 1):
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            dist += 1
        elif mh & top:
            dist -= 1
        ph = ph << 1 & full  # a match may start anywhere: the first row stays 0
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if dist < best:
            best, end = dist, j
    return best, end


class Matcher:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple], rate: float = ERROR_RATE):
        import ahocorasick

        self.items, found = [], {}
        for ident, text in items:
            t = normalise(text or "").strip()
            if not t:
                continue
            k = int(rate * len(t))
            for at, p in pieces(t, k):
                found.setdefault(p, []).append((len(self.items), at))
            self.items.append((ident, t, k))
        self.automaton = ahocorasick.Automaton()
        for p, places in found.items():
            self.automaton.add_word(p, (len(p), places))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict:
        """item id -> (least distance, end of the match in the text)."""
        if not self.items or not text:
            return {}
        low = normalise(text)
        windows: dict[int, list[list[int]]] = {}
        for last, (n, places) in self.automaton.iter(low):
            start = last + 1 - n
            for item, at in places:
                _, t, k = self.items[item]
                a, b = max(0, start - at - k), min(len(low), start - at + len(t) + k)
                mine = windows.setdefault(item, [])
                if mine and a <= mine[-1][1] and a >= mine[-1][0]:
                    mine[-1][1] = max(mine[-1][1], b)  # one pass over windows that overlap
                else:
                    mine.append([a, b])
        out: dict = {}
        for item, spans in windows.items():
            ident, t, k = self.items[item]
            for a, b in spans:
                if out.get(ident, (1,))[0] == 0:
                    break
                if b - a < len(t) - k:
                    continue
                at = low.find(t, a, b)
                d, end = (0, at - a + len(t)) if at >= 0 else myers(t, low[a:b])
                if d <= k and (ident not in out or d < out[ident][0]):
                    out[ident] = (d, a + end)
        return out


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> list[list[tuple]]:
    """Items in blocks of about ``BLOCK_CHARS`` characters (a longer single
    item makes a block of its own).  Lengths are looked at first; each block is
    read on its own when it is used."""
    rows = benchmark.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    part = F.pmod(F.xxhash64("k", "t"), F.lit(n))
    for i in range(n):
        yield [(r["k"], r["t"]) for r in rows.where(part == i).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", rate: float = ERROR_RATE, item_key: str = "item_id") -> DataFrame:
    """key, items (matching item ids, ascending, null last), distances (of
    each), ends.  One row per row of ``docs``: what a block finds is carried on
    to the next."""
    item_type = benchmark.schema[item_key].dataType
    kind, item = docs.schema[key].dataType.simpleString(), item_type.simpleString()
    names = ["items", "distances", "ends"]
    empty = [F.array().cast(f"array<{x}>").alias(c) for c, x in zip(names, (item, "bigint", "bigint"))]
    out, last = docs.select(docs[key].alias("key"), docs[text].alias("text"), *empty), None
    for n, block in enumerate(item_blocks(benchmark, item_key)):
        if n:
            out, last = _settled(out, last)
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            m = Matcher(shared.value, rate)
            for part, texts in by_bytes(batches, "text"):
                kinds = [part.schema.field(c).type for c in names]
                known = zip(*(part.column(c).to_pylist() for c in names))
                found = [{i: (d, e) for i, d, e in zip(*k)} for k in known]
                for f, t in zip(found, texts):
                    for i, hit in m.find(t).items():
                        f[i] = min(hit, f[i], key=lambda x: x[0]) if i in f else hit
                rows = [sorted(((i, d, e) for i, (d, e) in f.items()), key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0)) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("text"), *(pa.array([[x[n] for x in f] for f in rows], kinds[n]) for n in range(3))],
                    ["key", "text", *names],
                )

        out = out.mapInArrow(run, f"key {kind}, text string, items array<{item}>, distances array<long>, ends array<long>")
    return out.select(F.col("key").alias(key), *names)


def _settled(out: DataFrame, last: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``out`` as a stored table; the one before it goes."""
    table = materialize(out, "matched")
    if last is not None:
        discard(last)
    return table, table


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` (all columns) that match no item."""
    out, last = docs, None
    for n, block in enumerate(item_blocks(benchmark)):
        if n:
            out, last = _settled(out, last)
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            m = Matcher(shared.value, rate)
            for batch in batches:
                for part, texts in by_bytes([batch], text):
                    yield part.filter(pa.array([not m.find(t) for t in texts], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
