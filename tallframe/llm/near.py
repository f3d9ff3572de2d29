"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity
of 0.8 or more, found by SimHash links and, for the rest, by an exact prefix join.

1.  Distinct texts (by MD5) get a number, a SimHash of their distinct shingles, a
    parity map and a prefix.  The SimHashes are linked by covering masks
    (``simhash.links``); each link is verified on the whole texts, and verified
    links give the first groups.
2.  What SimHash leaves apart is found by prefixes: all shingles have one order,
    the rarest first; of a text with n shingles the first n - ceil(0.8 n) + 1
    always hold one that a similar text has in its own prefix too.  Only shingles
    in the prefixes of two different groups matter.  Counts for the order come
    from all texts: of the frequent shingles one by one, by mergeable summaries
    of heavy hitters, of the others by cells.  Any order is exact, a good one
    keeps passages that many texts share out of the prefixes.
3.  Texts with such a shingle in common are compared by size, by what is left
    behind the shingle, and by parity maps: equal bits of 512 count shingles
    modulo 2, so that two maps differ in no more bits than the sets do in
    shingles.  Pairs that pass are compared by wider maps, of about as many bits
    as a text has shingles.  None of these ever turns a similar pair away.
4.  In each bucket the closest pairs between groups make a forest, whose edges are
    verified on the whole texts.  Where an edge fails, all pairs of the bucket
    that lie across groups are verified, ever more in each round, until none is
    left.  Buckets of more than ``HEAVY`` texts are dealt into blocks, a task for
    two blocks at a time.

Nulls count as empty texts; texts without words are alike.  Very long texts are
taken whole.  Repeated rows are copies of each other.  An empty table gives an
empty result.  Columns of the table may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import by_bytes
from .common import bit_map, bound_batches, connected_components, discard, in_bit_map, mark_hits, materialize, tidy, whole_groups
from .simhash import SEED, _signed, join_trees, links, majority

#: words of a shingle
WORDS = 5
#: similarity as a fraction
ABOVE, BELOW = 4, 5
#: cells of the table of shingle counts (told from the hash's first bits), and pieces it is merged in
CELLS, PIECES = 1 << 20, 1024
#: shingles that a summary of heavy hitters keeps: it has all that make more than 1 in so many
HITTERS = 1 << 16
#: bits of a parity map
PARITY = 512
#: texts of a bucket that are compared in one task
HEAVY = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word -> XXH64; emptied when full, long words aren't kept."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word, SEED)
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = h
        return h


def shingles(text: str | None, memo: WordHashes | None = None) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles (A-Z lower-cased, words
    between ASCII white space), ascending; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - WORDS + 1
    w = np.fromiter(map((WordHashes() if memo is None else memo).__getitem__, words), np.uint64, len(words))
    if n <= 0:  # as long as the text, and unlike any longer one
        n, w = 1, np.concatenate([np.full(WORDS - len(w), len(w), np.uint64), w])
    h = w[:n].copy()
    for i in range(1, WORDS):
        h *= _MIX
        h += w[i : n + i]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles have the similarity."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return BELOW * common >= ABOVE * (len(x) + len(y) - common)


def parity(h: np.ndarray, bits: int = PARITY) -> bytes:
    odd = np.bincount((h >> np.uint64(20)).astype(np.int64) & bits - 1, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_parity(h: np.ndarray) -> bytes:
    """A parity map of as many bits as there are shingles, up to a power of two."""
    return parity(h, max(64, 1 << (len(h) - 1).bit_length()))


def may_be_alike(x: bytes, y: bytes, both: int) -> bool:
    """False only for sets of ``both`` shingles together that can't be similar.
    The wider map is folded to the other's width: parities add up."""
    n = min(len(x), len(y))
    a, b = (np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, n)) for m in (x, y))
    return (ABOVE + BELOW) * int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) <= both


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.unhex(F.md5(body.cast("binary"))).alias("tk"), body.alias("text"))


class _Once:
    """Rows whose text a task hasn't met yet; forgets (harmlessly) when full."""

    def __init__(self):
        self.seen = set()

    def __call__(self, keys: list[bytes]) -> list[int]:
        out = []
        for i, k in enumerate(keys):
            if k not in self.seen:
                if len(self.seen) >= 100_000:
                    self.seen.clear()
                self.seen.add(k)
                out.append(i)
        return out


class Hitters:
    """The most frequent of a stream of hashes (a mergeable Misra-Gries summary):
    counts are too small by 1 in ``HITTERS`` of the stream at most."""

    def __init__(self):
        self.keys, self.n, self.waiting, self.held = np.array([], np.uint64), np.array([], np.int64), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.held += len(hashes)
        if self.held >= 4 * HITTERS:
            self.fold()

    def fold(self) -> None:
        fresh, n = np.unique(np.concatenate(self.waiting), return_counts=True) if self.waiting else (np.array([], np.uint64), np.array([], np.int64))
        keys, at = np.unique(np.concatenate([self.keys, fresh]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, np.concatenate([self.n, n]))
        if len(keys) > HITTERS:
            total -= np.partition(total, len(keys) - HITTERS - 1)[len(keys) - HITTERS - 1]
        self.keys, self.n, self.waiting, self.held = keys[total > 0], total[total > 0], [], 0


@dataclass
class Order:
    """How rare shingles are: classes of cells, and counts of the frequent ones,
    which come behind all others."""

    cells: np.ndarray
    keys: np.ndarray
    n: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        out = self.cells[_cell(h)].astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            out = np.where(self.keys[at] == h, 64 + self.n[at], out)
        return out


def rarity(texts: DataFrame) -> Order:
    """The order over all texts; copies within a task count once.  A fixed 1 MB
    of cells (the number of binary digits of each one's count) and ``HITTERS``
    frequent shingles at most."""

    def count(batches):
        new, memo, total, often = _Once(), WordHashes(), np.zeros(CELLS, np.int64), Hitters()
        for part, body in by_bytes(batches, "text"):
            got = [shingles(body[i], memo) for i in new(part.column("tk").to_pylist())]
            if got:
                flat = np.concatenate(got)
                total += np.bincount(_cell(flat), minlength=CELLS)
                often.add(flat)
        if total.any():
            often.fold()
            cut = np.minimum(total, (1 << 32) - 1).astype("<u4").reshape(PIECES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], ["piece", "n"])
            some = often.n > 1
            pairs = np.stack([often.keys[some], often.n[some].astype(np.uint64)], 1).astype("<u8")
            for a in range(0, len(pairs), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([-1 - a // 4096], pa.int32()), pa.array([pairs[a : a + 4096].tobytes()], pa.binary())], ["piece", "n"])
        del new, memo, total, often
        tidy()

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for p, n in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(n.as_py(), "<u4").astype(np.int64)
                held[p] = held[p] + x if p in held else x
        keys = sorted(held)
        digits = [np.frexp(held[k].astype(float))[1].astype(np.uint8).tobytes() for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(digits, pa.binary())], ["piece", "n"])

    def single(batches):
        for b in batches:
            for n in b.column(0):
                pairs = np.frombuffer(n.as_py(), "<u8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].astype(np.int64))], ["h", "n"])

    counted = materialize(texts.mapInArrow(count, "piece int, n binary"), "counts")
    parts = counted.where("piece >= 0").repartition("piece").mapInArrow(merge, "piece int, n binary")
    out = np.zeros((PIECES, CELLS // PIECES), np.uint8)
    for r in parts.collect():
        out[r["piece"]] = np.frombuffer(r["n"], np.uint8)
    often = counted.where("piece < 0").select("n").mapInArrow(single, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # what only a few texts have is told apart well enough by its cell
    top = often.where("n > 32").orderBy(F.col("n").desc(), "h").limit(HITTERS).toArrow()
    discard(counted)
    keys = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Order(out.ravel(), keys[order], top.column("n").to_numpy()[order])


def sketches(texts: DataFrame) -> DataFrame:
    """(id, tk, size, fp, parity, wide, prefix) of each distinct text, as a table:
    ids are numbers, so there are no collisions among them."""
    shared = texts.sparkSession.sparkContext.broadcast(rarity(texts))

    def look(batches):
        rare, new, memo = shared.value, _Once(), WordHashes()
        for part, body in by_bytes(batches, "text"):
            at = new(part.column("tk").to_pylist())
            sets = [shingles(body[i], memo) for i in at]
            sizes = [len(h) for h in sets]
            prefixes = [h[np.argsort(rare.of(h), kind="stable")[: n - -(-ABOVE * n // BELOW) + 1]] for h, n in zip(sets, sizes)]
            ends = np.cumsum([0, *map(len, prefixes)])
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("tk").take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()),
                    pa.array([_signed(majority(h)) for h in sets], pa.int64()), pa.array([parity(h) for h in sets], pa.binary()),
                    pa.array([wide_parity(h) for h in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                ["tk", "size", "fp", "parity", "wide", "prefix"],
            )
        del new, memo
        tidy()

    found = texts.mapInArrow(look, "tk binary, size long, fp long, parity binary, wide binary, prefix array<long>")
    one = found.groupBy("tk").agg(*(F.first(c).alias(c) for c in ("size", "fp", "parity", "wide", "prefix")))
    return materialize(one.select(F.monotonically_increasing_id().alias("id"), "*"), "sketches")


def plausible(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids that wide maps don't rule out."""

    def check(batches):
        for b in batches:
            ok = [may_be_alike(*r) for r in zip(*(b.column(c).to_pylist() for c in ("x", "y", "both")))]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in "ab"], ["a", "b"])

    full = pairs
    for end, name in ("ax", "by"):
        full = full.join(known.select(F.col("id").alias(end), F.col("wide").alias(name), F.col("size").alias(f"n{end}")), end)
    full = full.select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("both"))
    return materialize(full.mapInArrow(check, "a long, b long"), "plausible")


def verified(texts: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose whole texts are similar.  Only texts that
    are asked for leave their place, each once and then once for each pair."""

    def check(batches):
        memo = WordHashes()
        for b in batches:
            for part, x in by_bytes([b], "x"):
                ok = [alike(shingles(s, memo), shingles(t.as_py(), memo)) for s, t in zip(x, part.column("y"))]
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(ok, pa.bool_())) for c in "ab"], ["a", "b"])
        del memo
        tidy()

    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    asked = materialize(known.select("id", "tk").join(ends, "id"), "asked")
    bits = bit_map(asked.select(F.xxhash64("tk").alias("h")))
    rows = mark_hits(texts.select("tk", "text", F.xxhash64("tk").alias("th")), "th", bits, "asked").where("asked")
    bodies = materialize(rows.groupBy("tk").agg(F.first("text").alias("text")).join(asked, "tk").select("id", "text"), "bodies")
    full = pairs.join(bodies.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    full = full.join(bodies.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    near = materialize(full.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "near")
    discard(bodies)
    discard(asked)
    return near


def simhash_pairs(known: DataFrame) -> DataFrame:
    """(a, b): a spanning set of the pairs whose SimHashes are within the radius."""
    heads = materialize(known.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    same = known.join(heads, "fp").where("head < id").select(F.col("head").alias("a"), F.col("id").alias("b"))
    near = links(heads.select("fp"))
    for end in "ab":
        near = near.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_id")), end)
    return same.unionByName(near.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")))


def _strips(bucket, sides, size, pos, maps, group):
    """Row pairs of different groups within each bucket (rows in order of size)
    that may be similar, strip by strip, the closest third first."""
    n = len(size)
    for band in range(3):
        step, live = 1, np.arange(n)
        while True:
            live = live[live + step < n]
            # rows are in order of size: a partner too large has none behind it either
            live = live[(bucket[live] == bucket[live + step]) & (BELOW * size[live] >= ABOVE * size[live + step])]
            if not len(live):
                break
            a, b = live, live + step
            both = size[a] + size[b]
            ok = (group[a] != group[b]) & ((sides[a] < 0) | (sides[a] != sides[b]))
            ok &= (ABOVE + BELOW) * np.minimum(size[a] - pos[a], size[b] - pos[b]) >= ABOVE * both
            a, b, both = a[ok], b[ok], both[ok]
            d = (ABOVE + BELOW) * np.bitwise_count(maps[a] ^ maps[b]).sum(1, dtype=np.int64)
            ok = (3 * d <= (band + 1) * both) & ((3 * d > band * both) | (band == 0))
            yield a[ok], b[ok]
            step += 1


def _forest(strips, group):
    """Pairs that span, within each bucket, all pairs of the strips."""
    label = np.arange(len(group))
    for a, b in strips:
        yield from join_trees(label, a, b)


def _across(strips, bucket, times):
    """All pairs of the strips; a bucket that has given ``times`` pairs for each
    of its rows and has more gives a row paired with itself at the end."""
    quota = times * np.bincount(bucket)
    given, more = np.zeros_like(quota), np.full(len(quota), -1)
    for a, b in strips:
        full = given[bucket[a]] >= quota[bucket[a]]
        more[bucket[a[full]]] = a[full]
        a, b = a[~full], b[~full]
        given += np.bincount(bucket[a], minlength=len(given))
        yield a, b
    rest = more[more >= 0]
    yield rest, rest


def candidates(known: DataFrame, shared: DataFrame, times: int) -> DataFrame:
    """(h, a, b) of texts that share a shingle of ``shared(h, n)`` and may be
    similar; a = b in buckets that have more.  ``known`` has labels."""
    sc = known.sparkSession.sparkContext
    bits = sc.broadcast(bit_map(shared.select("h")))

    def spread(batches):
        table = np.frombuffer(bits.value, np.uint8)
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("prefix")
            many = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
            hit = np.flatnonzero(in_bit_map(table, flat.view(np.uint64)))
            for i in range(0, len(hit), 100_000):
                some = hit[i : i + 100_000]
                own = pa.array(np.repeat(np.arange(len(many)), many)[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[some]), pa.array(pos[some]), *(b.column(c).take(own) for c in ("id", "label", "size", "parity"))],
                    ["h", "pos", "id", "label", "size", "parity"],
                )
        tidy()

    def pair(batches):
        for t in whole_groups(batches, ["h", "bi", "bj"], 20_000):
            h, bi, bj, block, size, pos, ids, label = (t.column(c).to_numpy() for c in ("h", "bi", "bj", "block", "size", "pos", "id", "label"))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
            bucket = np.cumsum(new) - 1
            maps = np.frombuffer(b"".join(t.column("parity").to_pylist()), np.uint64).reshape(len(h), -1)
            strips = _strips(bucket, np.where(bi == bj, -1, block), size, pos, maps, label)
            for a, b in _across(strips, bucket, times) if times else _forest(strips, label):
                ends = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h[a], *ends)], ["h", "a", "b"])
        tidy()

    rows = known.select("id", "label", "size", "parity", "prefix").mapInArrow(
        spread, "h long, pos long, id long, label long, size long, parity binary"
    )
    blocks = F.ceil(F.col("n") / HEAVY)
    dealt = rows.join(shared, "h").withColumn("block", F.when(F.col("n") <= HEAVY, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), blocks)).cast("long"))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("n") <= HEAVY, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))))
    dealt = dealt.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other", "n")
    dealt = dealt.repartition("h", "bi", "bj").sortWithinPartitions("h", "bi", "bj", "size", "id")
    return materialize(dealt.mapInArrow(pair, "h long, a long, b long"), "candidates")


def near_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(tk, component): groups of distinct texts (MD5) that hang together by
    similarity; texts alone are left out."""
    bound_batches(docs.sparkSession)
    texts = _texts(docs, text)
    known = sketches(texts)
    tested = materialize(simhash_pairs(known).distinct(), "pairs")
    edges = verified(texts, known, tested)
    labels = connected_components(edges)
    shared, times = None, 0
    while True:
        labelled = known.select("id", "size", "parity", "prefix").join(labels.select("id", F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
        if shared is None:
            labelled = materialize(labelled, "labelled")
            keys = labelled.select("label", F.explode("prefix").alias("h"))
            seen = keys.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
            shared = materialize(seen.where("lo < hi").select("h", "n"), "shared")
        found = candidates(labelled, shared, times)
        if not times:
            discard(labelled)
        fresh = materialize(found.where("a != b").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        good = verified(texts, known, plausible(known, fresh))
        tested, edges = tested.unionByName(fresh), edges.unionByName(good)
        labels = connected_components(edges)
        if times:
            left = found.where("a = b")
        else:  # a bucket is done if its forest lies within verified groups
            left = found
            for end in "ab":
                one = labels.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
                left = left.join(one, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
            left = left.where("of_a != of_b")
        shared = materialize(shared.join(left.select("h").distinct(), "h", "left_semi"), "left")
        discard(found)
        if not shared.limit(1).count():
            return known.select("id", "tk").join(labels, "id").select("tk", "component")
        times = 8 * times or 64


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) but for copies and near copies: of
    each group the row with the smallest key stays (null keys are largest; of
    rows that repeat key and text one stays)."""
    bound_batches(docs.sparkSession)
    body = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    heads = docs.select(body.alias("tk"), F.col(key).alias("k"))
    nodes = materialize(heads.groupBy("tk", "k").agg(F.count("*").alias("n")), "heads")
    labels = materialize(near_groups(docs, text), "groups")
    least = nodes.groupBy("tk").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("k").isNull().alias("z"), "k", "n")).alias("m"))
    least = materialize(least, "least")
    # of a group's texts with the smallest key (keys may repeat) the smallest digest stays
    best = least.join(labels, "tk").groupBy("component").agg(F.min(F.struct("m.z", "m.k", "tk", "m.n")).alias("b")).select("b.tk", "b.k", "b.n")
    stay = materialize(best.unionByName(least.join(labels, "tk", "left_anti").select("tk", "m.k", "m.n")), "stay")
    # rows of texts that stand alone aren't shuffled: only the others are looked up
    touched = labels.select("tk").unionByName(least.where("n > 1").select("tk")).select(F.xxhash64("tk").alias("h"))
    tk, th, hit, ident, k = free_names(docs, ["tk", "th", "hit", "id", "k"])
    marked = mark_hits(docs.withColumn(tk, body).withColumn(th, F.xxhash64(tk)), th, bit_map(touched), hit)
    alone, rest = marked.where(~F.col(hit)), marked.where(F.col(hit))

    def those(which: str) -> DataFrame:
        s = stay.where(which).select(F.col("tk").alias(ident), F.col("k").alias(k))
        return rest.join(s, (rest[tk] == s[ident]) & rest[key].eqNullSafe(s[k]), "left_semi")

    repeated = those("n > 1").dropDuplicates([tk, key])
    return alone.unionByName(those("n = 1")).unionByName(repeated).drop(tk, th, hit)


def free_names(df: DataFrame, names: list[str]) -> list[str]:
    """Each name with so many underscores in front that no column has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
        taken.add(n.lower())
    return out
