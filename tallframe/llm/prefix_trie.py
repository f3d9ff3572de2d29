"""Prefix trie of conversations, merged family first.

A family is what shares the base id c - c % 100.  Turns (as digests, their texts
stay behind) and the first turns of the bases are cogrouped by base id; each
family rebuilds its conversations and builds a small trie of them.  Only its
nodes are shuffled, to be merged with those of other families.  A node is named
by its depth and 128 bits: the sum of one hash per turn, each of the turn's digest
and its depth, so sequences add up piece by piece.

Conversations of more than ``LONG`` turns don't enter a family's group: they are
ranked by a range exchange, rebuilt by joins and cut into chains of ``LONG``
turns, each a small trie of its own whose names start at the sum of the chains
before it.  The merge treats families and chains alike, as units.

Numbers of a subtree are sums over nodes.  Every merged node is owned by the
first unit that has it; a unit sums what it owns below each of its nodes, and
the sums of all units that have a node are added up.  So no path or member list
is ever spread out.  Only the ids of conversations that end at a node are
carried along, at most one family's in a row, and hashed as a sorted stream.

Rows with a null conv_id belong to no conversation.  Null turns come first; turns
that tie are ordered by the MD5 of their length-prefixed role and text.
Repeated rows are repeated turns.  Null roles and texts are empty ones.
Remainders have the sign of the id, as in SQL.  An empty table gives no node, not
even a root.  Very long texts count whole.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

FAMILY, HEADS = 100, 6
#: turns of a conversation that a family's group takes, and of a chain
LONG = 4096

NODES = "u1 long, u2 int, node int, parent int, depth int, h1 long, h2 long, p1 long, p2 long, conv long, n long, chars long, kids int, ghost boolean, ends array<long>"


def own_after(conv: int) -> int:
    """How many of its own first turns a conversation gives up."""
    return zlib.crc32(str(conv).encode()) % HEADS


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def turn_hashes(digests: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """n x 2 hashes of turns (n x 2 digest words) at their depths."""
    at = depth.astype(np.uint64)[:, None] * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
    return _mixed(_mixed(digests ^ at) + at)


def _words(column: pa.Array) -> np.ndarray:
    """n x 2 words of a column of 16-byte digests."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv, turn, digest, chars."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return rows.where(F.col("conv").isNotNull())


def _unit_table(u1: int, u2: int, depth, h, parent, p, conv, n, chars, kids, ghost, ends) -> pa.Table:
    m = len(depth)
    lists = pa.array(ends, pa.list_(pa.int64()))
    names = [f.split()[0] for f in NODES.split(", ")]
    h, p = h.view(np.int64), p.view(np.int64)
    columns = [
        pa.array(np.full(m, u1)), pa.array(np.full(m, u2, np.int32)), pa.array(np.arange(m, dtype=np.int32)), pa.array(parent.astype(np.int32)), pa.array(depth.astype(np.int32)),
        pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(conv.astype(np.int64)), pa.array(n.astype(np.int64)),
        pa.array(chars.astype(np.int64)), pa.array(kids.astype(np.int32)), pa.array(ghost), lists,
    ]
    return pa.Table.from_arrays(columns, names)


def family_trie(base: int, conv: np.ndarray, digests: np.ndarray, chars: np.ndarray, head: np.ndarray, head_chars: np.ndarray) -> pa.Table:
    """Nodes of the rebuilt conversations of a family.  Rows come in order of
    conversation and turn; ``head`` has the first turns of the base."""
    first = np.flatnonzero(np.diff(conv, prepend=conv[:1] - 1)) if len(conv) else np.array([], int)
    ids = conv[first]
    give = np.array([own_after(int(c)) for c in ids], int)
    taken = np.minimum(give, len(head))
    size = np.diff(np.append(first, len(conv)))
    rest = np.maximum(0, size - give)
    length = taken + rest
    # rebuilt turns: which row of (head, own turns) each one is
    start = np.cumsum(length) - length
    at = np.arange(length.sum()) - np.repeat(start, length)
    who = np.repeat(np.arange(len(ids)), length)
    source = np.where(at < taken[who], at, len(head) + first[who] + give[who] + at - taken[who])
    hashes = turn_hashes(np.concatenate([head, digests])[source], at + 1)
    with np.errstate(over="ignore"):
        total = np.cumsum(hashes, axis=0, dtype=np.uint64)
        before = np.concatenate([np.zeros((1, 2), np.uint64), total])[start]
        h = total - before[who]
    # one root, then distinct prefixes
    every = np.empty(len(who) + len(ids), [("d", "<i8"), ("a", "<u8"), ("b", "<u8")])
    row_of = np.arange(len(who)) + who + 1  # each conversation's root stands before its turns
    roots = start + np.arange(len(ids))
    every["d"][row_of], every["a"][row_of], every["b"][row_of] = at + 1, h[:, 0], h[:, 1]
    every[roots] = (0, 0, 0)
    member = np.empty(len(every), int)
    member[row_of], member[roots] = who, np.arange(len(ids))
    names, one, code = np.unique(every, return_index=True, return_inverse=True)
    parent = np.full(len(names), -1)
    parent[code[row_of]] = code[row_of - 1]
    lens = np.zeros(len(names), int)
    lens[code[row_of]] = np.concatenate([head_chars, chars])[source]
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, code, ids[member])
    ends: list[list[int]] = [[] for _ in names]
    for i, last in enumerate(roots + length):
        ends[code[last]].append(int(ids[i]))
    mine = np.stack([names["a"], names["b"]], 1)
    up = np.where(parent[:, None] >= 0, mine[parent], np.uint64(0))
    kids = np.bincount(parent[parent >= 0], minlength=len(names))
    return _unit_table(base, -1, names["d"], mine, parent, up, least, np.bincount(code, minlength=len(names)), lens, kids, np.zeros(len(names), bool), ends)


def _families(turns: DataFrame, heads: DataFrame) -> DataFrame:
    def build(key, own, head):
        if not own.num_rows:
            return _unit_table(0, -1, *[np.zeros(0, int), np.zeros((0, 2), np.uint64), np.zeros(0, int), np.zeros((0, 2), np.uint64)], *[np.zeros(0, int)] * 4, np.zeros(0, bool), [])
        own = own.sort_by([("conv", "ascending"), ("null", "descending"), ("turn", "ascending"), ("digest", "ascending")])
        head = head.sort_by("i")
        words = [_words(t.column("digest").combine_chunks()) for t in (own, head)]
        return family_trie(
            key[0].as_py(), own.column("conv").to_numpy(), words[0], own.column("chars").to_numpy(), words[1], head.column("chars").to_numpy()
        )

    base = (F.col("conv") - F.col("conv") % FAMILY).alias("base")
    own = turns.select(base, "conv", F.col("turn").isNull().cast("int").alias("null"), F.coalesce("turn", F.lit(0)).alias("turn"), "digest", "chars")
    return own.groupBy("base").cogroup(heads.groupBy("base")).applyInArrow(build, NODES)


def _first_turns(turns: DataFrame) -> DataFrame:
    """base, i, digest, chars: the first turns of conversations that are bases."""
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    some = turns.where(F.col("conv") % FAMILY == 0).withColumn("i", F.row_number().over(order)).where(F.col("i") < HEADS)
    return some.select(F.col("conv").alias("base"), "i", "digest", "chars")


def _chains(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes of long conversations, in chains of ``LONG`` turns.  The last node
    of the chain before stands at the head of each as a ghost, as the root
    stands at the head of the first."""
    from ..plans.ordering import global_rank

    keys = [F.col("conv"), F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), F.col("digest"), F.col("copy")]
    ranked = materialize(global_rank(turns.withColumn("copy", F.monotonically_increasing_id()), keys, "rank"), "ranked")
    per = ranked.groupBy("conv").agg(F.min("rank").alias("first"))
    base = F.col("conv") - F.col("conv") % FAMILY
    give = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")
    per = per.withColumn("give", give).withColumn("base", base)
    taken = per.join(heads, "base").where(F.col("i") <= F.col("give")).select("conv", "i", "digest", "chars")
    per = per.join(taken.groupBy("conv").agg(F.count("*").alias("taken")), "conv", "left").na.fill(0, ["taken"])
    own = ranked.join(per, "conv").withColumn("at", F.col("rank") - F.col("first")).where(F.col("at") >= F.col("give"))
    rebuilt = own.select("conv", (F.col("at") - F.col("give") + F.col("taken") + 1).alias("depth"), "digest", "chars").unionByName(
        taken.select("conv", F.col("i").cast("long").alias("depth"), "digest", "chars")
    )
    rebuilt = materialize(rebuilt.withColumn("chain", ((F.col("depth") - 1) / LONG).cast("int")), "rebuilt")
    last = rebuilt.groupBy("conv").agg(F.max("depth").alias("last"))

    def sums(key, rows):
        depth = rows.column("depth").to_numpy()
        with np.errstate(over="ignore"):
            h = turn_hashes(_words(rows.column("digest").combine_chunks()), depth).sum(0, dtype=np.uint64)
        top = rows.column("chars").to_numpy()[np.argmax(depth)]
        return pa.table({"conv": [key[0].as_py()], "chain": pa.array([key[1].as_py()], pa.int32()), "s1": h[:1].view(np.int64), "s2": h[1:].view(np.int64), "top": [int(top)]})

    totals = rebuilt.groupBy("conv", "chain").applyInArrow(sums, "conv long, chain int, s1 long, s2 long, top long")

    def starts(rows):  # one row for LONG turns
        rows = rows.sort_by("chain")
        with np.errstate(over="ignore"):
            s = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(rows.column(c).to_numpy().view(np.uint64), dtype=np.uint64)[:-1]]).view(np.int64) for c in ("s1", "s2")]
        before = np.concatenate([[0], rows.column("top").to_numpy()[:-1]]).astype(np.int64)
        return pa.table({"conv": rows.column("conv"), "chain": rows.column("chain"), "o1": s[0], "o2": s[1], "before": before})

    offsets = totals.groupBy("conv").applyInArrow(starts, "conv long, chain int, o1 long, o2 long, before long").join(last, "conv")

    def build(key, rows, start):
        rows = rows.sort_by("depth")
        conv, chain = key[0].as_py(), key[1].as_py()
        depth = np.concatenate([[chain * LONG], rows.column("depth").to_numpy()])
        offset = np.array([[start.column("o1")[0].as_py(), start.column("o2")[0].as_py()]], np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            h = offset + np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(turn_hashes(_words(rows.column("digest").combine_chunks()), depth[1:]), axis=0, dtype=np.uint64)])
        m, end = len(depth), start.column("last")[0].as_py()
        ghost = np.zeros(m, bool)
        ghost[0] = chain > 0
        kids = (depth < end).astype(int)
        p = np.concatenate([np.zeros((1, 2), np.uint64), h[:-1]])
        chars = np.concatenate([[start.column("before")[0].as_py()], rows.column("chars").to_numpy()])
        ends = [[conv] if d == end else [] for d in depth]
        return _unit_table(conv, chain, depth, h, np.arange(m) - 1, p, np.full(m, conv), np.ones(m, int), chars, kids, ghost, ends)

    return rebuilt.groupBy("conv", "chain").cogroup(offsets.groupBy("conv", "chain")).applyInArrow(build, NODES)


def _subtrees(units: DataFrame) -> DataFrame:
    """Parts of the numbers of each node, from ``units`` with what the merge says
    of their nodes: sums over what a unit owns below each of its nodes."""

    def add_up(rows):
        rows = rows.sort_by("node")
        get = lambda c: rows.column(c).to_numpy()
        depth, parent, mine = get("depth"), get("parent"), get("owned") & ~get("ghost")
        saved = np.where(mine, (get("all_n") - 1) * get("chars"), 0)
        leaves = np.where(mine & (get("all_kids") == 0), 1, 0)
        children = np.bincount(parent[mine & (parent >= 0)], minlength=len(parent))
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order], prepend=-2))
        if len(cuts) == len(order):  # a chain
            for v in (saved, leaves):
                v[order] = np.cumsum(v[order][::-1])[::-1]
        else:
            for a, b in reversed(list(zip(cuts, [*cuts[1:], len(order)]))):
                some = order[a:b]
                some = some[parent[some] >= 0]
                np.add.at(saved, parent[some], saved[some])
                np.add.at(leaves, parent[some], leaves[some])
        over = rows.column("all_conv").to_numpy()
        up = pa.array(np.where(parent >= 0, over[parent], 0), pa.int64(), mask=(parent < 0) | ~mine)
        return pa.table(
            {
                "u1": rows.column("u1"), "u2": rows.column("u2"), "depth": rows.column("depth"), "h1": rows.column("h1"), "h2": rows.column("h2"), "ghost": rows.column("ghost"),
                "all_conv": rows.column("all_conv"), "all_n": rows.column("all_n"), "up": up, "children": children, "leaves": leaves, "saved": saved,
            }
        )

    return units.groupBy("u1", "u2").applyInArrow(
        add_up, "u1 long, u2 int, depth int, h1 long, h2 long, ghost boolean, all_conv long, all_n long, up long, children long, leaves long, saved long"
    )


def _later_chains(parts: DataFrame) -> DataFrame:
    """Parts of chains with what the later chains of the same conversation own added."""
    top = parts.where("u2 >= 0").groupBy("u1", "u2").agg(F.max_by("leaves", -F.col("depth")).alias("l"), F.max_by("saved", -F.col("depth")).alias("s"))
    after = W.partitionBy("u1").orderBy("u2").rowsBetween(1, W.unboundedFollowing)
    more = top.select("u1", "u2", F.coalesce(F.sum("l").over(after), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(after), F.lit(0)).alias("s"))
    out = parts.join(more, ["u1", "u2"], "left")
    return out.withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0))).drop("l", "s")


def _ends(nodes: DataFrame) -> DataFrame:
    """depth, h1, h2, ends_sha256 of nodes where conversations end: ids stream by
    in order, those of one family are held at a time."""
    rows = nodes.where(F.size("ends") > 0).select("depth", "h1", "h2", F.expr(f"ends[0] - ends[0] % {FAMILY}").alias("base"), "ends")
    key = ["depth", "h1", "h2"]

    def stream(batches):
        now, base, held, sha, many = None, None, [], None, 0

        def flush():
            nonlocal many
            if held:
                sha.update(((b"," if many else b"") + ",".join(map(str, sorted(held))).encode()))
                many += len(held)
                held.clear()

        done: list[tuple] = []

        def batch():
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:3]), pa.array(cols[3])], [*key, "ends_sha256"])

        for b in batches:
            for d, x, y, at, ends in zip(*(c.to_pylist() for c in b.columns)):
                if (d, x, y) != now:
                    if now is not None:
                        flush()
                        done.append((*now, sha.hexdigest()))
                    now, base, sha, many = (d, x, y), at, hashlib.sha256(), 0
                if at != base:
                    flush()
                    base = at
                held += ends
            if done:
                yield batch()
                done.clear()
        if now is not None:
            flush()
            done.append((*now, sha.hexdigest()))
            yield batch()

    return rows.repartition(*key).sortWithinPartitions(*key, "base").mapInArrow(stream, "depth int, h1 long, h2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, one row per node."""
    turns = turns_of(conversations)
    heads = materialize(_first_turns(turns), "heads")
    long = materialize(turns.groupBy("conv").count().where(F.col("count") > LONG).select("conv"), "long")
    some = long.limit(1).count() > 0
    units = _families(turns.join(long, "conv", "left_anti") if some else turns, heads)
    if some:
        units = units.unionByName(_chains(turns.join(long, "conv", "left_semi"), heads))
    units = materialize(units, "units")
    key = ["depth", "h1", "h2"]
    unit = F.struct("u1", "u2")
    merged = units.where(~F.col("ghost")).groupBy(*key).agg(
        F.sum("n").alias("all_n"), F.min("conv").alias("all_conv"), F.max("kids").alias("all_kids"), F.min(unit).alias("owner")
    )
    known = units.drop("ends").join(merged, key).withColumn("owned", unit == F.col("owner")).drop("owner")
    parts = _subtrees(known)
    if some:
        parts = _later_chains(materialize(parts, "parts"))
    # a ghost is the last node of the chain before, which has what lies below it already, but not its child there
    add = lambda c: F.sum(F.when(F.col("ghost"), 0).otherwise(F.col(c)))
    nodes = parts.groupBy(*key).agg(
        F.min("all_conv").alias("conv_id"), F.max("up").alias("parent_conv_id"), F.max("all_n").alias("n_convs"), F.sum("children").alias("n_children"),
        add("leaves").alias("n_leaves"), add("saved").alias("saved_tokens"),
    )
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.join(_ends(units), key, "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
