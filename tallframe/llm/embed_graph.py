"""Embedding near-duplicates over a robust-pruned flat graph.

1.  Equal vectors become one node with a count.  Nodes that lie within
    ``BALL`` degrees of a leader met in the same task fold into a ball: any
    two of its vectors are linked, so dense groups are counted, not paired.
2.  Balls go to the shards of their ``OVERLAP`` nearest centroids (k-means on
    a bounded sample, ``SAMPLE`` nodes); shards that grow large are split again.  Each shard builds a flat graph by
    robust pruning, and the adjacency lists of a ball's shards are united.
3.  Each shard searches for the balls at home in it, over its members and the
    outside neighbours of these balls with their united lists: a greedy beam search from the medoid, then
    expansion of everything within range until nothing new is in range.
4.  Pairs found are verified in double precision.  Two balls are linked as
    wholes if even their farthest vectors are; if the radii leave it open,
    their vectors are compared one by one.
5.  ``audit`` measures recall against brute force.

Vectors that are null, zero, or hold null or non-finite components link with
nothing: no links, a component of their own.  Vectors of different lengths
never link.  Rows with equal vectors link with each other; a row with a null id
has its links but gives no component its name.  An empty table gives an empty
result.  Only key and vector are read, so other columns may have any names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

COSINE = 0.95
#: below half of the linking angle (18.19 degrees), so that all of a ball is linked
BALL = 9.0
OVERLAP = 3
SAMPLE = 8192
#: balls of a shard, centres of the first level, balls above which a shard is split into FINE
SHARD, MAX_SHARDS, SPLIT, FINE = 400, 4096, 6000, 16
#: vectors that a worker holds while it folds them into balls
HELD = 40_000
#: cosines that a search holds at once
CELLS = 4_000_000
DEGREE = 16
BEAM = 24
ALPHA = 1.2
EPS = 1e-9


def usable(r: list | None) -> bool:
    """Whether a raw vector is non-null, non-zero and finite throughout."""
    return bool(r) and all(x is not None for x in r) and bool(np.isfinite(v := np.asarray(r, np.float64)).all()) and bool(v.any())


def unit(rows) -> np.ndarray:
    """Unit vectors, in double precision, of usable vectors of one length."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def unit_column(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a column of usable vectors of one length, from its flat buffer."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return unit(flat.to_numpy(zero_copy_only=False).reshape(len(column), -1))


def centroids(vectors: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means of the sample."""
    rng = np.random.default_rng(seed)
    c = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(vectors @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, vectors)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], c)
    return c


def leaders(x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(leader index of each row, cosine to it): greedy, in row order."""
    lead, cos = np.full(len(x), -1), np.ones(len(x))
    for i in range(len(x)):
        if lead[i] >= 0:
            continue
        rest = np.flatnonzero(lead[i:] < 0) + i
        c = x[rest] @ x[i]
        c[0] = 1.0
        mine = c >= limit
        lead[rest[mine]], cos[rest[mine]] = i, c[mine]
    return lead, cos


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 64) -> list[np.ndarray]:
    """Adjacency of a flat graph: from each point's nearest candidates keep the
    closest, drop those that are ``alpha`` times closer to a kept one than to
    the point, and so on; then add reverse edges."""
    n = len(x)
    out: list[set] = [set() for _ in range(n)]
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        m = min(pool, n - 1)
        if m < 1:
            break
        cand = np.argpartition(-sims, m - 1, axis=1)[:, :m]
        dist = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, cand, 1)))
        order = np.argsort(dist, axis=1)
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        alive = np.ones(cand.shape, bool)
        kept = np.zeros(len(cand), int)
        for j in range(m):  # all points of the strip at once, candidate by candidate
            take = alive[:, j] & (kept < degree)
            rows = np.flatnonzero(take)
            if not len(rows):
                continue
            kept[rows] += 1
            for r in rows.tolist():
                out[a + r].add(int(cand[r, j]))
            gap = np.einsum("rd,rmd->rm", x[cand[rows, j]], x[cand[rows]])
            gap = np.sqrt(np.maximum(0, 2 - 2 * gap))
            alive[rows] &= (alpha * gap > dist[rows]) | (np.arange(m) <= j)
    for i in range(n):
        for j in list(out[i]):
            if len(out[j]) < 2 * degree:
                out[j].add(i)
    return [np.array(sorted(s), np.int64) for s in out]


def padded(owner: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """Adjacency as an array of ``n`` rows, -1 behind their ends; ``owner`` is in order."""
    count = np.bincount(owner, minlength=n)
    table = np.full((n, max(1, int(count.max(initial=0)))), -1)
    table[owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)] = other
    return table


def range_search(x: np.ndarray, nbrs: list[np.ndarray] | np.ndarray, queries: np.ndarray, start: int, need: np.ndarray, beam: int = BEAM):
    """(query row, node, cosine) of nodes with cosine >= ``need[query]``:
    greedy from ``start`` for ``beam`` expansions, then as long as an
    unexpanded node is in range.  All queries advance together.  ``nbrs`` is a
    list of arrays or an array as ``padded`` makes it."""
    n = len(x)
    if isinstance(nbrs, list):
        nbrs = padded(np.repeat(np.arange(n), [len(b) for b in nbrs]), np.concatenate([np.zeros(0, np.int64), *nbrs]), n)
    sims = np.full((len(queries), n), -2.0)
    sims[:, start] = x[queries] @ x[start]
    open_ = sims.copy()  # as ``sims``, below -2 for nodes that are expanded
    q = np.arange(len(queries))
    step = 0
    while len(q):
        best = np.argmax(open_, axis=1)
        top = open_[np.arange(len(q)), best]
        go = (top > -2) if step < beam else (top >= need[q])
        if not go.all():
            q, best, open_ = q[go], best[go], open_[go]
        at = np.arange(len(q))
        open_[at, best] = -3.0
        near = nbrs[best]
        fresh = (near >= 0) & (sims[q[:, None], np.maximum(near, 0)] <= -2)
        r, c = np.nonzero(fresh)
        node = near[r, c]
        sims[q[r], node] = open_[r, node] = np.einsum("rd,rd->r", x[queries[q[r]]], x[node])
        step += 1
    row, node = np.nonzero(sims >= need[:, None])
    return row, node, sims[row, node]


def _digest() -> list:
    """128 bits that tell vectors apart in joins."""
    return [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]


def _split(routed: DataFrame) -> DataFrame:
    """``routed`` with shards of over ``SPLIT`` balls dealt to finer ones, level
    by level: the ``FINE`` members with the least hash in a shard are its new
    centres, and each ball goes to the two nearest, the first being home if the
    shard was.  Centres are joined by shard, so nothing grows on the driver."""
    kind = routed.schema["u"].dataType.simpleString()
    parts, before = [routed], None
    while True:
        coarse = parts.pop()
        sizes = coarse.groupBy("shard").agg(F.count("*").alias("size"))
        large = materialize(sizes.where(F.col("size") > SPLIT), "large")
        most = large.agg(F.max("size")).first()[0]
        large = large.select("shard")
        if most is None or before and most > 0.9 * before:  # vectors that no centres tell apart stay together
            return reduce(DataFrame.unionByName, [*parts, coarse])
        parts.append(coarse.join(large, "shard", "left_anti"))
        crowd = coarse.join(large, "shard")
        # the smallest structs of a shard, kept while rows stream by
        order = F.struct(F.xxhash64("bid").alias("o"), "u")
        centres = crowd.groupBy("shard", F.pmod(F.xxhash64("bid"), F.lit(FINE)).alias("cell")).agg(F.min(order).alias("c"))
        centres = centres.groupBy("shard").agg(F.sort_array(F.collect_list("c")).alias("c")).select("shard", F.transform("c", lambda c: c["u"]).alias("c"))

        def deal(batches):
            for b in batches:
                out = []
                for shard, home, bid, rho, u, c in zip(*(b.column(i).to_pylist() for i in range(6))):
                    near = np.argsort(-(unit(c) @ unit([u])[0]), kind="stable")[:2].tolist()
                    out += [(f"{shard}/{x}", home and not i, bid, rho, u) for i, x in enumerate(near)]
                yield _batch(out, b.schema.field(4).type)

        finer = crowd.join(centres, "shard").select("shard", "home", "bid", "rho", "u", "c")
        before = most
        parts.append(materialize(finer.mapInArrow(deal, f"shard string, home boolean, bid long, rho double, u {kind}"), "finer"))


def _batch(rows: list, kind) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.float64(), kind]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["shard", "home", "bid", "rho", "u"])


def links(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    spark = vectors.sparkSession
    theta = float(np.arccos(cosine))
    rows = vectors.select(F.col(key).alias("key"), F.col(column).alias("embedding"))

    def clean(batches):
        for b in batches:
            ok = pa.array([usable(r) for r in b.column(3).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in range(5)], ["h1", "h2", "least", "u", "n"])

    kind, raw_kind = (vectors.schema[c].dataType.simpleString() for c in (key, column))
    distinct = rows.groupBy("embedding").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    raw = distinct.select(*_digest(), "least", "embedding", "n")
    good = raw.mapInArrow(clean, f"h1 long, h2 long, least {kind}, u {raw_kind}, n long")
    nodes = materialize(good.select(F.monotonically_increasing_id().alias("nid"), "*"), "nodes")
    total = nodes.count()
    picked = [r["u"] for r in nodes.orderBy("h1", "h2").limit(SAMPLE).select("u").collect()]
    centres: dict[int, np.ndarray] = {}
    for d in {len(u) for u in picked}:
        same = unit([u for u in picked if len(u) == d])
        centres[d] = centroids(same, max(1, min(MAX_SHARDS, total // SHARD, len(same) // 2)))
    shared = spark.sparkContext.broadcast(centres)  # at most SAMPLE / 2 vectors

    def fold(batches):
        """Balls of a task's rows, those of a nearest centroid together."""
        c = shared.value
        held: dict[tuple, list] = {}
        size = 0

        def balls(rows_):
            x = unit([r[2] for r in rows_])
            lead, cos = leaders(x, float(np.cos(np.radians(BALL))))
            for i, (r, j) in enumerate(zip(rows_, lead.tolist())):
                yield r[0], rows_[j][0], float(np.arccos(min(1.0, cos[i]))), r[1], r[3], r[2]

        def out(found):
            cols = list(zip(*found)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), *types[:1], pa.int64(), *types[1:]]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(cols, kinds)], ["nid", "bid", "rho", "least", "n", "u"]
            )

        types: list = []
        for b in batches:
            types[:] = [b.schema.field(1).type, b.schema.field(2).type]
            for r in zip(*(b.column(i).to_pylist() for i in range(4))):
                (u,) = unit([r[2]])
                home = int(np.argmax(c[len(u)] @ u)) if len(u) in c else -1
                group = held.setdefault((len(u), home), [])
                group.append(r)
                size += 1
                if len(group) >= 2000:
                    yield out(list(balls(group)))
                    size -= len(group)
                    group.clear()
                if size >= HELD:  # the largest go, so that what stays is few and far between
                    for group in sorted(held.values(), key=len)[-len(held) // 2 :]:
                        if group:
                            yield out(list(balls(group)))
                            size -= len(group)
                            group.clear()
        for group in held.values():
            if group:
                yield out(list(balls(group)))

    members = materialize(
        nodes.select("nid", "least", "u", "n").mapInArrow(fold, f"nid long, bid long, rho double, least {kind}, n long, u {raw_kind}"), "members"
    )
    sizes = members.groupBy("bid").agg(F.max("rho").alias("rho"), F.sum("n").alias("w"), F.min("least").alias("least"))
    balls = materialize(
        members.where("nid = bid").select("bid", "u").join(sizes, "bid"), "balls"
    )

    def route(batches):
        """(shard, home, bid, rho, u): nearest centroids, the first is home."""
        c = shared.value
        for b in batches:
            out = []
            for bid, u, rho in zip(*(b.column(i).to_pylist() for i in range(3))):
                if len(u) in c:
                    s = c[len(u)] @ unit([u])[0]
                    near = np.argsort(-s, kind="stable")[:OVERLAP].tolist()
                else:
                    near = [0]
                out += [(f"{len(u)}:{x}", i == 0, bid, rho, u) for i, x in enumerate(near)]
            yield _batch(out, b.schema.field(1).type)

    routed = materialize(
        balls.select("bid", "u", "rho").mapInArrow(route, f"shard string, home boolean, bid long, rho double, u {raw_kind}"), "routed"
    )
    routed = _split(routed)

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("bid").to_numpy()
        nbrs = robust_prune(unit_column(table.column("u")))
        return pa.table({"bid": ids, "nbrs": pa.array([ids[x] for x in nbrs], pa.list_(pa.int64()))})

    lists = routed.groupBy("shard").applyInArrow(build, "bid long, nbrs array<long>")
    united = materialize(
        lists.groupBy("bid").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs")), "lists"
    )
    inside = routed.join(united, "bid", "left")
    outside = (
        inside.where("home").select("shard", F.explode("nbrs").alias("bid")).distinct()
        .join(routed.select("shard", "bid"), ["shard", "bid"], "left_anti")
    )
    halo = outside.join(balls.select("bid", "rho", "u"), "bid")
    region = inside.select("shard", "home", "bid", "rho", "u", "nbrs").unionByName(
        halo.join(united, "bid", "left").select("shard", F.lit(False).alias("home"), "bid", "rho", "u", "nbrs")
    )

    def search(table: pa.Table) -> pa.Table:
        """Pairs (q, p, cosine) of balls whose vectors may be linked."""
        table = table.sort_by("bid")
        ids = table.column("bid").to_numpy()
        x, rho = unit_column(table.column("u")), table.column("rho").to_numpy()
        lists = table.column("nbrs")
        owner = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        other = pa.concat_arrays([c.flatten() for c in lists.chunks]).to_numpy()
        at = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
        here = ids[at] == other
        nbrs = padded(owner[here], at[here], len(ids))
        home = np.flatnonzero(table.column("home").to_numpy(zero_copy_only=False))
        mean = x.mean(0)
        start = int(np.argmax(x @ mean))
        found = []
        strip = max(1, min(256, CELLS // len(ids)))
        for a in range(0, len(home), strip):
            q = home[a : a + strip]
            need = np.cos(np.minimum(np.pi, theta + rho[q] + rho.max() + EPS))
            row, node, cos = range_search(x, nbrs, q, start, need)
            ok = (ids[q[row]] != ids[node]) & (np.arccos(np.clip(cos, -1, 1)) <= theta + rho[q[row]] + rho[node] + EPS)
            found.append((ids[q[row]][ok], ids[node][ok], cos[ok]))
        q, p, cos = (np.concatenate(z) for z in zip(*found)) if found else (np.array([], np.int64),) * 2 + (np.array([]),)
        return pa.table({"a": np.minimum(q, p), "b": np.maximum(q, p), "cos": pa.array(cos, pa.float64())})

    pairs = region.groupBy("shard").applyInArrow(search, "a long, b long, cos double").groupBy("a", "b").agg(F.max("cos").alias("cos"))
    size = sizes.select("bid", "rho")
    pairs = pairs.join(size.select(F.col("bid").alias("a"), F.col("rho").alias("ra")), "a").join(
        size.select(F.col("bid").alias("b"), F.col("rho").alias("rb")), "b"
    )
    spread = F.col("ra") + F.col("rb")
    angle = F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0)))
    points = spread == 0
    whole = F.when(points, F.col("cos") >= cosine).otherwise(angle + spread + EPS <= theta)
    pairs = materialize(pairs.select("a", "b", whole.alias("whole"), points.alias("points")), "pairs")
    bulk = pairs.where("whole").select("a", "b")
    open_ = pairs.where("not whole and not points").select("a", "b")

    def compare(table: pa.Table) -> pa.Table:
        """Links of each vector across one pair of balls."""
        side = np.array(table.column("side").to_pylist())
        x, n, nid = unit_column(table.column("u")), table.column("n").to_numpy(), table.column("nid").to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        got = np.zeros(len(nid), np.int64)
        for i in range(0, len(a), 1024):
            hit = x[a[i : i + 1024]] @ x[b].T >= cosine
            got[a[i : i + 1024]] += hit @ n[b]
            got[b] += n[a[i : i + 1024]] @ hit
        ends = [table.column(c)[0].as_py() for c in ("a", "b")]
        ok = np.flatnonzero(got)
        return pa.table({"nid": nid[ok], "more": got[ok], "a": pa.array([ends[0]] * len(ok), pa.int64()), "b": pa.array([ends[1]] * len(ok), pa.int64())})

    m = members.select("bid", "nid", "n", "u")
    sides = open_.join(m, open_["a"] == m["bid"]).select("a", "b", F.lit(0).alias("side"), "nid", "n", "u").unionByName(
        open_.join(m, open_["b"] == m["bid"]).select("a", "b", F.lit(1).alias("side"), "nid", "n", "u")
    )
    fine = materialize(sides.groupBy("a", "b").applyInArrow(compare, "nid long, more long, a long, b long"), "fine")

    w = sizes.select("bid", "w")
    ways = bulk.select(F.col("a").alias("me"), F.col("b").alias("bid")).unionByName(bulk.select(F.col("b").alias("me"), F.col("a").alias("bid")))
    over = ways.join(w, "bid").groupBy("me").agg(F.sum("w").alias("over"))
    edges = bulk.unionByName(fine.select("a", "b"))
    labels = connected_components(edges)
    named = sizes.join(labels.withColumnRenamed("id", "bid"), "bid", "left").withColumn("component", F.coalesce("component", "bid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_ball = named.join(least, "component").join(over.withColumnRenamed("me", "bid"), "bid", "left").select(
        "bid", "component_id", (F.col("w") - 1 + F.coalesce("over", F.lit(0))).alias("base")
    )
    more = fine.groupBy("nid").agg(F.sum("more").alias("more"))
    per_node = members.select("nid", "bid").join(per_ball, "bid").join(more, "nid", "left").select(
        "nid", "component_id", (F.col("base") + F.coalesce("more", F.lit(0))).alias("n_links")
    )
    named = nodes.select("h1", "h2", "nid").join(per_node, "nid")
    out = rows.select("key", *_digest()).join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "key")
    return out.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )


def audit(vectors: DataFrame, result: DataFrame, key: str = "vec_id", column: str = "embedding", queries: int = 200, cosine: float = COSINE) -> float:
    """Share of true links that ``result`` counts, for ``queries`` rows (by hash
    of the id, a stated bound) compared with all rows by brute force."""
    picked = vectors.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(queries).collect()
    shared = vectors.sparkSession.sparkContext.broadcast([(r[key], r[column]) for r in picked])

    def count(batches):
        q = [(k, unit([v])[0]) for k, v in shared.value if usable(v)]
        for b in batches:
            rows = [r for r in b.column(0).to_pylist() if usable(r)]
            n = np.zeros(len(q), np.int64)
            for d in {len(r) for r in rows}:
                x = unit([r for r in rows if len(r) == d])
                for i, (_, u) in enumerate(q):
                    if len(u) == d:
                        n[i] += int((x @ u >= cosine).sum())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in q], pa.int64()), pa.array(n)], ["id", "true"])

    truth = vectors.select(column).mapInArrow(count, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    both = truth.join(result, truth["id"] == result[key]).select((F.greatest(F.col("true") - 1, F.lit(0))).alias("t"), "n_links")
    found, true = both.agg(F.sum(F.least("t", "n_links")), F.sum("t")).first()
    return 1.0 if not true else found / true
