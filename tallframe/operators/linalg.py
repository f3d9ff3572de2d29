"""Decompositions of tall matrices: small factors on the driver, rows distributed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elementwise import FEATURES
from .gram import FAN, as_block, gram, width

DAMP = 1e-14
#: rows and columns of a block, and blocks of sums that a task holds (2 MB each)
BLOCK, HELD = 512, 24
#: columns from which R factors are merged by a tree, up to which a row space is kept exactly
TREE, NARROW_R = 512, 256


def canonical(v: np.ndarray) -> np.ndarray:
    """Signs (+1, -1) that make the largest entry of each row positive, the
    first of equally large ones deciding."""
    at = np.argmax(np.round(np.abs(v), 12), axis=1)
    s = np.sign(v[np.arange(len(v)), at])
    return np.where(s == 0, 1.0, s)


def pinv(a: np.ndarray, rcond: float | None = None) -> np.ndarray:
    """V diag(1 / (s + 1e-14)) U^T; with ``rcond`` small values are cut instead."""
    u, s, vt = np.linalg.svd(np.asarray(a, float), full_matrices=False)
    if rcond is None:
        inv = 1 / (s + DAMP)
    else:
        inv = np.where(s > rcond * (s.max() if len(s) else 0), 1 / np.where(s > 0, s, 1), 0.0)
    return (vt.T * inv) @ u.T


def pinv_complex(a: np.ndarray) -> np.ndarray:
    """Complex pseudo-inverse with damping 1e-16 (1 + i)."""
    u, s, vh = np.linalg.svd(np.asarray(a, complex), full_matrices=False)
    return (vh.conj().T * (1 / (s + 1e-16 * (1 + 1j)))) @ u.conj().T


def sort_evd(values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs by descending signed value; stable."""
    order = np.argsort(-np.real(values), kind="stable")
    return values[order], vectors[:, order]


def eigh_desc(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric eigenpairs, descending, signs canonical."""
    w, v = sort_evd(*np.linalg.eigh(c))
    return w, v * canonical(v.T)


def eig_general(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.eig(a)


def _rows(x: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def times(m: DataFrame, right: np.ndarray) -> DataFrame:
    """Row matrix x small matrix (sent along; its size is checked)."""
    if right.nbytes > 256_000_000:
        raise ValueError("the right factor is too large to send to executors")
    shared = m.sparkSession.sparkContext.broadcast(right)

    def run(batches):
        r = shared.value
        for b in batches:
            if b.num_rows:
                out = as_block(b.column(1)) @ r
                yield pa.RecordBatch.from_arrays([b.column(0), _rows(out)], ["row_id", FEATURES])

    return m.select("row_id", FEATURES).mapInArrow(run, "row_id long, features array<double>")


def tall_product(a: DataFrame, b: DataFrame, beta: float = 1.0) -> np.ndarray:
    """beta a^T b for two row matrices with the same row ids: rows meet once, and
    each task adds up its part of the small product."""
    k, l = width(a), width(b)
    if a is b or a.sameSemantics(b):
        return beta * gram(a, k, "arrow").raw
    both = a.join(b.select("row_id", F.col(FEATURES).alias("right")), "row_id").select(F.concat(FEATURES, "right").alias(FEATURES))
    return beta * tall_t_times(both, None, lambda x: x[:, :k].T @ x[:, k:], k, l)


def matmul(a: DataFrame, b: DataFrame, beta: float = 1.0, size: int = BLOCK) -> DataFrame:
    """beta a b for coordinate matrices, as a product of blocks.

    Both sides are gathered into blocks of ``size`` x ``size`` (coordinates inside,
    so sparse ones stay small), which meet on the inner block number.  A task
    multiplies each pair densely and adds up products of one result block as
    long as it holds them; what is shuffled is blocks of both sides and of sums.
    Entries are returned where any product is, be their sum zero or not.
    a^T b of tall matrices is ``tall_product``, a tall one times a small one ``times``."""
    left = blocks(a, size).select(F.col("bi"), F.col("bj").alias("inner"), F.struct("r", "c", "v").alias("left"))
    right = blocks(b, size).select(F.col("bi").alias("inner"), F.col("bj"), F.struct("r", "c", "v").alias("right"))
    met = left.join(right, "inner").select("bi", "bj", "left", "right")

    def dense(cell):
        r, c, v = (np.asarray(cell.field(n).flatten()) for n in ("r", "c", "v"))
        out, has = np.zeros((size, size)), np.zeros((size, size), np.float32)
        np.add.at(out, (r, c), v)
        has[r, c] = 1
        return out, has

    def packed(held):
        parts = []
        for (i, j), (x, has) in held.items():
            r, c = np.nonzero(has)
            parts.append((i, j, r.astype(np.int32), c.astype(np.int32), x[r, c]))
        held.clear()
        lists = [pa.array([p[n] for p in parts], pa.list_(t)) for n, t in ((2, pa.int32()), (3, pa.int32()), (4, pa.float64()))]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.int64()), *lists], ["bi", "bj", "r", "c", "v"])

    def multiply(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                key = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                (x, p), (y, q) = dense(batch.column(2).slice(n, 1)), dense(batch.column(3).slice(n, 1))
                got = held.setdefault(key, [np.zeros((size, size)), np.zeros((size, size), np.float32)])
                got[0] += x @ y
                got[1] += p @ q
                if len(held) >= HELD:
                    yield packed(held)
        if held:
            yield packed(held)

    def added(key, rows):
        total, has = np.zeros((size, size)), np.zeros((size, size), bool)
        for n in range(rows.num_rows):
            r, c, v = (np.asarray(rows.column(name)[n].values) for name in ("r", "c", "v"))
            total[r, c] += v
            has[r, c] = True
        r, c = np.nonzero(has)
        return pa.table({"i": r + key[0].as_py() * size, "j": c + key[1].as_py() * size, "value": beta * total[r, c]})

    sums = met.mapInArrow(multiply, "bi long, bj long, r array<int>, c array<int>, v array<double>")
    kind = {f: a.schema["i"].dataType if f == "i" else b.schema["j"].dataType for f in ("i", "j")}
    out = sums.groupBy("bi", "bj").applyInArrow(added, "i long, j long, value double")
    return out.select(*(F.col(c).cast(t).alias(c) for c, t in kind.items()), "value")


def blocks(coo: DataFrame, size: int = BLOCK) -> DataFrame:
    """Block matrix of a coordinate one: (bi, bj) and the coordinates r, c and
    values v inside the block, at most ``size``^2 of them."""
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    rows = coo.select(cell("i").alias("bi"), cell("j").alias("bj"), "i", "j", F.col("value").cast("double").alias("v"))
    rows = rows.select("bi", "bj", (F.col("i") - F.col("bi") * size).cast("int").alias("r"), (F.col("j") - F.col("bj") * size).cast("int").alias("c"), "v")
    one = rows.groupBy("bi", "bj", "r", "c").agg(F.sum("v").alias("v"))  # entries given twice add up
    return one.groupBy("bi", "bj").agg(F.collect_list(F.struct("r", "c", "v")).alias("e")).select("bi", "bj", *(F.col(f"e.{n}").alias(n) for n in ("r", "c", "v")))


def tall_t_times(m: DataFrame, left: DataFrame | None, fn, rows: int, cols: int) -> np.ndarray:
    """Sum over batches of ``fn(block)``, a rows x cols array: partial sums per
    task, then FAN merged parts."""

    def partial(batches):
        from pyspark import TaskContext

        acc, seen = np.zeros((rows, cols)), False
        for b in batches:
            if b.num_rows:
                acc += fn(as_block(b.column(0)))
                seen = True
        if seen:
            part = TaskContext.get().partitionId() % FAN
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([acc.ravel()], pa.list_(pa.float64()))], ["part", "s"])

    def merged(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for p, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = v.values.to_numpy(zero_copy_only=False)
                held[p] = held[p] + x if p in held else np.array(x)
        for p in sorted(held):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([held[p]], pa.list_(pa.float64()))], ["part", "s"])

    schema = "part int, s array<double>"
    parts = m.select(FEATURES).mapInArrow(partial, schema).repartition(FAN, "part").mapInArrow(merged, schema)
    out = np.zeros(rows * cols)
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        out += np.asarray(r["s"])
    return out.reshape(rows, cols)


def _r_factor(m: DataFrame, right: np.ndarray | None, k: int) -> np.ndarray:
    """R of the thin QR of the rows (times ``right``, if given), by tall-skinny
    QR: a factor per task, then a reduction tree over executors.  Narrow factors
    are merged in one level and on the driver; from ``TREE`` columns on the
    driver gets one factor, in strips of rows."""
    shared = m.sparkSession.sparkContext.broadcast(right) if right is not None else None
    k = right.shape[1] if right is not None else k
    levels = [FAN] if k < TREE else [64, 8, 1]
    strip = max(1, (8 << 20) // (8 * k))

    def given(r: np.ndarray, part: int):
        for a in range(0, len(r), strip):
            some = r[a : a + strip]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([some.ravel()], pa.list_(pa.float64()))], ["part", "s"])

    def folded(r: np.ndarray, waiting: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, *waiting]), mode="r") if waiting else r

    def local(batches):
        from pyspark import TaskContext

        r, waiting, n = np.zeros((0, k)), [], 0
        for b in batches:
            if b.num_rows:
                x = as_block(b.column(0))
                waiting.append(x @ shared.value if shared else x)
                n += len(x)
                if n >= max(1024, k):  # few factorisations of many rows
                    r, waiting, n = folded(r, waiting), [], 0
        r = folded(r, waiting)
        if len(r):
            yield from given(r, TaskContext.get().partitionId() % levels[0])

    def merged(batches, to: int):
        held: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for p, v in zip(b.column(0).to_pylist(), b.column(1)):
                waiting.setdefault(p, []).append(v.values.to_numpy(zero_copy_only=False).reshape(-1, k))
                if sum(map(len, waiting[p])) >= k:
                    held[p] = folded(held.get(p, np.zeros((0, k))), waiting.pop(p))
        for p in sorted({*held, *waiting}):
            yield from given(folded(held.get(p, np.zeros((0, k))), waiting.get(p, [])), p % to)

    schema = "part int, s array<double>"
    parts = m.select(FEATURES).mapInArrow(local, schema)
    for n, to in zip(levels, [*levels[1:], 1]):
        parts = parts.repartition(n, "part").mapInArrow(lambda b, to=to: merged(b, to), schema)
    stack = [np.asarray(r["s"]).reshape(-1, k) for r in parts.collect()]
    return np.linalg.qr(np.vstack(stack), mode="r") if stack else np.zeros((0, k))


def thin_qr(m: DataFrame, k: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(Q as a row matrix, R): R by tall-skinny QR with a non-negative diagonal,
    Q = A R^-1 by row."""
    k = k or width(m)
    r = _r_factor(m, None, k)
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    r = r * s[:, None]
    return times(m, pinv(r)), r


@dataclass(frozen=True)
class Svd:
    """U (row matrix), s (r), vt (r x m)."""

    u: DataFrame
    s: np.ndarray
    vt: np.ndarray


def truncated_svd(m: DataFrame, rank: int, k: int | None = None) -> Svd:
    """Exact: tall-skinny R, small SVD on the driver, U = A V / s by row."""
    k = k or width(m)
    if rank > k:
        raise ValueError(f"rank {rank} exceeds {k}")
    _, s, vt = np.linalg.svd(_r_factor(m, None, k), full_matrices=False)
    s, vt = s[:rank], vt[:rank]
    vt = vt * canonical(vt)[:, None]
    inv = np.where(s > 0, 1 / np.where(s > 0, s, 1), 0.0)
    return Svd(times(m, vt.T * inv), s, vt)


def row_space(m: DataFrame, k: int, size: int, seed: int = 0, passes: int = 2) -> np.ndarray:
    """A small matrix C with C^T C = A^T A, or near it.

    Up to ``NARROW_R`` columns, or where the sketch would be as wide, C is the
    exact R factor.  Beyond, C = (Psi^T Q)^+ Psi^T A for two random sketches that
    one pass takes: the range Y = A Omega (only its R factor leaves the tasks,
    Q = Y R^-1) and the co-range Psi^T A, Psi being drawn from row ids.  A second
    pass, unless ``passes`` is 1, takes G = A^T A V for the sketch's leading row
    vectors V, and C = L^-1 G^T with L L^T = V^T G: what a sketch gets wrong is
    squared away."""
    if k <= NARROW_R or 2 * size >= k:
        return _r_factor(m, None, k)
    omega = np.random.default_rng([seed, 1]).standard_normal((k, size))
    wide = 2 * size + 1
    shared = m.sparkSession.sparkContext.broadcast(omega)

    def sketch(batches):
        from pyspark import TaskContext

        r, corange = np.zeros((0, size)), np.zeros((wide, k))
        for b in batches:
            if b.num_rows:
                x = as_block(b.column(1))
                psi = _signs(b.column(0).to_numpy(), wide, seed)
                corange += psi.T @ x
                r = np.linalg.qr(np.vstack([r, x @ shared.value]), mode="r")
        if len(r):
            part = TaskContext.get().partitionId() % FAN
            for kind, a in enumerate((r, corange)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([a.ravel()], pa.list_(pa.float64()))], ["part", "kind", "s"])

    def merged(batches):
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for p, kind, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = v.values.to_numpy(zero_copy_only=False).reshape(-1, k if kind else size)
                old = held.get((p, kind))
                held[p, kind] = np.array(x) if old is None else old + x if kind else np.linalg.qr(np.vstack([old, x]), mode="r")
        for (p, kind), x in sorted(held.items()):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([kind], pa.int32()), pa.array([x.ravel()], pa.list_(pa.float64()))], ["part", "kind", "s"])

    schema = "part int, kind int, s array<double>"
    parts = m.select("row_id", FEATURES).mapInArrow(sketch, schema).repartition(FAN, "part").mapInArrow(merged, schema).collect()
    corange, rs = np.zeros((wide, k)), [np.zeros((0, size))]
    for p in sorted(parts, key=lambda p: p["part"]):
        if p["kind"]:
            corange += np.asarray(p["s"]).reshape(wide, k)
        else:
            rs.append(np.asarray(p["s"]).reshape(-1, size))
    r = np.linalg.qr(np.vstack(rs), mode="r")
    c = pinv(corange @ omega @ pinv(r, rcond=1e-12), rcond=1e-12) @ corange
    if passes == 1:
        return c
    v = np.linalg.svd(c, full_matrices=False)[2].T
    sent = m.sparkSession.sparkContext.broadcast(v)
    g = tall_t_times(m, None, lambda x: x.T @ (x @ sent.value), k, v.shape[1])
    w, u = np.linalg.eigh(v.T @ g)
    return (u * np.where(w > 1e-13 * w.max(initial=0), 1 / np.sqrt(np.where(w > 0, w, 1)), 0.0)).T @ g.T


def _signs(ids: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n random signs for each row id, the same in whatever task it is."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(n, dtype=np.uint64) + np.uint64(1 + seed)) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.where((z ^ (z >> np.uint64(31))) & np.uint64(1), 1.0, -1.0)


def _iterated(c: np.ndarray, z: np.ndarray, n_iter: int) -> np.ndarray:
    """(C^T C)^n_iter z, rescaled and orthonormalised on the way."""
    for _ in range(n_iter):
        z = c.T @ (c @ z)
        z = z / (np.linalg.norm(z) or 1.0)
        z, _ = np.linalg.qr(z)
    return z


def power_iter(m: DataFrame, size: int, n_iter: int, k: int, seed: int = 0) -> np.ndarray:
    """Right factor Z (k x size) such that A Z spans the range sketch.  The
    matrix is read once, for its row space; A^T (A Z) of every iteration is taken
    of that."""
    z, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, size)))
    return _iterated(row_space(m, k, size * (1 + n_iter), seed), z, n_iter)


def random_svd(m: DataFrame, rank: int, n_iter: int = 10, n_oversamples: int = 10, seed: int = 0, k: int | None = None, passes: int = 2) -> Svd:
    """Randomized SVD of a tall row matrix in one scan, or two of a wide one.

    Where a sketch of ``rank`` + ``n_oversamples`` columns would be iterated
    ``n_iter`` times, one of as many columns more is taken in the same pass as its
    co-range (``row_space``), and the iterations run on that small matrix."""
    k = k or width(m)
    if rank > k:
        raise ValueError(f"rank {rank} exceeds {k}")
    size = min(rank + n_oversamples, k)
    c = row_space(m, k, size * (1 + n_iter), seed, passes)
    z, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, size)))
    q, _ = np.linalg.qr(c @ _iterated(c, z, n_iter))
    _, s, vt = np.linalg.svd(q.T @ c, full_matrices=False)
    if len(s) < rank:  # fewer rows than columns
        s, vt = np.append(s, np.zeros(rank - len(s))), np.linalg.svd(c)[2]
    s, vt = s[:rank], vt[:rank]
    vt = vt * canonical(vt)[:, None]
    inv = np.where(s > 1e-13 * s.max(initial=0), 1 / np.where(s > 0, s, 1), 0.0)
    return Svd(times(m, vt.T * inv), s, vt)


def gram_svd(m: DataFrame, rank: int, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(s, vt) from the Gram matrix: one pass, but squares the condition number."""
    w, v = eigh_desc(gram(m, k).raw)
    return np.sqrt(np.maximum(w[:rank], 0)), v[:, :rank].T


def rsvd_local(a: np.ndarray, rank: int, n_iter: int, n_oversamples: int, seed: int = 0):
    """Randomized SVD of a small matrix on the driver: (U, s, Vt).  Fat input is
    transposed first."""
    a = np.asarray(a, float)
    if rank > min(a.shape):
        raise ValueError(f"rank {rank} exceeds {min(a.shape)}")
    if a.shape[0] < a.shape[1]:
        u, s, vt = rsvd_local(a.T, rank, n_iter, n_oversamples, seed)
        return vt.T, s, u.T
    size = min(rank + n_oversamples, a.shape[1])
    y = a @ np.random.default_rng(seed).standard_normal((a.shape[1], size))
    for _ in range(n_iter):
        y, _ = np.linalg.qr(y)
        y = a @ (a.T @ y)
        y = y / (np.linalg.norm(y) or 1.0)
    q, _ = np.linalg.qr(y)
    u, s, vt = np.linalg.svd(q.T @ a, full_matrices=False)
    sign = canonical(vt[:rank])
    return (q @ u[:, :rank]) * sign, s[:rank], vt[:rank] * sign[:, None]


def power_iter_plain(m: DataFrame, size: int, n_iter: int, k: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(Q as a row matrix, right factor Z with Q = A Z): A (A^T A)^n_iter Omega
    without any rescaling, one QR at the end; the matrix is read once."""
    c = row_space(m, k, size * (1 + n_iter), seed)
    z = np.random.default_rng(seed).standard_normal((k, size))
    for _ in range(n_iter):
        z = c.T @ (c @ z)
    z = z @ pinv(np.linalg.qr(c @ z, mode="r"), rcond=1e-12)
    return times(m, z), z


def rsvd_plain(m: DataFrame, rank: int = 4, n_oversamples: int = 4, n_iter: int = 8, seed: int = 0, k: int | None = None) -> Svd:
    """Randomized SVD on plain power iterations; the sketch may be wider than the
    matrix, what is beyond its rank comes to nothing."""
    k = k or width(m)
    size = rank + n_oversamples
    c = row_space(m, k, size * (1 + n_iter), seed)
    z = np.random.default_rng(seed).standard_normal((k, size))
    for _ in range(n_iter):
        z = c.T @ (c @ z)
    u, d, _ = np.linalg.svd(c @ z, full_matrices=False)
    _, s, vt = np.linalg.svd(u[:, d > 1e-12 * d.max(initial=0)].T @ c, full_matrices=False)
    rank = min(rank, len(s))
    s, vt = s[:rank], vt[:rank] * canonical(vt[:rank])[:, None]
    return Svd(times(m, vt.T * np.where(s > 0, 1 / np.where(s > 0, s, 1), 0.0)), s, vt)
