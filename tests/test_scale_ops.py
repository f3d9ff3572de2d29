"""Distributed forms of operators against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallframe.functions import distributions as dist, kde
from tallframe.operators import active
from tallframe.plans import ordering


def test_tree_search_equals_all_distances():
    rng = np.random.default_rng(0)
    for n_points in (1, 5, 64, 65, 300, 1000):
        for k in (1, 2, 3):
            x, ids = rng.integers(0, 6, (n_points, k)).astype(float), rng.permutation(n_points)
            index = active.Index(ids, x, 8)
            q = rng.integers(-1, 7, (40, k)).astype(float)
            for reach in (None, rng.integers(0, 9, 40).astype(float)):
                row, at, d = index.search(q, 7, reach)
                for i in range(len(q)):
                    far = ((q[i] - x) ** 2).sum(1)
                    want = np.lexsort((ids, far))[:7]
                    want = want if reach is None else want[far[want] <= reach[i]]
                    assert index.ids[at[row == i]].tolist() == ids[want].tolist() and d[row == i].tolist() == far[want].tolist()


def test_tree_search_cost_hardly_grows():
    """Leaves met per query stay the same from 5,000 to 80,000 points."""
    rng = np.random.default_rng(1)
    met = []
    for n_points in (5_000, 80_000):
        x = rng.standard_normal((n_points, 2))
        index = active.Index(np.arange(n_points), x)
        q = x[:500]
        _, _, d = index.search(q, 14)
        met.append(len(index.reached(q, d.reshape(500, 14)[:, -1])[0]))
    assert met[1] < 1.5 * met[0]


def test_knn_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((600, 2)), np.zeros((300, 2)), rng.standard_normal((5, 2)) + 50])
    q = np.concatenate([rng.standard_normal((40, 2)) * 3, np.zeros((200, 2)), [[200.0, 200.0]]])
    frame = lambda a: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "row_id long, features array<double>").repartition(3)
    monkeypatch.setattr(active, "SEND", 0)
    monkeypatch.setattr(active, "BLOCK", 50)
    got = {}
    for r in active.knn(frame(x), frame(q), 12, 2).collect():
        got.setdefault(r.q, []).append((r["rank"], r.row_id, r.d2))
    for i, p in enumerate(q):
        far = ((p - x) ** 2).sum(1)
        want = np.lexsort((np.arange(len(x)), far))[:12]
        assert [r[1:] for r in sorted(got[i])] == [(int(j), far[j]) for j in want]
    assert active.knn(spark.createDataFrame([], "row_id long, features array<double>"), frame(q), 3, 2).count() == 0


def test_ranks_and_running_sums(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, 5000)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x)], "row_id long, x int").repartition(7)
    ranked = ordering.global_rank(df, [-F.col("x"), F.col("row_id")], "rank")
    assert ranked.columns == ["row_id", "x", "rank"]
    got = sorted((r["rank"], r.row_id) for r in ranked.collect())
    assert got == list(enumerate(np.lexsort((np.arange(5000), -x)).tolist()))
    sums = ordering.running_sum(df, [F.col("row_id")], "x", "total").collect()
    assert [r.total for r in sorted(sums, key=lambda r: r.row_id)] == np.cumsum(x).tolist()
    assert ordering.global_rank(df.where("x > 9"), [F.col("row_id")], "rank").count() == 0


@pytest.mark.parametrize("h", [0.01, 0.3, 5.0, 200.0])
def test_kernel_sums(spark, h):
    rng = np.random.default_rng(4)
    s, x = np.concatenate([rng.normal(0, 3, 400), [80.0, -300.0]]), np.concatenate([rng.normal(0, 5, 150), [500.0, -500.0]])
    w = rng.random(len(s))
    support = spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, w)] + [(None, 1.0)], "s double, w double").repartition(3)
    queries = spark.createDataFrame([(i, float(v), "t") for i, v in enumerate(x)] + [(-1, None, "t")], "q long, x double, t string")
    u = (x[:, None] - s) / h
    pdf, cdf = np.exp(-0.5 * u * u) / (h * np.sqrt(2 * np.pi)), 0.5 * (1 + dist._ERF(u / np.sqrt(2)))
    for cumulative, values, tol in ((False, pdf, 1e-12 / h), (True, cdf, 1e-11)):
        for weight, want in ((None, values.mean(1)), ("w", values @ w)):
            out = kde.kernel_sums(queries, support, h, weight=weight, cumulative=cumulative)
            assert out.columns == ["q", "x", "t", "density"]
            got = {r.q: r.density for r in out.collect()}
            assert got.pop(-1) is None
            assert max(abs(got[i] - v) for i, v in enumerate(want)) < max(tol, 1e-13) * len(s)
    none = kde.kernel_sums(queries, support.limit(0), h).agg(F.max("density")).first()[0]
    assert none == 0.0


def test_bandwidth_is_the_same_for_tables_and_arrays(spark):
    rng = np.random.default_rng(5)
    s, x = rng.normal(5, 10, 80), rng.normal(5, 10, 70)
    frame = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    nan = np.append(x, np.nan)
    for weights in (None, rng.random(80)):
        rv = dist.KdeRv(1.0, s, weights)
        a, b = rv.est_bandwidth(nan), rv.est_bandwidth(frame, "x")
        assert abs(a / b - 1) < 1e-3
        w = np.full(80, 1 / 80) if weights is None else weights
        best = dist._kernel_nll(x, s, w, a)
        assert all(best <= dist._kernel_nll(x, s, w, a * f) + 1e-6 for f in (0.5, 0.9, 0.99, 1.01, 1.1, 2.0))
    support = spark.createDataFrame([(float(v),) for v in s], "s double")
    assert abs(dist.estimated_bandwidth(support, frame) / dist.KdeRv(1.0, s).est_bandwidth(x) - 1) < 1e-3
    for method in (0, 2):
        assert abs(dist.KdeRv(1.0, s).est_bandwidth(x, method=method) / dist.KdeRv(1.0, s).est_bandwidth(x) - 1) < 2e-3


def frame(spark, a, parts=3):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.atleast_2d(a))], "row_id long, features array<double>").repartition(parts)


def test_block_products(spark, monkeypatch):
    from tallframe.operators import linalg

    rng = np.random.default_rng(6)
    for n, k, m, size in ((23, 41, 17, 8), (30, 5, 30, 7), (3, 3, 3, 512)):
        a, b = rng.standard_normal((n, k)) * (rng.random((n, k)) < 0.4), rng.standard_normal((k, m)) * (rng.random((k, m)) < 0.4)
        coo = lambda x: spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "i int, j int, value double").repartition(3)
        for held in (1, 24):
            monkeypatch.setattr(linalg, "HELD", held)
            got = linalg.matmul(coo(a), coo(b), 2.0, size).collect()
            want = 2 * a @ b
            some = (a != 0).astype(int) @ (b != 0).astype(int) > 0
            assert {(r.i, r.j) for r in got} == set(zip(*map(lambda v: v.tolist(), np.nonzero(some)))) and all(abs(r.value - want[r.i, r.j]) < 1e-12 for r in got)
    plan = linalg.matmul(coo(a), coo(b))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "MapInArrow" in plan  # blocks meet, products don't
    assert linalg.matmul(coo(a).limit(0), coo(b)).count() == 0


@pytest.mark.parametrize("tree", [512, 2])
def test_merged_factors(spark, monkeypatch, tree):
    from tallframe.operators import linalg

    monkeypatch.setattr(linalg, "TREE", tree)
    a = np.random.default_rng(7).standard_normal((2500, 40))
    r = linalg._r_factor(frame(spark, a, 9), None, 40)
    assert r.shape == (40, 40) and np.abs(r.T @ r - a.T @ a).max() < 1e-9
    q, r = linalg.thin_qr(frame(spark, a, 9), 40)
    found = np.array([x.features for x in q.orderBy("row_id").collect()])
    assert np.abs(found @ r - a).max() < 1e-9 and np.abs(found.T @ found - np.eye(40)).max() < 1e-9


def test_factors_of_many_columns(spark, monkeypatch):
    """1,500 columns go through the tree; what reaches the driver is one factor."""
    from tallframe.operators import linalg

    a = np.random.default_rng(8).standard_normal((1700, 1500))
    r = linalg._r_factor(frame(spark, a, 4), None, 1500)
    assert np.abs(r.T @ r - a.T @ a).max() < 1e-8


def test_one_scan_sketch(spark, monkeypatch):
    from tallframe.operators import linalg

    monkeypatch.setattr(linalg, "NARROW_R", 4)
    rng = np.random.default_rng(9)
    low = np.linalg.qr(rng.standard_normal((400, 5)))[0] @ np.diag([9.0, 5, 3, 2, 1]) @ np.linalg.qr(rng.standard_normal((300, 5)))[0].T
    m = frame(spark, low, 5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would count each stage as a job
    spark.sparkContext.setJobGroup("sketch", "sketch")
    found = linalg.random_svd(m, 5, 2, 10, k=300, passes=1)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("sketch")) == 1
    spark.sparkContext.setJobGroup("rest", "rest")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert np.abs(found.s - [9, 5, 3, 2, 1]).max() < 1e-6
    u = np.array([x.features for x in found.u.orderBy("row_id").collect()])
    assert np.abs((u * found.s) @ found.vt - low).max() < 1e-6
    noisy = low + 0.01 * rng.standard_normal(low.shape)
    s = np.linalg.svd(noisy, compute_uv=False)
    got = linalg.random_svd(frame(spark, noisy, 5), 5, 4, 10, k=300).s
    assert np.abs(got / s[:5] - 1).max() < 0.002
    tiny = np.zeros((5, 5))
    tiny[0, 0], tiny[0, 4], tiny[1, 2], tiny[4, 1] = 1, 2, 3, 2
    assert np.abs(linalg.random_svd(frame(spark, tiny), 5, 12, 10, k=5).s - [3, 5**0.5, 2, 0, 0]).max() < 1e-3


def test_snapshots_are_turned_by_ranges(spark, monkeypatch):
    from tallframe.operators import pod

    monkeypatch.setattr(pod, "RANGE", 7)
    x = np.random.default_rng(10).standard_normal((4, 45))
    df = spark.createDataFrame([(10 * i, v.tolist()) for i, v in enumerate(x)], "snap_id long, field array<double>")
    got = {r.row_id: r.features for r in pod.points(df, [0, 10, 20, 30]).collect()}
    assert sorted(got) == list(range(45)) and all(got[j] == x[:, j].tolist() for j in range(45))


def test_lsqr_of_many_and_of_dependent_columns(spark):
    from tallframe.operators import stats
    from tallframe.operators.lsqr import lsqr

    rng = np.random.default_rng(11)
    b = rng.standard_normal(5000)

    def rows(batches):
        """Row i: 5 in column i % 5000, noise everywhere, and y; made where they are needed."""
        import pyarrow as pa

        for batch in batches:
            for i in batch.column(0).to_numpy():
                x = np.random.default_rng(int(i)).standard_normal(5000) * 0.004
                x[i % 5000] += 5
                flat = np.append(x, x @ b + 3)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.ListArray.from_arrays(pa.array([0, 5001], pa.int32()), pa.array(flat))], ["row_id", "features"])

    got, passes = lsqr(spark.range(5200).mapInArrow(rows, "row_id long, features array<double>"), k=5001, tol=1e-12, max_iters=30)
    assert np.abs(got[:-1] - b).max() < 1e-8 and abs(got[-1] - 3) < 1e-8 and passes < 33
    rng = np.random.default_rng(11)
    # columns that differ by 1e-6 and a constant one
    a = rng.standard_normal((400, 3))
    a = np.column_stack([a[:, 0], a[:, 0] + 1e-6 * a[:, 1], a[:, 2], np.full(400, 7.0)])
    y = a[:, 0] - 2 * a[:, 1] + 3 * a[:, 2] + 4
    c = stats.linear_fit(frame(spark, np.column_stack([a, y])), method="lsqr")[:, 0]
    assert np.abs(c - [1, -2, 3, 0, 4]).max() < 1e-8
    with pytest.raises(ValueError):
        stats.linear_fit(frame(spark, a), 2, method="lsqr")


def test_frequent_directions(spark):
    from tallframe.operators import active, pca, sketch

    rng = np.random.default_rng(12)
    a = rng.standard_normal((900, 30)) * np.linspace(3, 0.1, 30) + 5
    m = frame(spark, a, 6)
    for size in (8, 20, 64):
        s = sketch.sketch(m.where("row_id < 500"), size).merge(sketch.RowSketch.from_df(sketch.sketch(m.where("row_id >= 500"), size).to_df(spark)))
        gap = np.linalg.eigvalsh(a.T @ a - s.raw)
        assert s.n == 900 and np.abs(s.means - a.mean(0)).max() < 1e-9 and len(s.b) <= size
        assert gap.min() > -1e-6 and gap.max() <= s.loss + 1e-6 and s.loss <= 2 * (a**2).sum() / size
    exact = pca.from_sketch(s, 5)  # as many rows as columns: nothing is lost
    assert s.loss == 0 and np.abs(exact.explained_var - np.linalg.eigvalsh(np.cov(a.T))[::-1][:5]).max() < 1e-9
    assert np.abs(active.from_sketch(s, 2).eigenvalues - np.linalg.eigvalsh(a.T @ a / 900)[::-1]).max() < 1e-8


def test_patched_interpolation(spark, monkeypatch):
    from tallframe.operators import interp

    monkeypatch.setattr(interp, "PATCH", 120)
    monkeypatch.setattr(interp, "QUERIES", 100)
    rng = np.random.default_rng(13)
    x = rng.random((3000, 2)) * [4, 2]
    y = np.sin(x[:, 0]) + np.cos(2 * x[:, 1])
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "row_id long, features array<double>, y double").repartition(3)
    q = np.vstack([x[:500], rng.random((500, 2)) * [4, 2] * 0.96 + 0.04, [[9.0, 9.0]]])
    for kernel in (interp.cubic(), interp.multiquadric(1.0)):
        f = interp.PatchedRbf(kernel, 2, 1).fit_frame(df)
        got = {r.row_id: r.x for r in f.predict(frame(spark, q)).collect()}
        assert len(got) == 1001
        out = np.array([got[i] for i in range(1000)])
        assert np.abs(out[:500] - y[:500]).max() < 1e-4  # at the supports
        want = np.sin(q[500:1000, 0]) + np.cos(2 * q[500:1000, 1])
        assert np.abs(out[500:] - want).max() < 0.02
    with pytest.raises(ValueError):
        interp.PatchedRbf(interp.cubic(), 3, 1).fit_frame(df)


def test_patches_of_rows_in_order(spark, monkeypatch):
    """More supports than the sample, in order of their place and far from the
    origin: cells are cut from all of them, not from what stands first."""
    from tallframe.operators import interp

    monkeypatch.setattr(interp, "PATCH", 100)
    monkeypatch.setattr(interp, "SAMPLE", 1000)
    monkeypatch.setattr(interp, "MAX_SUPPORT", 1000)
    df = spark.range(5000, numPartitions=4).selectExpr("id as row_id", "array(id / 1024D + 9000D) as features", "double(id * 7919 % 500) as y")
    f = interp.PatchedRbf(interp.linear(), 1, 1).fit_frame(df)
    q = spark.range(4999).selectExpr("id as row_id", "array(id / 1024D + 9000D + 1 / 2048D) as features")
    at, between = ({r.row_id: r.x for r in f.predict(x).collect()} for x in (df, q))
    y = np.arange(5000) * 7919 % 500
    assert np.abs(np.array([at[i] for i in range(5000)]) - y).max() < 1e-7
    assert np.abs(np.array([between[i] for i in range(4999)]) - (y[1:] + y[:-1]) / 2).max() < 1e-7


def test_shots_do_not_run_out_with_many_samples(spark):
    """A fifth of the draws lies in the box: 40 shots of 50 are worth some 400 rows
    a task, ten tasks of 3,000 rows ran out."""
    from tallframe.operators import sampling

    x = sampling.constrained_dirichlet(spark, [(0.0, 0.1), (0.0, 1.0), (0.0, 1.0)], 30_000, 40, 50, seed=1)
    r = x.agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"), F.max(F.col("features")[0]).alias("most"), F.countDistinct("features").alias("apart")).first()
    assert r.n == r.ids == r.apart == 30_000 and r.most <= 0.1


@pytest.mark.parametrize("send", [50_000_000, 60_000])
def test_gradients_where_the_nearest_do_not_determine_them(spark, monkeypatch, send):
    """Points dense on lines and repeated: the nearest 24 lie on one line or in one
    place; sent whole, and in blocks."""
    monkeypatch.setattr(active, "SEND", send)
    monkeypatch.setattr(active, "BLOCK", 1000)
    rng = np.random.default_rng(5)
    x = np.repeat(np.stack([rng.random(600) * 10, rng.integers(0, 6, 600) / 10], axis=1), 8, axis=0)
    y = x[:, 0] ** 2 / 2 + x[:, 1] - x[:, 0] * x[:, 1] / 4 + 2
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "row_id long, features array<double>, y double")
    got = {r.row_id: r.features for r in active.gradients(df, 2, 24, 2).collect()}
    want = np.stack([x[:, 0] - x[:, 1] / 4, 1 - x[:, 0] / 4], axis=1)
    assert len(got) == len(x) and np.abs(np.array([got[i] for i in range(len(x))]) - want).max() < 1e-8


def test_bandwidths_count_equal_values_together(spark, monkeypatch):
    """Each pass of the bandwidths reads distinct values, and finds what all rows say."""
    rows = spark.createDataFrame([(0, float(v)) for v in np.random.default_rng(6).integers(0, 40, 600)], "grp int, v double")
    support, test = rows.select("grp", F.col("v").alias("s")), rows.limit(200).select("grp", (F.col("v") + 0.25).alias("x"))
    seen, plain = [], kde.likelihoods

    def watched(s, x, widths, weighted=False):
        seen.append((s.count(), x.count()))
        got = plain(s, x, widths, weighted)
        if len(seen) == 1:
            want = plain(support.withColumn("w", F.lit(1.0)), test, widths)
            assert np.allclose(got[0], want[0], rtol=1e-12)
        return got

    monkeypatch.setattr(kde, "likelihoods", watched)
    assert dist._bandwidths(support, test, [0], 1.0, 1)[0] > 0
    assert all(a <= 40 and b <= 40 for a, b in seen)
