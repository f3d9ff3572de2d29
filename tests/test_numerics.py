"""Operators against numpy, with small fixtures made here."""

import numpy as np
import pytest

from tallframe import api
from tallframe.functions import distributions as dist
from tallframe.functions import optimize
from tallframe.operators import active, elementwise as ew, gram as gm, interp, linalg, pca, sampling, stats
from tallframe.sources import matrices as src

RNG = np.random.default_rng(0)


def near(a, b, tol=1e-9):
    assert np.abs(np.asarray(a) - np.asarray(b)).max() < tol


def test_matmul_and_diagonals(spark):
    eye = src.coo_from_numpy(spark, np.eye(2))
    m = src.coo_from_numpy(spark, [[3, 0], [2, 0]])
    assert ew.approx_eq(linalg.matmul(eye, m), m, 1e-12)
    v = spark.createDataFrame([(i, float(i + 1)) for i in range(4)], "row_id long, x double")
    d = ew.pinv_diag(ew.vec_to_diag(v.withColumn("x", v.x - 1)))
    assert {(r.i, r.value) for r in d.collect()} == {(0, 0.0), (1, 1.0), (2, 0.5), (3, 1 / 3)}


def test_pinv_literals():
    near(linalg.pinv([[1, 0, 1, 0], [0, 1, 0, 1]]), [[0.5, 0], [0, 0.5], [0.5, 0], [0, 0.5]], 1e-6)
    near(linalg.pinv([[4, 0], [3, -5]]), [[0.25, 0], [0.15, -0.2]], 1e-6)


def test_low_rank_svd(spark):
    a = np.zeros((5, 5))
    a[0, 0], a[0, 4], a[1, 2], a[4, 1] = 1, 2, 3, 2
    for rank in (3, 5):
        _, s, _ = api.rsvd(a, rank, 12, 10)
        near(s[:, 0], [3, 5**0.5, 2, 0, 0][:rank], 1e-3)
    near(linalg.truncated_svd(src.from_numpy(spark, a), 3).s, [3, 5**0.5, 2])
    with pytest.raises(ValueError):
        api.rsvd(a, 6, 2, 2)


def test_distributed_svd_qr_pca(spark):
    a = RNG.standard_normal((300, 14)) @ np.diag(np.linspace(1, 5, 14))
    m = src.from_numpy(spark, a).repartition(5)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    for found in (linalg.truncated_svd(m, 6), linalg.random_svd(m, 6, 25, 8)):
        near(found.s, s[:6], 1e-5)
        near(np.abs(np.diag(found.vt @ vt[:6].T)), np.ones(6), 1e-3)
        u = src.to_numpy(found.u)
        near(u.T @ u, np.eye(6), 1e-6)
    q, r = linalg.thin_qr(m)
    near(src.to_numpy(q) @ r, a, 1e-8)
    model = pca.fit(m, 3)
    c = a - a.mean(0)
    near(model.explained_var, np.linalg.svd(c)[1][:3] ** 2 / 299, 1e-8)
    near(src.to_numpy(pca.fit(m, 14).inverse(pca.fit(m, 14).transform(m))), a, 1e-8)


def test_gram_backends_agree(spark):
    a = RNG.standard_normal((200, 5)) + 1e6
    m = src.from_numpy(spark, a).repartition(4)
    for backend in ("sql", "arrow"):
        g = gm.gram(m, 5, backend)
        near(g.cov, np.cov(a.T), 1e-6)


def test_fits(spark):
    xy = src.from_numpy(spark, [[0, 0, 0], [1, 0, 0.5], [0, 1, 0.5], [1, 1, 1]])
    near(stats.linear_fit(xy)[:, 0], [0.5, 0.5, 0], 1e-8)
    x = RNG.standard_normal((80, 2))
    y = x[:, 0] ** 2 - x[:, 0] * x[:, 1] + 3 * x[:, 1] + 1
    rows = [(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, y double")
    c = stats.quad_fit(df, "y", 2)
    near(c[:, 0], [0, 3, 1, -1, 0, 1], 1e-8)
    g = src.to_numpy(stats.jac_from_quad(df, c, 2))
    near(g, np.stack([2 * x[:, 0] - x[:, 1], 3 - x[:, 0]], 1), 1e-7)


def test_gradients_and_active_subspace(spark):
    x = RNG.multivariate_normal([0, 0], [[0.9, 0.5], [0.5, 0.9]], 100)
    rows = [(i, r.tolist(), float((r**2).sum())) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, y double")
    q = src.from_numpy(spark, [[0, 0], [1, 0], [-1, 0]])
    near(src.to_numpy(active.gradients(df, 2, 14, 2, q)), [[0, 0], [2, 0], [-2, 0]], 1e-6)
    with pytest.raises(ValueError):
        active.gradients(df, 2, 5, 2)


def test_rbf_is_exact_at_supports(spark):
    x = RNG.standard_normal((40, 2))
    y = np.sin(x[:, 0]) + np.sin(x[:, 1])
    for kind in (1, 2, 4):
        f = interp.RbfInterp(interp.kernel_of(kind, 1.0), 2, 1).fit(x, y)
        near(f.predict_array(x)[:, 0], y, 1e-4)


def test_dmdc_and_pod(spark):
    for nx in (20, 50):
        t, x = np.arange(40) * 0.1, np.linspace(0, 10, nx)
        u = np.exp(0.2 * t)[None]
        s = np.sin(x[:, None] + 0.2 * t) * u
        model = api.DMDc(spark, s, u, 14)
        near(model.predict(s[:, 0], u)[:, 19], s[:, 20], 5e-2)
    t = np.linspace(0, 7.6, 20)[:, None]
    xs = np.linspace(0, 8, 50)
    f = 0.5 * t * np.exp(-((xs[None] - t) ** 2) / 0.0625)
    near(api.PodI(spark, f, t, 20).predict(t[5])[:, 0], f[5], 1e-8)


def test_dmdc_operator_on_long_states(spark):
    from tallframe.operators import dmd

    n, steps = 5200, []  # longer than the dense operator may be
    p = np.stack([np.ones(n), np.cos(np.arange(n)), np.arange(n) % 7 / 7], axis=1)
    a, b, z = np.array([[0.9, 0.1, 0.0], [-0.2, 0.8, 0.1], [0.0, 0.05, 0.95]]), np.array([0.5, 0.0, -0.25]), np.array([1.0, 0.0, -1.0])
    for t in range(12):
        u = float(np.sin(3 * t))
        steps.append((t, (p @ z).tolist(), [u]))
        z = a @ z + b * u
    model = dmd.fit(spark.createDataFrame(steps, "t_idx int, state array<double>, control array<double>"), 4)
    with pytest.raises(ValueError):
        model.est_a()
    x = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(p)], "row_id long, features array<double>")
    near(src.to_numpy(model.applied(x)), p @ a, 1e-5)
    big = np.argsort(-np.abs(model.eigs))[:3]
    assert model.mode_residual(big) < 1e-6
    assert model.mode_residual(np.argsort(-np.abs(model.eigs))[:1]) < 1e-6
    near([model.eigs[big].sum().real, np.prod(model.eigs[big]).real], [2.65, 0.6985], 1e-5)


def test_samples_dont_depend_on_partitions(spark):
    m = src.random_normal(spark, 40, 3, 7)
    near(src.to_numpy(m), src.to_numpy(src.random_normal(spark, 40, 3, 7).repartition(7)))
    b = [(0.0, 0.0026), (0.1955, 0.1995), (0.80, 0.825)]
    for n in (8, 13, 21):
        z = api.cs_dirichlet_sample(spark, b, n, 500, 20_000)
        assert z.shape == (n, 3)
        near(z.sum(1), np.ones(n), 1e-12)
    short = sampling.constrained_dirichlet(spark, [(0.99999, 1.0), (0, 1), (0, 1)], 10, 1, 1)
    assert sampling.n_short(short, 10) > 0


def test_accept_ratio_rules():
    inf = np.inf
    near(sampling.accept_ratio_of(np.array([-inf, 0.0, 0.0]), np.array([-inf, -inf, 5.0])), [1, 0, 1])


def test_beta_reg_against_integral():
    x = np.linspace(0, 1, 20001)
    for a, b in ((2.0, 3.0), (0.5, 4.0), (7.0, 1.5)):
        u = np.linspace(0, 1, 200001)[1:-1]
        if min(a, b) >= 1:
            p = u ** (a - 1) * (1 - u) ** (b - 1)
            c = np.cumsum(p) / p.sum()
            near(dist.beta_reg(a, b, u[::1000]), c[::1000], 1e-4)
    near(dist.beta_reg(2.0, 3.0, x), 6 * x**2 - 8 * x**3 + 3 * x**4, 1e-12)


def test_optimisers_and_fallback(spark):
    df = spark.createDataFrame([(float(v),) for v in RNG.normal(5.25, 10, 2000)], "x double")
    ref = dist.NormalRv().mlfit(df, "x")
    for method in (0, 1, 2):
        got = dist.NormalRv().mlfit(df, "x", method)
        near([got.mu, got.std], [ref.mu, ref.std], 1e-3)
    bad = optimize.Problem(lambda ps: np.array([np.inf if p[0] == 1.0 else (p[0] - 2) ** 2 for p in ps]), [1.0], np.array([[0.0], [5.0]]))
    near(optimize.mlefit_fallback(bad, 2), [2.0], 1e-3)
    with pytest.raises(ValueError):
        optimize.mlefit(bad, 9)


def test_zero_density_is_infinite(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    assert dist.BetaRv(2.0, 2.0).nll(df, "x") == float("inf")


def test_streaming_gram(spark, tmp_path):
    from tallframe.streaming.gram import windowed_gram

    df = spark.createDataFrame([("2024-01-01 00:00:00", 1.0, 2.0), ("2024-01-01 05:00:00", 2.0, 4.0), ("2024-01-02 01:00:00", 3.0, 1.0), ("2024-01-02 02:00:00", 5.0, 0.0)], "ts string, a double, b double")
    df = df.withColumn("ts", df.ts.cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_gram(stream, ["a", "b"], "ts").writeStream.outputMode("complete").format("memory").queryName("gram_out").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("gram_out").orderBy("window_start").collect()
    assert [r.n for r in rows] == [2, 2]
    near([r.cov_a_b for r in rows], [1.0, -1.0])


def test_kde_bandwidth_takes_all_test_samples_or_raises(spark, monkeypatch):
    kde = dist.KdeRv(0.5, np.linspace(0, 1, 20))
    test = spark.range(30).selectExpr("id / 30 AS x")
    near(kde.est_bandwidth(test, "x"), kde.est_bandwidth(np.arange(30) / 30))
    monkeypatch.setattr(dist.KdeRv, "MAX", 29)
    assert abs(kde.est_bandwidth(test, "x", 0) - kde.est_bandwidth(np.arange(30) / 30, method=0)) < 1e-3


def test_ranks_across_ranges(spark, monkeypatch):
    from tallframe.operators import elementwise as ew
    from tallframe.plans import ordering

    x = [float(v) for v in np.random.default_rng(0).integers(0, 40, 5000)]
    x[:2000] = [7.0] * 2000  # a value that two fifths of the rows hold
    v = spark.createDataFrame([(i, a) for i, a in enumerate(x)], "row_id long, x double")
    monkeypatch.setattr(ordering, "SMALL", 30)
    for down in (False, True):
        want = sorted(range(len(x)), key=lambda i: (-x[i] if down else x[i], i))
        got = [r.row_id for r in ew.argsort(v, down).orderBy("rank").collect()]
        assert got == want
    for rank in (0, 1, 2500, 4999):
        assert ordering.value_at(v, "x", rank) == sorted(x)[rank]


def test_principal_components_of_wide_rows(spark):
    from tallframe.operators import pca

    rng = np.random.default_rng(1)
    a = rng.standard_normal((60, 3)) @ rng.standard_normal((3, 2500)) + np.arange(2500) / 100
    model = pca.fit(src.from_numpy(spark, a), 3, n_iters=3)
    s = np.linalg.svd(a - a.mean(0), compute_uv=False)
    near(model.singular_values, s[:3])
    near(model.means, a.mean(0))


def test_nearest_neighbours_in_blocks(spark, monkeypatch):
    from tallframe.operators import active

    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 3))
    x[100:200] = x[100]  # ties go by id
    d = sum((x[:, None, j] - x[None, :, j]) ** 2 for j in range(3))
    want = {(i, j, r + 1) for i in range(600) for r, j in enumerate(np.lexsort((np.arange(600), d[i]))[:7])}
    p = src.from_numpy(spark, x)
    for send in (active.SEND, 1):  # the second deals points into blocks
        monkeypatch.setattr(active, "SEND", send)
        monkeypatch.setattr(active, "BLOCK", 40)
        assert {(r.q, r.row_id, r["rank"]) for r in active.knn(p, p, 7).collect()} == want


def test_error_function_and_spline():
    from math import erf

    from tallframe.operators.pod import Interp1d

    x = np.concatenate([np.linspace(-7, 7, 4001), [0.0, -0.0, 1e-9, np.inf, -np.inf]])
    near(dist._ERF(x), np.array([erf(v) for v in x]), 1e-12)
    t = np.array([0.0, 0.7, 1.1, 2.0, 3.5])
    f = lambda v: 1 + v - 2 * v**2 + 0.5 * v**3
    q = np.linspace(0, 3.5, 50)
    near(Interp1d(t, f(t), "cubic").predict_array(q)[:, 0], f(q), 1e-9)  # a cubic is met exactly
