"""Registered queries of the numerical operators and their oracle SQL.

Every query runs over the whole of its tables.  Both sides round alike and add
0.0, which turns -0.0 into 0.0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as dist, kde
from ..operators import active, dmd, elementwise as ew, gram as gm, interp, linalg, pca, pod, sampling, sketch, stats
from ..sources import matrices as src
from ..sources.scratch import stored
from .ordering import global_rank, value_at

_QUERIES: dict = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with its SQL."""

    def add(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _part(spark, sf) -> DataFrame:
    return src.from_columns(_t(spark, sf, "part"), ["p_size", "p_retailprice"], "p_partkey")


def _emb(spark, sf) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"))


def _r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def _coo(m: DataFrame, digits: int = 6) -> DataFrame:
    return src.to_coo(m).select("i", "j", _r("value", digits).alias("value"))


def _small(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


P = "p AS (SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part)"


def _cols(*exprs: str, digits: int = 6, cte: str = P, tail: str = "FROM p") -> str:
    one = [f"SELECT i, {j} AS j, round({e}, {digits}) + 0.0 AS value {tail}" for j, e in enumerate(exprs)]
    return f"WITH {cte} " + " UNION ALL ".join(one)


def _elementwise(name: str, op, *exprs: str, digits: int = 6) -> None:
    query(name, _cols(*exprs, digits=digits))(lambda spark, sf: _coo(op(_part(spark, sf)), digits))


# sources

query("s1_from_columns", _cols("a", "b"))(lambda s, sf: _coo(_part(s, sf)))
query("s2_to_coo_embeddings", """
SELECT vec_id AS i, CAST(k - 1 AS INTEGER) AS j, round(CAST(embedding[k] AS DOUBLE), 6) + 0.0 AS value
FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(k)""")(lambda s, sf: _coo(_emb(s, sf)))
query("s3_random_normal", "SELECT 10 * count(*) AS n, true AS mean_near_0, true AS std_near_1 FROM part")(
    lambda s, sf: src.to_coo(src.random_normal(s, _t(s, sf, "part").count(), 10, 5)).agg(
        F.count("*").alias("n"), (F.abs(F.avg("value")) < 0.1).alias("mean_near_0"), (F.abs(F.stddev("value") - 1) < 0.1).alias("std_near_1")))
query("s4_random_uniform", "SELECT 10 * count(*) AS n, true AS inside, true AS mean_near_mid FROM part")(
    lambda s, sf: src.to_coo(src.random_uniform(s, _t(s, sf, "part").count(), 10, -1.0, 3.0, 5)).agg(
        F.count("*").alias("n"), ((F.min("value") >= -1) & (F.max("value") < 3)).alias("inside"), (F.abs(F.avg("value") - 1) < 0.1).alias("mean_near_mid")))
# supplier keys run without gaps from the least one
query("s5_linspace_as_coded", "SELECT s_suppkey - min(s_suppkey) OVER () AS row_id, round((s_suppkey - min(s_suppkey) OVER ()) * CAST(10 AS DOUBLE) / count(*) OVER (), 6) + 0.0 AS x FROM supplier")(
    lambda s, sf: src.linspace_as_coded(s, 2.0, 12.0, _t(s, sf, "supplier").count()).select("row_id", _r("x").alias("x")))
query("s5_linspace", "SELECT s_suppkey - min(s_suppkey) OVER () AS row_id, round(2.0 + (s_suppkey - min(s_suppkey) OVER ()) * CAST(10 AS DOUBLE) / (count(*) OVER () - 1), 6) + 0.0 AS x FROM supplier")(
    lambda s, sf: src.linspace(s, 2.0, 12.0, _t(s, sf, "supplier").count()).select("row_id", _r("x").alias("x")))


@query("s6_from_vector", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS row_id, CAST(n_regionkey AS DOUBLE) AS x FROM nation")
def _(spark, sf):
    v = _t(spark, sf, "nation").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_regionkey"))), lambda c: c["n_regionkey"].cast("double")).alias("v"))
    return src.from_vector(v, "v").select("row_id", F.col("features")[0].alias("x"))


# element-wise

_elementwise("e1_scalar_fn", lambda m: ew.scalar_fn(m, lambda x: x * x + F.lit(1.0)), "a*a+1", "b*b+1", digits=3)
_elementwise("e2_col_vec_add", lambda m: ew.col_vec_add(m, [0.5, -2.0]), "a+0.5", "b-2.0")
_elementwise("e3_row_vec_add", lambda m: ew.row_vec_add(m, m.select("row_id", F.col("row_id").cast("double").alias("x"))), "a+i", "b+i")
_elementwise("e4_vec_add_axis0", lambda m: ew.vec_add(m, [1.0, 2.0], 0), "a+1", "b+2")
_elementwise("e4_vec_add_axis1", lambda m: ew.vec_add(m, m.select("row_id", (F.col("row_id") * 2.0).alias("x")), 1), "a+2*i", "b+2*i")
_elementwise("e5_ele_pow", lambda m: ew.ele_pow(m, 1.5), "pow(a,1.5)", "pow(b,1.5)", digits=4)
_elementwise("e6_hadamard", lambda m: ew.hadamard(m, ew.scalar_add(m, 1.0)), "a*(a+1)", "b*(b+1)", digits=3)
_elementwise("e7_scalar_add", lambda m: ew.scalar_add(m, 3.25), "a+3.25", "b+3.25")
_elementwise("e8_row_mod", lambda m: ew.set_row(m, 7, [-1.0, -2.0]), "CASE WHEN i=7 THEN -1 ELSE a END", "CASE WHEN i=7 THEN -2 ELSE b END")
_elementwise("e9_col_mod", lambda m: ew.col_mod(m, 1, ew.col_to_vec(m, 0)), "a", "a")
_elementwise("e10_set_col", lambda m: ew.set_col(m, 0, ew.col_to_vec(m, 1)), "b", "b")
_elementwise("e21_center", stats.center, "a-(SELECT avg(a) FROM p)", "b-(SELECT avg(b) FROM p)", digits=5)
_elementwise("e22_zcenter", stats.zcenter, "(a-(SELECT avg(a) FROM p))/(SELECT stddev_samp(a) FROM p)", "(b-(SELECT avg(b) FROM p))/(SELECT stddev_samp(b) FROM p)")
_elementwise("e23_hstack", lambda m: ew.hstack(m, ew.scale(m, 2.0)), "a", "b", "2*a", "2*b")
_elementwise("e24_interactions", lambda m: ew.col_interactions(m, 2), "a*a", "a*b", "b*b", digits=3)
_elementwise("e24_interactions_no_self", lambda m: ew.col_interactions(m, 2, False), "a*b", digits=3)
_elementwise("e25_col_powers", lambda m: ew.col_powers(ew.scale(m, 0.01), 3), "a*0.01", "b*0.01", "pow(a*0.01,2)", "pow(b*0.01,2)", "pow(a*0.01,3)", "pow(b*0.01,3)")
_elementwise("e26_vandermonde", lambda m: ew.vandermonde(m, 2), "a", "b", "a*a", "a*b", "b*b", "CAST(1 AS DOUBLE)", digits=3)
_elementwise("e27_full_vandermonde_linear", lambda m: ew.full_vandermonde(m, 2, 1), "a", "b", "CAST(1 AS DOUBLE)")
_elementwise("e27_full_vandermonde_quadratic", lambda m: ew.full_vandermonde(m, 2, 3), "a", "b", "a*a", "a*b", "b*b", "CAST(1 AS DOUBLE)", digits=3)
_elementwise("e30_scale", lambda m: ew.scale(m, -0.5), "a*-0.5", "b*-0.5")

query("e11_complex_from_parts", f"WITH {P} SELECT i, 0 AS j, a AS re, a*2 AS im FROM p UNION ALL SELECT i, 1, b, b*2 FROM p")(
    lambda s, sf: ew.complex_from_parts(m := _part(s, sf), ew.scale(m, 2.0)).select(F.col("row_id").alias("i"), F.posexplode("features").alias("j", "c")).select("i", "j", "c.re", "c.im"))
query("e12_parts_from_complex", _cols("a*2", "b*2"))(
    lambda s, sf: _coo(ew.parts_from_complex(ew.complex_from_parts(m := _part(s, sf), ew.scale(m, 2.0)))[1]))


def _vec(s, sf):
    return _t(s, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_acctbal").alias("x"))


_DIAG = "SELECT s_suppkey AS i, s_suppkey AS j, s_acctbal AS value FROM supplier"
query("e13_colvec_to_diag", _DIAG)(lambda s, sf: ew.vec_to_diag(_vec(s, sf)))
query("e14_colmat_to_diag", _DIAG)(lambda s, sf: ew.vec_to_diag(ew.col_to_vec(src.from_columns(_t(s, sf, "supplier"), ["s_acctbal"], "s_suppkey"), 0)))
query("e15_rowvec_to_diag", "SELECT CAST(n_nationkey AS INTEGER) AS i, CAST(n_nationkey AS INTEGER) AS j, CAST(n_regionkey AS DOUBLE) AS value FROM nation")(
    lambda s, sf: ew.rowvec_to_diag(_t(s, sf, "nation").agg(F.lit(0).cast("long").alias("row_id"), F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_regionkey"))), lambda c: c["n_regionkey"].cast("double")).alias("features"))))
query("e16_diag_to_dense", """
SELECT CAST(a.n_nationkey AS BIGINT) AS i, CAST(b.n_nationkey AS INTEGER) AS j, CASE WHEN a.n_nationkey = b.n_nationkey THEN CAST(a.n_regionkey AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value
FROM nation a, nation b""")(lambda s, sf: src.to_coo(ew.diag_to_dense(ew.vec_to_diag(_t(s, sf, "nation").select(F.col("n_nationkey").alias("row_id"), F.col("n_regionkey").cast("double").alias("x"))), 25)))
query("e17_pinv_diag", "SELECT n_nationkey AS i, n_nationkey AS j, CASE WHEN n_regionkey = 0 THEN 0.0 ELSE round(CAST(1 AS DOUBLE) / n_regionkey, 9) END AS value FROM nation")(
    lambda s, sf: ew.pinv_diag(ew.vec_to_diag(_t(s, sf, "nation").select(F.col("n_nationkey").alias("row_id"), F.col("n_regionkey").cast("double").alias("x")))).select("i", "j", F.round("value", 9).alias("value")))
query("e18_row_to_vec", f"WITH {P} SELECT 0 AS idx, a AS x FROM p WHERE i=11 UNION ALL SELECT 1, b FROM p WHERE i=11")(lambda s, sf: ew.row_to_vec(_part(s, sf), 11))
query("e19_col_to_vec", f"WITH {P} SELECT i AS row_id, b AS x FROM p")(lambda s, sf: ew.col_to_vec(_part(s, sf), 1))
query("e20_diag_to_vec", "SELECT vec_id AS row_id, round(CAST(embedding[vec_id + 1] AS DOUBLE), 6) + 0.0 AS x FROM embeddings WHERE vec_id < len(embedding)")(
    lambda s, sf: ew.diag_to_vec(_emb(s, sf)).select("row_id", _r("x").alias("x")))
query("e28_transpose", f"WITH {P} SELECT 0 AS i, i AS j, a AS value FROM p UNION ALL SELECT 1, i, b FROM p")(lambda s, sf: ew.transpose(src.to_coo(_part(s, sf))))
query("e29_submatrix", """
SELECT vec_id AS i, CAST(k - 5 AS INTEGER) AS j, round(CAST(embedding[k] AS DOUBLE), 6) + 0.0 AS value
FROM embeddings, unnest(range(5, 9)) AS u(k) WHERE vec_id >= 100 AND vec_id < 300""")(lambda s, sf: _coo(ew.submatrix(_emb(s, sf), 100, 4, 200, 4)))

# predicates

query("p1_box_filter", f"WITH {P} SELECT i AS row_id FROM p WHERE a BETWEEN 10 AND 40 AND b BETWEEN 950 AND 1500")(
    lambda s, sf: ew.box_filter(_part(s, sf), [(10, 40), (950, 1500)]).select("row_id"))
query("p2_ln_prior_uniform", f"WITH {P} SELECT i AS row_id, CASE WHEN a > 10 AND a < 40 AND b > 950 AND b < 1500 THEN CAST(0 AS DOUBLE) ELSE CAST('-infinity' AS DOUBLE) END AS lnp FROM p")(
    lambda s, sf: _part(s, sf).select("row_id", ew.ln_prior_uniform(F.col("features"), [(10, 40), (950, 1500)]).alias("lnp")))
query("p3_approx_eq", f"WITH {P} SELECT 2 * count(*) AS n, CAST(0.25 AS DOUBLE) AS max_diff FROM p")(
    lambda s, sf: ew.max_abs_diff(src.to_coo(m := _part(s, sf)), src.to_coo(ew.scalar_add(m, 0.25))).select("n", F.round("max_diff", 6).alias("max_diff")))
query("p4_scalar_approx_eq", "SELECT true AS near, false AS far")(
    lambda s, sf: _small(s, [(ew.scalar_approx_eq(z := ew.scalar_fn(_part(s, sf), lambda x: x * 0.0 + 2.0), 2.0, 1e-12), ew.scalar_approx_eq(z, 2.5, 1e-3))], "near boolean, far boolean"))

# join-like

_NEAR = """n AS (SELECT q.i AS q, s.i AS row_id, (q.a-s.a)*(q.a-s.a)+(q.b-s.b)*(q.b-s.b) AS d2,
 row_number() OVER (PARTITION BY q.i ORDER BY (q.a-s.a)*(q.a-s.a)+(q.b-s.b)*(q.b-s.b), s.i) AS rank FROM p q, p s)"""
query("j1_knn", f"WITH {P}, {_NEAR} SELECT q, row_id, CAST(rank AS INTEGER) AS rank, round(d2, 6) + 0.0 AS d2 FROM n WHERE rank <= 10")(
    lambda s, sf: active.knn(m := _part(s, sf), m, 10, 2).select("q", "row_id", "rank", _r("d2").alias("d2")))
for _name, _kernel, _sql in (
    ("linear", interp.linear(), "r"), ("cubic", interp.cubic(), "r*r*r"),
    ("multiquadric", interp.multiquadric(0.5), "sqrt(1+pow(0.5*r,2))"), ("gaussian", interp.gaussian(0.5), "exp(-pow(0.5*r,2))"),
):
    query(f"j3_kernel_{_name}", f"""
SELECT row_id, CAST(s AS INTEGER) AS s, round({_sql}, 6) + 0.0 AS value FROM
(SELECT s_suppkey AS row_id, n_nationkey AS s, abs(s_acctbal / 1000 - n_nationkey) AS r FROM supplier, nation)""")(
        lambda s, sf, k=_kernel: interp.kernel_frame(
            _t(s, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), F.array(F.col("s_acctbal") / 1000).alias("features")),
            np.array([[r[0]] for r in _t(s, sf, "nation").orderBy("n_nationkey").select("n_nationkey").collect()], float), k,
        ).select("row_id", "s", _r("value").alias("value")))

_EV = "ev AS (SELECT CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, event_type AS e, avg(value) AS v FROM events GROUP BY 1, 2)"


def _days(spark, sf) -> DataFrame:
    """(t_idx, state): mean value of each event type by day, types in order."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    cells = _t(spark, sf, "events").groupBy(day.alias("t_idx"), "event_type").agg(F.avg("value").alias("v"))
    return cells.groupBy("t_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_type", "v"))), lambda c: c["v"]).alias("state"))


_W = """s AS (SELECT t, e, v, row_number() OVER (PARTITION BY t ORDER BY e) - 1 AS j FROM ev)"""
_SHIFT = f"WITH {_EV}, {_W} SELECT x.t AS t_idx, CAST(x.j AS INTEGER) AS j, round(x.v, 6) + 0.0 AS x, round(y.v, 6) + 0.0 AS y FROM s x JOIN s y ON y.t = x.t + 1 AND y.j = x.j"
query("j5_snapshot_shift", _SHIFT)(
    lambda s, sf: dmd.shift_pairs(_days(s, sf)).select("t_idx", F.posexplode(F.arrays_zip("x", "y")).alias("j", "c")).select("t_idx", "j", _r("c.x").alias("x"), _r("c.y").alias("y")))
query("w1_time_shift", _SHIFT)(
    lambda s, sf: dmd.shift_pairs_window(_days(s, sf).withColumn("series", F.lit(0)), "series").select("t_idx", F.posexplode(F.arrays_zip("x", "y")).alias("j", "c")).select("t_idx", "j", _r("c.x").alias("x"), _r("c.y").alias("y")))

_EC = "c AS (SELECT vec_id AS i, k - 1 AS j, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(k))"
query("j6_matmul", f"WITH {_EC} SELECT CAST(x.j AS INTEGER) AS i, CAST(y.j AS INTEGER) AS j, round(sum(x.v * y.v), 6) + 0.0 AS value FROM c x JOIN c y ON x.i = y.i GROUP BY 1, 2")(
    lambda s, sf: _matrix(s, linalg.tall_product(m := _emb(s, sf), m)))
query("a3_matmul_scaled", f"WITH {_EC} SELECT CAST(x.j AS INTEGER) AS i, CAST(y.j AS INTEGER) AS j, round(0.5 * sum(x.v * y.v), 6) + 0.0 AS value FROM c x JOIN c y ON x.i = y.i WHERE y.j < 8 GROUP BY 1, 2")(
    lambda s, sf: _matrix(s, linalg.tall_product(m := _emb(s, sf), ew.submatrix(m, 0, 0, 1 << 40, 8), 0.5)))
query("j6_matmul_coo", "SELECT i, j, value FROM (SELECT s_nationkey AS i, n_regionkey AS j, round(sum(s_acctbal), 4) + 0.0 AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)")(
    lambda s, sf: linalg.matmul(
        _t(s, sf, "supplier").select(F.col("s_nationkey").alias("i"), F.col("s_suppkey").alias("j"), F.col("s_acctbal").alias("value")),
        _t(s, sf, "supplier").join(_t(s, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("i"), F.col("n_regionkey").alias("j"), F.lit(1.0).alias("value")),
    ).select("i", "j", _r("value", 4).alias("value")))
query("j6_times_small", _cols("2*a+b", "a-b"))(lambda s, sf: _coo(linalg.times(_part(s, sf), np.array([[2.0, 1.0], [1.0, -1.0]]))))

# aggregations

query("a1_row_mean", "SELECT vec_id AS row_id, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS x FROM embeddings")(
    lambda s, sf: stats.mat_mean(_emb(s, sf), 0).select("row_id", _r("x").alias("x")))
query("a1_col_mean", f"WITH {P} SELECT 0 AS j, round(avg(a), 6) + 0.0 AS x FROM p UNION ALL SELECT 1, round(avg(b), 6) + 0.0 FROM p")(
    lambda s, sf: stats.mat_mean(_part(s, sf), 1).select("j", _r("x").alias("x")))
query("a2_row_std", "SELECT vec_id AS row_id, round(list_stddev_samp(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS x FROM embeddings")(
    lambda s, sf: stats.mat_std(_emb(s, sf), 0).select("row_id", _r("x").alias("x")))
query("a2_col_std", f"WITH {P} SELECT 0 AS j, round(stddev_samp(a), 6) + 0.0 AS x FROM p UNION ALL SELECT 1, round(stddev_samp(b), 6) + 0.0 FROM p")(
    lambda s, sf: stats.mat_std(_part(s, sf), 1).select("j", _r("x").alias("x")))

_L = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _items(spark, sf, cols=tuple(_L)) -> DataFrame:
    """Row matrix without a unique id: only reductions are taken of it."""
    return _t(spark, sf, "lineitem").select(F.lit(0).cast("long").alias("row_id"), F.array(*(F.col(c) for c in cols)).alias("features"))


def _matrix(spark, a: np.ndarray, digits: int = 6) -> DataFrame:
    return src.coo_from_numpy(spark, np.round(a, digits) + 0.0)


def _pairs(fn: str, digits: int) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round({fn}({a}, {b}), {digits}) + 0.0 AS value FROM lineitem" for i, a in enumerate(_L) for j, b in enumerate(_L))


query("a4_pearson_corr", _pairs("corr", 6))(lambda s, sf: _matrix(s, stats.pearson_corr(_items(s, sf))))
query("a5_cov", _pairs("covar_samp", 3))(lambda s, sf: _matrix(s, stats.cov_centered(_items(s, sf)), 3))
query("a5_cov_arrow_backend", _pairs("covar_samp", 3))(lambda s, sf: _matrix(s, gm.gram(_items(s, sf), 4, "arrow").cov, 3))
query("a6_frobenius", "SELECT round(sqrt(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS norm FROM embeddings")(
    lambda s, sf: _small(s, [(round(stats.frobenius(_emb(s, sf)), 6),)], "norm double"))

# sort, top-k, windows, sets

_O = lambda s, sf: _t(s, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("x"))
query("o1_argsort", "SELECT CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS rank, o_orderkey AS row_id, o_totalprice AS x FROM orders")(lambda s, sf: ew.argsort(_O(s, sf)))
query("o2_argsort_rev", "SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS BIGINT) AS rank, o_orderkey AS row_id, o_totalprice AS x FROM orders")(lambda s, sf: ew.argsort(_O(s, sf), True))
query("o4_top_k", "SELECT o_orderkey AS row_id, o_totalprice AS x FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(
    lambda s, sf: _O(s, sf).orderBy(F.col("x").desc(), "row_id").limit(25))


def _as_chains(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events")
    return e.select(F.lit(0).cast("long").alias("ensemble_id"), (F.col("user_id") % 8).cast("int").alias("chain_id"), F.col("event_id").cast("int").alias("step"), F.array("value").alias("sample"), (F.col("value") > 20).alias("accepted"))


_CH = "c AS (SELECT CAST(user_id % 8 AS INTEGER) AS chain_id, CAST(event_id AS INTEGER) AS step, value AS x, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id DESC) AS r FROM events)"
for _n, _what in ((5, "o5_chain_tail"), (0, "o5_chain_all")):
    query(_what, f"WITH {_CH} SELECT chain_id, step, x FROM c" + f" WHERE r <= {_n}" * bool(_n))(
        lambda s, sf, n=_n: sampling.chain_tail(_as_chains(s, sf), n).select("chain_id", "step", F.col("sample")[0].alias("x")))
query("o6_get_samples", f"WITH {_CH} SELECT CAST(row_number() OVER (ORDER BY step, chain_id) - 1 AS BIGINT) AS position, chain_id, step, x FROM c WHERE r <= 40")(
    lambda s, sf: sampling.get_samples(_as_chains(s, sf), 40).select("position", "chain_id", "step", F.col("sample")[0].alias("x")))
query("o7_head_sample", f"WITH {_CH} SELECT chain_id, x FROM c WHERE r = 1")(lambda s, sf: sampling.chain_heads(_as_chains(s, sf)).select("chain_id", F.col("sample")[0].alias("x")))
query("a8_accept_ratio", "SELECT round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 9) AS accept_ratio FROM events")(
    lambda s, sf: sampling.accept_ratio(_as_chains(s, sf)).select(F.round("accept_ratio", 9).alias("accept_ratio")))
query("a9_upper_median", "SELECT value AS x FROM (SELECT value, row_number() OVER (ORDER BY value, event_id) - 1 AS r, count(*) OVER () AS n FROM events) WHERE r = n // 2")(
    lambda s, sf: _small(s, [(value_at(e := _t(s, sf, "events"), "value", e.count() // 2),)], "x double"))
query("u1_vstack", f"WITH {P}, m AS (SELECT max(i) + 1 AS d FROM p) SELECT i, 0 AS j, a AS value FROM p UNION ALL SELECT i, 1, b FROM p UNION ALL SELECT i + d, 0, 2 * a FROM p, m UNION ALL SELECT i + d, 1, 2 * b FROM p, m")(
    lambda s, sf: src.to_coo(ew.vstack(m := _part(s, sf), ew.scale(m, 2.0))))

# decompositions: invariants

_INV = """WITH c AS (SELECT var_samp(l_quantity) AS v, var_samp(l_discount) AS w, covar_samp(l_quantity, l_discount) AS c FROM lineitem), d AS (SELECT *, v*w-c*c AS det FROM c)"""
_INVS = ((0, 0, "w/det"), (0, 1, "-c/det"), (1, 0, "-c/det"), (1, 1, "v/det"))
_QD = ("l_quantity", "l_discount")
query("d1_pinv", _INV + " UNION ALL ".join(f" SELECT {i} AS i, {j} AS j, round({e}, 6) + 0.0 AS value FROM d" for i, j, e in _INVS))(
    lambda s, sf: _matrix(s, linalg.pinv(stats.cov_centered(_items(s, sf, _QD)))))
# 1 / (1 + i / 2) = 0.8 - 0.4 i
query("d2_pinv_complex", _INV + " UNION ALL ".join(f" SELECT {i} AS i, {j} AS j, round(0.8*({e}), 6) + 0.0 AS re, round(-0.4*({e}), 6) + 0.0 AS im FROM d" for i, j, e in _INVS))(
    lambda s, sf: _small(s, [(i, j, round(float(v.real), 6) + 0.0, round(float(v.imag), 6) + 0.0) for (i, j), v in np.ndenumerate(
        linalg.pinv_complex(stats.cov_centered(_items(s, sf, _QD)) * (1 + 0.5j)))], "i int, j int, re double, im double"))
_EMB_COO = """
SELECT vec_id AS i, CAST(k - 1 AS INTEGER) AS j, round(CAST(embedding[k] AS DOUBLE), 6) + 0.0 AS value
FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(k)"""
# all factors multiplied again give the table back
query("d3_truncated_svd_full", _EMB_COO)(lambda s, sf: _coo(linalg.times((f := linalg.truncated_svd(_emb(s, sf), 64, 64)).u, f.s[:, None] * f.vt)))
query("d5_random_svd_full", _EMB_COO)(lambda s, sf: _coo(linalg.times((f := linalg.random_svd(_emb(s, sf), 64, 2, 10, k=64)).u, f.s[:, None] * f.vt)))


# p_size x 20 and the price: the Gram matrix of two columns has eigenpairs in closed form
_RAW = """WITH g AS (SELECT sum(400.0 * p_size * p_size) AS v, sum(p_retailprice * p_retailprice) AS w, sum(20.0 * p_size * p_retailprice) AS c FROM part),
e AS (SELECT (v+w)/2 + sqrt((v-w)*(v-w)/4+c*c) AS l1, (v+w)/2 - sqrt((v-w)*(v-w)/4+c*c) AS l2, v, w, c FROM g),
u AS (SELECT *, c/sqrt(c*c+(l1-v)*(l1-v)) AS x, (l1-v)/sqrt(c*c+(l1-v)*(l1-v)) AS y FROM e)"""


def _two(spark, sf) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.array(F.col("p_size") * 20.0, F.col("p_retailprice")).alias("features"))


def _rank1(spark, m, found) -> DataFrame:
    """The leading value and vector, and what is left of the matrix without them."""
    left = found.u.join(m.select("row_id", F.col("features").alias("a")), "row_id")
    u = F.col("features")[0] * float(found.s[0])
    gap = sum(((F.col("a")[j] - u * float(found.vt[0, j])) ** 2 for j in range(2)), F.lit(0.0))
    return left.agg(F.sum(gap).alias("r")).select(
        F.lit(len(found.s)).cast("long").alias("n"), F.lit(round(float(found.s[0]), 3)).alias("s"), F.lit(round(float(found.vt[0, 0]), 6)).alias("x"),
        F.lit(round(float(found.vt[0, 1]), 6)).alias("y"), F.round(F.sqrt("r"), 2).alias("rest"))


_R1 = _RAW + " SELECT CAST(1 AS BIGINT) AS n, round(sqrt(l1), 3) AS s, round(x, 6) AS x, round(y, 6) AS y, round(sqrt(l2), 2) AS rest FROM u"
query("d3_truncated_svd", _R1)(lambda s, sf: _rank1(s, m := _two(s, sf), linalg.truncated_svd(m, 1, 2)))
query("d5_random_svd", _R1)(lambda s, sf: _rank1(s, m := _two(s, sf), linalg.random_svd(m, 1, 8, 0, k=2)))
query("py_rsvd", _R1)(lambda s, sf: _rank1(s, m := _two(s, sf), linalg.rsvd_plain(m, 1, 4, 4, k=2)))
query("d4_power_iter", _RAW + " SELECT 0 AS i, 0 AS j, round(x, 6) AS value FROM u UNION ALL SELECT 1, 0, round(y, 6) FROM u")(
    lambda s, sf: _matrix(s, np.abs(linalg.power_iter(_two(s, sf), 1, 20, 2))))
query("py_power_iteration", _RAW + """ SELECT p_partkey AS i, 0 AS j, round((20.0*p_size*x + p_retailprice*y)/sqrt(l1), 7) AS value FROM part, u""")(
    lambda s, sf: _coo(ew.scalar_fn(linalg.power_iter_plain(_two(s, sf), 1, 20, 2)[0], F.abs), 7))


def _rebuilt(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (v * w) @ v.T


query("d6_eigh", _pairs("covar_samp", 3))(lambda s, sf: _matrix(s, _rebuilt(*linalg.eigh_desc(stats.cov_centered(_items(s, sf)))), 3))
# [[2 v, v], [0, w]]: the eigenvalues stand on the diagonal
query("d7_eig_general", """SELECT CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS j, value FROM
(SELECT round(var_samp(l_quantity) * 2, 4) AS value FROM lineitem UNION ALL SELECT round(var_samp(l_discount), 4) FROM lineitem)""")(
    lambda s, sf: _small(s, [(j, round(float(v), 4)) for j, v in enumerate(sorted(linalg.eig_general(
        np.array([[2, 1], [0, 1]]) * np.diag(stats.cov_centered(_items(s, sf, ("l_quantity", "l_discount"))))[:, None])[0].real))], "j int, value double"))


query("d8_thin_qr", _RAW + " SELECT 0 AS i, 0 AS j, round(sqrt(v), 3) AS value FROM g UNION ALL SELECT 0, 1, round(c/sqrt(v), 3) FROM g UNION ALL SELECT 1, 0, 0.0 FROM g UNION ALL SELECT 1, 1, round(sqrt(w-c*c/v), 3) FROM g")(
    lambda s, sf: _matrix(s, linalg.thin_qr(_two(s, sf), 2)[1], 3))
query("d8_thin_q", _RAW + """ SELECT p_partkey AS i, 0 AS j, round(20.0*p_size/sqrt(v), 7) + 0.0 AS value FROM part, g
UNION ALL SELECT p_partkey, 1, round((p_retailprice - 20.0*p_size*c/v)/sqrt(w-c*c/v), 7) + 0.0 FROM part, g""")(
    lambda s, sf: _coo(linalg.thin_qr(_two(s, sf), 2)[0], 7))


# regression

query("r1_linear_fit_k1", "SELECT 0 AS i, round(regr_slope(l_extendedprice, l_quantity), 4) AS value FROM lineitem UNION ALL SELECT 1, round(regr_intercept(l_extendedprice, l_quantity), 4) FROM lineitem")(
    lambda s, sf: _small(s, [(i, round(float(v), 4)) for i, v in enumerate(stats.linear_fit(_items(s, sf, ("l_quantity", "l_extendedprice")))[:, 0])], "i int, value double"))
_CR = """c AS (SELECT var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2, covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_quantity, l_extendedprice) AS y1,
 covar_pop(l_discount, l_extendedprice) AS y2, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem),
b AS (SELECT (y1*v2-y2*c12)/(v1*v2-c12*c12) AS b1, (y2*v1-y1*c12)/(v1*v2-c12*c12) AS b2, m1, m2, my FROM c)"""
_Y2 = ("l_quantity", "l_discount", "l_extendedprice")
query("r1_linear_fit_k2", f"WITH {_CR} SELECT 0 AS i, round(b1, 4) AS value FROM b UNION ALL SELECT 1, round(b2, 4) FROM b UNION ALL SELECT 2, round(my-b1*m1-b2*m2, 4) FROM b")(
    lambda s, sf: _small(s, [(i, round(float(v), 4)) for i, v in enumerate(stats.linear_fit(_items(s, sf, _Y2))[:, 0])], "i int, value double"))
query("r1_linear_fit_lsqr", f"WITH {_CR} SELECT 0 AS i, round(b1, 4) AS value FROM b UNION ALL SELECT 1, round(b2, 4) FROM b UNION ALL SELECT 2, round(my-b1*m1-b2*m2, 4) FROM b")(
    lambda s, sf: _small(s, [(i, round(float(v), 4)) for i, v in enumerate(stats.linear_fit(_items(s, sf, _Y2), method="lsqr")[:, 0])], "i int, value double"))


# discount x 1e-4 beside the quantity: two columns that hardly differ; slopes b1 - 1e4 b2 and 1e4 b2
@query("r1_linear_fit_dependent", f"WITH {_CR} SELECT 0 AS i, round((b1 - 1e4 * b2) / 1e4, 2) AS value FROM b UNION ALL SELECT 1, round(b2, 2) FROM b UNION ALL SELECT 2, round(my-b1*m1-b2*m2, 2) FROM b")
def _(spark, sf):
    q, d = F.col("l_quantity"), F.col("l_discount")
    m = _t(spark, sf, "lineitem").select(F.lit(0).cast("long").alias("row_id"), F.array(q, q + d * 1e-4, F.col("l_extendedprice")).alias("features"))
    b = stats.linear_fit(m, method="lsqr")[:, 0]
    return _small(spark, [(0, round(float(b[0]) / 1e4, 2)), (1, round(float(b[1]) / 1e4, 2)), (2, round(float(b[2]), 2))], "i int, value double")


query("r2_jac_from_lin", f"WITH {_CR} SELECT 0 AS i, 0 AS j, round(b1, 4) AS value FROM b UNION ALL SELECT 0, 1, round(b2, 4) FROM b")(lambda s, sf: _matrix(s, stats.jac_from_lin(_items(s, sf, _Y2)), 4))


def _quad(spark, sf) -> DataFrame:
    """part scaled to a = size / 10, b = price / 1000, and y = a^2 / 2 + b - a b / 4 + 2."""
    m = _t(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0).alias("features"))
    a, b = F.col("features")[0], F.col("features")[1]
    return m.withColumn("y", a * a * 0.5 + b - a * b * 0.25 + 2.0)


query("r3_quad_fit", "SELECT * FROM (VALUES (0, 0.0), (1, 1.0), (2, 0.5), (3, -0.25), (4, 0.0), (5, 2.0)) AS t(i, v)".replace("SELECT *", "SELECT i, CAST(v AS DOUBLE) AS value"))(
    lambda s, sf: _small(s, [(i, round(float(v), 4) + 0.0) for i, v in enumerate(stats.quad_fit(_quad(s, sf), "y", 2)[:, 0])], "i int, value double"))
_QC = np.array([0.0, 1.0, 0.5, -0.25, 0.0, 2.0])
_QP = "p AS (SELECT p_partkey AS i, p_size / CAST(10 AS DOUBLE) AS a, p_retailprice / 1000 AS b FROM part)"
query("r3_quad_fit_lsqr", "SELECT * FROM (VALUES (0, 0.0), (1, 1.0), (2, 0.5), (3, -0.25), (4, 0.0), (5, 2.0)) AS t(i, v)".replace("SELECT *", "SELECT i, CAST(v AS DOUBLE) AS value"))(
    lambda s, sf: _small(s, [(i, round(float(v), 4) + 0.0) for i, v in enumerate(stats.quad_fit(_quad(s, sf), "y", 2, "lsqr")[:, 0])], "i int, value double"))
query("r4_quad_eval", f"WITH {_QP} SELECT i AS row_id, round(a*a*0.5+b-a*b*0.25+2, 8) + 0.0 AS x FROM p")(lambda s, sf: stats.quad_eval(_quad(s, sf), _QC, 2).select("row_id", _r("x", 8).alias("x")))
query("r5_jac_from_quad", _cols("a-0.25*b", "1-0.25*a", cte=_QP))(lambda s, sf: _coo(stats.jac_from_quad(_quad(s, sf), _QC, 2)))
query("r6_r_squared", "SELECT round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(1 - (1 - regr_r2(l_extendedprice, l_quantity)) * (count(*) - 1) / (count(*) - 2), 6) AS r2_dof FROM lineitem")(
    lambda s, sf: _small(s, [(round(stats.rsquared(None, False, g := gm.gram(_items(s, sf, ("l_quantity", "l_extendedprice")))), 6), round(stats.rsquared(None, True, g), 6))], "r2 double, r2_dof double"))
query("r6_r_squared_k2", """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b, corr(l_quantity, l_discount) AS r, count(*) AS n FROM lineitem),
q AS (SELECT (a*a + b*b - 2*a*b*r) / (1 - r*r) AS r2, n FROM c) SELECT round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS r2_dof FROM q""")(
    lambda s, sf: _small(s, [(round(stats.rsquared(None, False, g := gm.gram(_items(s, sf, _Y2))), 6), round(stats.rsquared(None, True, g), 6))], "r2 double, r2_dof double"))
query("r7_sandwich", "SELECT 0 AS i, 0 AS j, round(4*var_samp(l_quantity)+4*covar_samp(l_quantity,l_discount)+var_samp(l_discount), 4) AS value FROM lineitem")(
    lambda s, sf: _matrix(s, stats.sandwich(stats.cov_centered(_items(s, sf, ("l_quantity", "l_discount"))), np.array([[2.0, 1.0]])), 4))


def _smooth(spark, sf) -> DataFrame:
    m = _part(spark, sf)
    a, b = F.col("features")[0], F.col("features")[1]
    return m.withColumn("y", a * a * 0.01 + b * 0.1 + a * b * 0.001)


_G = f"""{P}, {_NEAR}, y AS (SELECT i, a, b, a*a*0.01+b*0.1+a*b*0.001 AS y FROM p),
g AS (SELECT q, (covar_pop(a,y)*var_pop(b)-covar_pop(b,y)*covar_pop(a,b))/(var_pop(a)*var_pop(b)-covar_pop(a,b)*covar_pop(a,b)) AS g1,
 (covar_pop(b,y)*var_pop(a)-covar_pop(a,y)*covar_pop(a,b))/(var_pop(a)*var_pop(b)-covar_pop(a,b)*covar_pop(a,b)) AS g2
 FROM n JOIN y ON y.i = n.row_id WHERE rank <= 14 GROUP BY q)"""
query("r8_grad_linear", f"WITH {_G} SELECT q AS i, 0 AS j, round(g1, 4) + 0.0 AS value FROM g UNION ALL SELECT q, 1, round(g2, 4) + 0.0 FROM g")(lambda s, sf: _coo(active.gradients(_smooth(s, sf), 1, 14, 2), 4))
query("as4_sensitivity", f"WITH {_G} SELECT 0 AS j, round(avg(g1*g1), 4) AS value FROM g UNION ALL SELECT 1, round(avg(g2*g2), 4) FROM g")(
    lambda s, sf: _small(s, [(j, round(float(v), 4)) for j, v in enumerate(active.fit(active.gradients(_smooth(s, sf), 1, 14, 2), 1).sensitivity)], "j int, value double"))
_AC = f"""WITH {_G}, c AS (SELECT avg(g1*g1) AS v, avg(g2*g2) AS w, avg(g1*g2) AS c FROM g),
e AS (SELECT (v+w)/2 + sqrt((v-w)*(v-w)/4+c*c) AS l1, (v+w)/2 - sqrt((v-w)*(v-w)/4+c*c) AS l2, v, w, c FROM c),
u AS (SELECT l1, l2, c*c/(c*c+(l1-v)*(l1-v)) AS x2, (l1-v)*(l1-v)/(c*c+(l1-v)*(l1-v)) AS y2 FROM e)"""
query("as4_sensitivity_as_coded", f"{_AC} SELECT 0 AS j, round(l1*x2+l2*y2, 4) AS value FROM u UNION ALL SELECT 1, round(l1*y2+l2*x2, 4) FROM u")(
    lambda s, sf: _small(s, [(j, round(float(v), 4)) for j, v in enumerate(active.fit(active.gradients(_smooth(s, sf), 1, 14, 2), 1).sensitivity_as_coded)], "j int, value double"))
query("as2_eigenvalues", f"{_AC} SELECT 0 AS j, round(l1, 4) AS value FROM u UNION ALL SELECT 1, round(l2, 4) FROM u")(
    lambda s, sf: _small(s, [(j, round(float(v), 4)) for j, v in enumerate(active.fit(active.gradients(_smooth(s, sf), 1, 14, 2), 1).eigenvalues)], "j int, value double"))
query("as3_fit_svd", f"{_AC} SELECT 0 AS j, round(l1, 3) AS value FROM u")(
    lambda s, sf: _small(s, [(0, round(float(active.fit_svd(active.gradients(_smooth(s, sf), 1, 14, 2), 1).eigenvalues[0]), 3))], "j int, value double"))
query("r10_own_estimator", f"WITH {P}, {_NEAR}, y AS (SELECT i, a*a*0.01+b*0.1+a*b*0.001 AS y FROM p) SELECT q AS i, 0 AS j, round(avg(y), 6) + 0.0 AS value FROM n JOIN y ON y.i = n.row_id WHERE rank <= 5 GROUP BY 1 UNION ALL SELECT q, 1, round(max(y), 6) + 0.0 FROM n JOIN y ON y.i = n.row_id WHERE rank <= 5 GROUP BY 1")(
    lambda s, sf: _coo(active.gradients(_smooth(s, sf), 1, 5, 2, estimator=lambda x, y, x0: np.stack([y.mean(1), y.max(1)], 1))))


def _customers(spark, sf) -> DataFrame:
    """a = balance / 1000, b = nation / 10, and y = a^2 / 2 + b - a b / 4 + 2."""
    m = _t(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.array(F.col("c_acctbal") / 1000.0, F.col("c_nationkey") / 10.0).alias("features"))
    a, b = F.col("features")[0], F.col("features")[1]
    return m.withColumn("y", a * a * 0.5 + b - a * b * 0.25 + 2.0)


_CP = "p AS (SELECT c_custkey AS i, c_acctbal / 1000 AS a, c_nationkey / CAST(10 AS DOUBLE) AS b FROM customer)"
# gradients have 7 decimals: at 8 places none lies on a rounding edge
query("r9_grad_quadratic", _cols("a-0.25*b", "1-0.25*a", digits=8, cte=_CP))(lambda s, sf: _coo(active.gradients(_customers(s, sf), 2, 24, 2), 8))


@query("as_active_subspace", _cols("a-0.25*b", "1-0.25*a", cte=_QP))
def _(spark, sf):
    """Gradients, into the whole subspace and back."""
    g = stats.jac_from_quad(_quad(spark, sf), _QC, 2)
    a = active.fit(g, 2)
    return _coo(a.inverse(a.transform(g)))


# principal components

_PC = f"""{P}, c AS (SELECT var_samp(a) AS v, var_samp(b) AS w, covar_samp(a, b) AS c FROM p),
e AS (SELECT (v+w)/2 + sqrt((v-w)*(v-w)/4+c*c) AS l1, (v+w)/2 - sqrt((v-w)*(v-w)/4+c*c) AS l2, v, w, c FROM c)"""
query("pc5_explained_var", f"WITH {_PC} SELECT 0 AS j, round(l1, 4) AS value FROM e UNION ALL SELECT 1, round(l2, 4) FROM e")(
    lambda s, sf: _small(s, [(j, round(float(v), 4)) for j, v in enumerate(pca.fit(_part(s, sf), 2).explained_var)], "j int, value double"))
query("pc6_components", f"""WITH {_PC}, u AS (SELECT abs(c)/sqrt(c*c+(l1-v)*(l1-v)) AS x, sign(c)*abs(l1-v)/sqrt(c*c+(l1-v)*(l1-v)) AS y FROM e),
z AS (SELECT CASE WHEN abs(x) >= abs(y) THEN x ELSE x * sign(y) END AS x, CASE WHEN abs(x) >= abs(y) THEN y ELSE abs(y) END AS y FROM u)
SELECT 0 AS i, 0 AS j, round(x, 5) + 0.0 AS value FROM z UNION ALL SELECT 0, 1, round(y, 5) + 0.0 FROM z
UNION ALL SELECT 1, 0, round(CASE WHEN abs(x) >= abs(y) THEN -y ELSE y END, 5) + 0.0 FROM z UNION ALL SELECT 1, 1, round(CASE WHEN abs(x) >= abs(y) THEN x ELSE -x END, 5) + 0.0 FROM z""")(
    lambda s, sf: _matrix(s, pca.fit(_part(s, sf), 2).components, 5))
query("pca_lineitem", "SELECT round(var_samp(l_quantity) + var_samp(l_extendedprice) + var_samp(l_discount) + var_samp(l_tax), 2) AS total_var, CAST(4 AS BIGINT) AS n_comps FROM lineitem")(
    lambda s, sf: _small(s, [(round(float((m := pca.fit(_items(s, sf), 4)).explained_var.sum()), 2), len(m.components))], "total_var double, n_comps long"))
query("pc1_pca_randomized", f"WITH {_PC}, m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM p) SELECT round(l1, 3) AS l1, round(ma, 6) AS ma, round(mb, 6) AS mb FROM e, m")(
    lambda s, sf: _small(s, [(round(float((m := pca.fit(_part(s, sf), 1, n_iters=12, method="random")).explained_var[0]), 3), *(round(float(x), 6) for x in m.means))], "l1 double, ma double, mb double"))


@query("pc2_refit", f"WITH {_PC}, m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM p) SELECT 0 AS j, round(l1, 4) AS value, round(ma, 6) AS mean FROM e, m UNION ALL SELECT 1, round(l2, 4), round(mb, 6) FROM e, m")
def _(spark, sf):
    """A stored sketch of the odd parts, read back and merged with that of the even ones."""
    m = _part(spark, sf)
    old = stored(sketch.sketch(m.where("row_id % 2 = 1"), 8).to_df(spark), "sketch")
    model, _ = pca.refit(sketch.RowSketch.from_df(old), sketch.sketch(m.where("row_id % 2 = 0"), 8), 2)
    return _small(spark, [(j, round(float(v), 4), round(float(u), 6)) for j, (v, u) in enumerate(zip(model.explained_var, model.means))], "j int, value double, mean double")


@query("pc2_refit_bound", "SELECT count(*) AS n, true AS within FROM embeddings")
def _(spark, sf):
    """Eigenvalues of 64 columns from merged sketches of 40 rows: within the bound that they carry."""
    m = _emb(spark, sf)
    both = sketch.sketch(m.where("row_id % 3 = 0"), 40).merge(sketch.sketch(m.where("row_id % 3 <> 0"), 40))
    g = gm.gram(m, 64)
    gap = np.linalg.eigvalsh(g.raw) - np.linalg.eigvalsh(both.raw)
    return _small(spark, [(both.n, bool(gap.min() > -1e-6 and gap.max() <= both.loss + 1e-6 and both.loss <= np.trace(g.raw) / 20))], "n long, within boolean")


@query("as2_refit", f"{_AC} SELECT 0 AS j, round(l1, 4) AS value FROM u UNION ALL SELECT 1, round(l2, 4) FROM u")
def _(spark, sf):
    g = active.gradients(_smooth(spark, sf), 1, 14, 2)
    both = sketch.sketch(g.where("row_id % 2 = 0"), 8).merge(sketch.sketch(g.where("row_id % 2 = 1"), 8))
    return _small(spark, [(j, round(float(v), 4)) for j, v in enumerate(active.from_sketch(both, 1).eigenvalues)], "j int, value double")


@query("pc3_transform_on_target", f"WITH {_PC}, z AS (SELECT p.i, (a-(SELECT avg(a) FROM p))*(a-(SELECT avg(a) FROM p)) + (b-(SELECT avg(b) FROM p))*(b-(SELECT avg(b) FROM p)) AS d FROM p) SELECT i AS row_id, round(d, 3) + 0.0 AS d FROM z")
def _(spark, sf):
    m = _part(spark, sf)
    scores = pca.fit(m, 2).transform(ew.scalar_add(m, 5.0))  # centred on the target: the shift has no effect
    return scores.select("row_id", _r(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x), 3).alias("d"))


query("pc7_protocol_round_trip", "SELECT count(*) AS n, CAST(0 AS DOUBLE) AS pca, CAST(0 AS DOUBLE) AS active FROM part")(
    lambda s, sf: _small(s, [((m := _part(s, sf)).count(), round(pca.round_trip_error(pca.fit(m, 2), m, center_on="fit"), 7), round(pca.round_trip_error(active.fit(m, 2), m), 7))], "n long, pca double, active double"))


@query("pc3_pc4_round_trip", _cols("a", "b", digits=4))
def _(spark, sf):
    m = _part(spark, sf)
    model = pca.fit(m, 2)
    return _coo(model.inverse(model.transform(m, "fit")), 4)


# interpolation and reduced models


@query("i9_rbf_fit_predict", "SELECT CAST(n_nationkey AS BIGINT) AS row_id, round(CAST(n_regionkey AS DOUBLE), 4) + 0.0 AS x FROM nation")
def _(spark, sf):
    xy = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), F.array(F.col("n_nationkey") / 24.0).alias("features"), F.col("n_regionkey").cast("double").alias("y"))
    model = interp.RbfInterp(interp.linear(), 1, 1).fit_frame(xy)
    return model.predict(xy).select("row_id", _r("x", 4).alias("x"))


def _orders_on_a_line(spark, sf) -> DataFrame:
    # in units of 1,024 keys: places are exact numbers, since prices change by hundreds from key to key
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.array(F.col("o_orderkey") / 1024.0).alias("features"), (F.col("o_totalprice") / 1000).alias("y"))


query("i9_rbf_patches", "SELECT o_orderkey AS row_id, round(o_totalprice / 1000, 6) + 0.0 AS x FROM orders")(
    lambda s, sf: interp.PatchedRbf(interp.linear(), 1, 1).fit_frame(m := _orders_on_a_line(s, sf)).predict(m).select("row_id", _r("x", 6).alias("x")))


# linear kernels with a straight line beside them: halfway between neighbours lies their mean
@query("i10_rbf_patches_between", """
SELECT o_orderkey AS row_id, round((o_totalprice + next) / 2000, 7) + 0.0 AS x
FROM (SELECT o_orderkey, o_totalprice, lead(o_totalprice) OVER (ORDER BY o_orderkey) AS next FROM orders) WHERE next IS NOT NULL""")
def _(spark, sf):
    m = _orders_on_a_line(spark, sf)
    keys = global_rank(m.select("row_id"), [F.col("row_id")], "rank")
    half = keys.join(keys.select((F.col("rank") - 1).alias("rank"), F.col("row_id").alias("next")), "rank")
    q = half.select("row_id", F.array((F.col("row_id") + F.col("next")) / 2048.0).alias("features"))
    return interp.PatchedRbf(interp.linear(), 1, 1).fit_frame(m).predict(q).select("row_id", _r("x", 7).alias("x"))


@query("i8_rbf_kernels_at_supports", " UNION ALL ".join(f"SELECT '{k}' AS kernel, CAST(n_nationkey AS BIGINT) AS row_id, round(CAST(n_regionkey AS DOUBLE), 3) + 0.0 AS x FROM nation" for k in ("linear", "cubic", "multiquadric", "gaussian")))
def _(spark, sf):
    xy = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), F.array(F.col("n_nationkey") / 24.0).alias("features"), F.col("n_regionkey").cast("double").alias("y"))
    out = None
    for k in (interp.linear(), interp.cubic(), interp.multiquadric(20.0), interp.gaussian(20.0)):
        one = interp.RbfInterp(k, 1, 1).fit_frame(xy).predict(xy).select(F.lit(k.name).alias("kernel"), "row_id", _r("x", 3).alias("x"))
        out = one if out is None else out.unionByName(one)
    return out


@query("i5_own_kernel", "SELECT CAST(n_nationkey AS BIGINT) AS row_id, round(CAST(n_regionkey AS DOUBLE), 4) + 0.0 AS x FROM nation")
def _(spark, sf):
    """A kernel that callers bring: the fifth power."""
    own = interp.Kernel("fifth", lambda r: r**5, lambda r: F.pow(r, 5))
    xy = _nations(spark, sf)
    return interp.RbfInterp(own, 1, 1).fit_frame(xy).predict(xy).select("row_id", _r("x", 4).alias("x"))


@query("po_pod_reconstruct", f"WITH {_EV}, {_W} SELECT t AS t_idx, j AS row_id, round(v, 9) + 0.0 AS x FROM s".replace("t AS t_idx", "CAST(t AS INTEGER) AS t_idx").replace("j AS row_id", "CAST(j AS BIGINT) AS row_id"))
def _(spark, sf):
    days = _days(spark, sf).select(F.col("t_idx").cast("long").alias("snap_id"), F.array(F.col("t_idx").cast("double")).alias("t"), F.col("state").alias("field"))
    model = pod.fit(days, 5)
    return model.predict(model.times).select("t_idx", "row_id", _r("x", 9).alias("x"))


_HALF = """SELECT CAST(a.n_nationkey AS BIGINT) AS row_id, round((a.n_regionkey + b.n_regionkey) / CAST(2 AS DOUBLE), 6) + 0.0 AS x
FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1"""


def _nations(spark, sf, shift=0.0) -> DataFrame:
    return _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), F.array((F.col("n_nationkey") + shift) / 24.0).alias("features"), F.col("n_regionkey").cast("double").alias("y"))


# linear kernels with a straight line beside them interpolate linearly between the supports
query("i10_rbf_off_supports", _HALF)(
    lambda s, sf: interp.RbfInterp(interp.linear(), 1, 1).fit_frame(_nations(s, sf)).predict(_nations(s, sf, 0.5).where("row_id < 24")).select("row_id", _r("x").alias("x")))


@query("api_rbf_interp", _HALF)
def _(spark, sf):
    from .. import api

    rows = _nations(spark, sf).orderBy("row_id").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["y"] for r in rows])
    f = api.RbfInterp(1, 0.0, 1, 1)
    f.fit(x, y)
    out = f.predict((x[:-1] + x[1:]) / 2)[:, 0]
    return _small(spark, [(int(r["row_id"]), round(float(v), 6) + 0.0) for r, v in zip(rows, out)], "row_id long, x double")


def _snapshots(spark, sf) -> DataFrame:
    return _days(spark, sf).select(F.col("t_idx").cast("long").alias("snap_id"), F.array(F.col("t_idx").cast("double")).alias("t"), F.col("state").alias("field"))


_BETWEEN = f"WITH {_EV}, {_W} SELECT CAST(x.t AS INTEGER) AS t_idx, CAST(x.j AS BIGINT) AS row_id, round({{}}, 4) + 0.0 AS x FROM s x JOIN s y ON y.t = x.t + 1 AND y.j = x.j"
for _name, _at, _sql, _how in (
    ("po4_pod_between_times", 0.3137, "0.6863*x.v+0.3137*y.v", {}), ("py_pod_linear", 0.3137, "0.6863*x.v+0.3137*y.v", {"kind": "linear"}), ("py_pod_nearest", 0.75, "y.v", {"kind": "nearest"}),
    ("py_pod_previous", 0.75, "x.v", {"kind": "previous"}), ("py_pod_next", 0.25, "y.v", {"kind": "next"}), ("py_pod_lstsq", 0.3137, "0.6863*x.v+0.3137*y.v", {"weights_by": "lstsq"}),
    ("py_pod_random_basis", 0.3137, "0.6863*x.v+0.3137*y.v", {"basis": "random"}), ("py_pod_unsorted_basis", 0.3137, "0.6863*x.v+0.3137*y.v", {"basis": "unsorted", "weights_by": "lstsq"}),
):
    # means themselves come back as they are: at 4 places some lie on a rounding edge, at 9 none does
    _digits = 9 if _sql in ("x.v", "y.v") else 4

    def _pod(spark, sf, at=_at, how=_how, digits=_digits):
        m = pod.fit(_snapshots(spark, sf), 30 if how.get("basis") == "unsorted" else 5, **how)
        return m.predict(m.times[:-1] + at).select("t_idx", "row_id", _r("x", digits).alias("x"))

    query(_name, _BETWEEN.format(_sql).replace(", 4)", f", {_digits})"))(_pod)


@query("po6_refit", f"WITH {_EV}, {_W} SELECT CAST(t AS INTEGER) AS t_idx, CAST(j AS BIGINT) AS row_id, round(v, 9) + 0.0 AS x FROM s")
def _(spark, sf):
    """Fitted on the first days, then again on all."""
    days = _snapshots(spark, sf)
    pod.fit(days.where("snap_id < 10"), 5)
    model = pod.fit(days, 5)
    return model.predict(model.times).select("t_idx", "row_id", _r("x", 9).alias("x"))


# balances that follow a cubic in time, which the spline meets between its knots
@query("py_pod_cubic", """SELECT CAST(t AS INTEGER) AS t_idx, CAST(row_number() OVER (PARTITION BY t ORDER BY s_suppkey) - 1 AS BIGINT) AS row_id,
 round(s_acctbal / 1000 * (1 + (t+0.37)/10 - pow(t+0.37, 2)/100 + pow(t+0.37, 3)/1000), 6) + 0.0 AS x FROM supplier, range(9) AS r(t)""")
def _(spark, sf):
    t = F.col("snap_id")
    shape = 1 + t / 10 - t * t / 100 + t * t * t / 1000
    field = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_acctbal"))), lambda c: c["s_acctbal"])
    one = _t(spark, sf, "supplier").agg(field.alias("all"))
    steps = one.withColumn("snap_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    snaps = steps.select("snap_id", F.array(t.cast("double")).alias("t"), F.transform("all", lambda v: v / 1000 * shape).alias("field"))
    return pod.fit(snaps, 1, kind="cubic").predict(np.arange(9.0)[:, None] + 0.37).select("t_idx", "row_id", _r("x", 6).alias("x"))


@query("api_pod_interp", f"WITH {_EV}, {_W} SELECT CAST(j AS BIGINT) AS row_id, round(v, 6) + 0.0 AS x FROM s WHERE t = 0")
def _(spark, sf):
    from .. import api

    x = np.array([r["state"] for r in _days(spark, sf).orderBy("t_idx").collect()])
    out = api.PodI(spark, x, None, 5).predict(0.0)[:, 0]  # without times: evenly from 0 to 1
    return _small(spark, [(i, round(float(v), 6) + 0.0) for i, v in enumerate(out)], "row_id long, x double")


@query("api_cs_dirichlet_sample", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS outside, CAST(20 AS BIGINT) AS padded, true AS short_list FROM customer")
def _(spark, sf):
    from .. import api

    b = np.array([(0.1, 0.4), (0.2, 0.6), (0.1, 0.7)])
    x = api.cs_dirichlet_sample(spark, b, _t(spark, sf, "customer").count(), 50, 2000)
    none = api.cs_dirichlet_sample(spark, [(0.9, 1.0), (0.9, 1.0)], 20, 2, 50, pad_zeros=True)
    short = api.py_cs_dirichlet_sample(spark, [(0.9, 1.0), (0.9, 1.0)], 20, 2, 50)
    bad = int((((x < b[:, 0]) | (x > b[:, 1])).any(1) | (np.abs(x.sum(1) - 1) > 1e-12)).sum())
    return _small(spark, [(len(x), bad, int((none == 0).all(1).sum()), isinstance(short, list) and not short)], "n long, outside long, padded long, short_list boolean")


_A = np.array([[0.9, 0.1, 0.0], [-0.2, 0.8, 0.1], [0.0, 0.05, 0.95]])
_B = np.array([[0.5], [0.0], [-0.25]])
# three hidden states, driven by the mean event of each day, seen through one row of factors per supplier
_U = f"""{_EV.replace("SELECT CAST(datediff", "SELECT CAST(datediff").replace(", event_type AS e", "").replace("GROUP BY 1, 2", "GROUP BY 1")}, u AS (SELECT t, (v - 50) / 10 AS u FROM ev)"""
_SEEN = "p AS (SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS i, CAST(1 AS DOUBLE) AS p0, s_acctbal / 10000 AS p1, (s_suppkey % 7) / CAST(7 AS DOUBLE) AS p2 FROM supplier)"
_REC = f"""WITH RECURSIVE {_U}, {_SEEN}, r(t, x, y, z) AS (SELECT 0, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(-1 AS DOUBLE) UNION ALL
 SELECT r.t + 1, 0.9*x+0.1*y+0.5*u, -0.2*x+0.8*y+0.1*z, 0.05*y+0.95*z-0.25*u FROM r JOIN u ON u.t = r.t WHERE r.t < 15)
"""


def _loadings(spark, sf) -> DataFrame:
    """How each supplier sees the hidden states."""
    return _t(spark, sf, "supplier").select("s_suppkey", F.lit(1.0).alias("p0"), (F.col("s_acctbal") / 10000).alias("p1"), (F.col("s_suppkey") % 7 / 7.0).alias("p2"))


def _driven(spark, sf):
    """(steps, factors, hidden states, controls): 16 steps of one state per supplier."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    means = _t(spark, sf, "events").groupBy(day.alias("t")).agg(F.avg("value").alias("v")).where("t < 16").orderBy("t").collect()
    u = np.array([(r["v"] - 50) / 10 for r in means])
    z = [np.array([1.0, 0.0, -1.0])]
    for t in range(15):
        z.append(_A @ z[-1] + _B[:, 0] * u[t])
    seen = _loadings(spark, sf).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "p0", "p1", "p2"))).alias("p"))
    hidden = _small(spark, [(t, *map(float, v), [float(u[t])]) for t, v in enumerate(z)], "t_idx int, x double, y double, z double, control array<double>")
    state = F.transform("p", lambda p: p["p0"] * F.col("x") + p["p1"] * F.col("y") + p["p2"] * F.col("z"))
    factors = np.array([list(r)[1:] for r in seen.first()["p"]])
    return hidden.crossJoin(F.broadcast(seen)).select("t_idx", state.alias("state"), "control"), factors, np.array(z), u


def _fitted(spark, sf):
    steps, p, z, u = _driven(spark, sf)
    return dmd.fit(steps, 4), p, z, u


_THROUGH = "round(p0*{x} + p1*{y} + p2*{z}, 4) + 0.0 AS value"


@query("dm8_dmdc_predict", _REC + " SELECT i, CAST(t - 1 AS INTEGER) AS j, " + _THROUGH.format(x="x", y="y", z="z") + " FROM r, p WHERE t > 0")
def _(spark, sf):
    model, p, z, u = _fitted(spark, sf)
    return _coo(model.predict_multiple(p @ z[0], u[None, :15]), 4)


# the operator on the suppliers' factors: what it makes of each hidden state
@query("dm5_est_a", f"WITH {_SEEN} " + " UNION ALL ".join(
    f"SELECT i, {j} AS j, " + _THROUGH.format(x=float(_A[0, j]), y=float(_A[1, j]), z=float(_A[2, j])) + " FROM p" for j in range(3)))
def _(spark, sf):
    model = _fitted(spark, sf)[0]
    rows = global_rank(_loadings(spark, sf), [F.col("s_suppkey")], "row_id")
    return _coo(model.applied(rows.select("row_id", F.array("p0", "p1", "p2").alias("features"))), 9).withColumn("value", _r("value", 4))  # noise of some 1e-11 decides no rounding


query("dm6_est_b", f"WITH {_SEEN} SELECT i, 0 AS j, " + _THROUGH.format(x=0.5, y=0.0, z=-0.25) + " FROM p")(lambda s, sf: _coo(_fitted(s, sf)[0].est_b(), 4))


@query("dm7_predict_one_step", f"WITH {_SEEN} SELECT i, 0 AS j, " + _THROUGH.format(x=1.1, y=1.0, z=1.45) + " FROM p")
def _(spark, sf):
    model, p, _, _ = _fitted(spark, sf)
    return _coo(model.predict(p @ np.array([0.0, 1.0, 2.0]), np.array([2.0])), 4)


@query("dm3_modes_and_eigs", "SELECT count(*) AS n_x, CAST(2.65 AS DOUBLE) AS trace, CAST(0.6985 AS DOUBLE) AS det, CAST(0 AS DOUBLE) AS residual FROM supplier")
def _(spark, sf):
    """Trace and determinant of the operator by its eigenvalues, and how far its modes are from eigenvectors."""
    m = _fitted(spark, sf)[0]
    big = np.argsort(-np.abs(m.eigs))[:3]
    gap = m.mode_residual(big)
    return _small(spark, [(m.n_x, round(float(m.eigs[big].sum().real), 4), round(float(np.prod(m.eigs[big]).real), 4), round(float(gap), 4) + 0.0)], "n_x long, trace double, det double, residual double")


@query("py_dmd_driver", _REC.replace("JOIN u ON u.t = r.t WHERE r.t < 15", "JOIN u ON u.t = r.t + 1 WHERE r.t < 14") + " SELECT i, CAST(t - 1 AS INTEGER) AS j, " + _THROUGH.format(x="x", y="y", z="z") + " FROM r, p WHERE t > 0")
def _(spark, sf):
    from .. import api

    _, p, z, u = _driven(spark, sf)
    return _coo(src.from_numpy(spark, api.dmdc_benchmark(spark, p @ z.T, u[None], 4)[:, :14]), 4)


# samplers

_BOX = [(0.0, 0.004), (0.19, 0.2), (0.8, 0.82)]


@query("x2_constrained_dirichlet", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS violations, true AS sums_to_one FROM supplier")
def _(spark, sf):
    m = sampling.constrained_dirichlet(spark, _BOX, _t(spark, sf, "supplier").count(), 500, 20_000, 1.0, [0.6], 3)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return m.agg(F.count("*").alias("n"), F.count_if(~ew.in_box(F.col("features"), _BOX)).alias("violations"), (F.max(F.abs(total - 1)) < 1e-12).alias("sums_to_one"))


@query("x3_mv_normal", "SELECT count(*) AS n, true AS cov_is_squared, true AS cov_is_cov FROM orders")
def _(spark, sf):
    """As many draws as orders, with the correlation of sizes and prices of parts."""
    n, c = _t(spark, sf, "orders").count(), stats.pearson_corr(_part(spark, sf)) * 0.9 + 0.1
    a = gm.gram(sampling.mv_normal(spark, c, n, 1))
    b = gm.gram(sampling.mv_normal(spark, c, n, 1, "cholesky")).cov
    return _small(spark, [(a.n, bool(np.abs(a.cov - c @ c).max() < 8 / n**0.5), bool(np.abs(b - c).max() < 8 / n**0.5))], "n long, cov_is_squared boolean, cov_is_cov boolean")


def _target(spark, sf):
    """(log density, deviation, mean) of a normal fitted to the events."""
    f = dist.NormalRv().mlfit(_t(spark, sf, "events"), "value")
    return (lambda x: -0.5 * ((x[:, 0] - f.mu) / f.std) ** 2), f.std, f.mu


_NEAR_MU = """(SELECT count(*) FROM nation) AS n_seeds, true AS mean_ok, true AS std_ok, true AS ratio_ok"""


@query("x13_demc_gaussian", f"SELECT CAST(2 * 8 * 2501 AS BIGINT) AS n, {_NEAR_MU}")
def _(spark, sf):
    """Chains that start at the nations' regions and end at the events' distribution."""
    lnp, sd, mu = _target(spark, sf)
    starts = np.array([[float(r[0])] for r in _t(spark, sf, "nation").orderBy("n_nationkey").select("n_regionkey").collect()])
    c = sampling.ensembles(spark, sampling.ln_sum(lnp, sampling.ln_prior_uniform([(mu - 20 * sd, mu + 20 * sd)])), starts[:8] + np.arange(8)[:, None], 2500, 2, 0.8, 1e-10, None, 4)
    x = F.col("sample")[0]
    return c.agg(
        F.count("*").alias("n"), F.lit(len(starts)).cast("long").alias("n_seeds"), (F.abs(F.avg(x) - mu) < sd / 6).alias("mean_ok"), (F.abs(F.stddev(x) - sd) < sd / 6).alias("std_ok"),
        (F.avg(F.col("accepted").cast("int")) > 0.2).alias("ratio_ok"))


@query("x12_demc_sequential", "SELECT CAST(8 * 1001 AS BIGINT) AS n, true AS mean_ok, true AS ratio_ok")
def _(spark, sf):
    lnp, sd, mu = _target(spark, sf)
    c = sampling.ensembles(spark, lnp, mu + sd * np.arange(-4, 4)[:, None] / 4, 1000, 1, 0.8, 1e-10, None, 4, sequential=True)
    return c.agg(F.count("*").alias("n"), (F.abs(F.avg(F.col("sample")[0]) - mu) < sd / 3).alias("mean_ok"), (F.avg(F.col("accepted").cast("int")) > 0.2).alias("ratio_ok"))


@query("x_mcmc_dirichlet", "SELECT CAST(200 * count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS violations, true AS sums_to_one, true AS moves FROM nation")
def _(spark, sf):
    """One chain for each nation."""
    from .. import api

    x, ratio = api.cs_mcmc_dirichlet_sample(spark, _BOX, 200, _t(spark, sf, "nation").count(), 500, 20_000, 1.0, [0.6])
    b = np.array(_BOX)
    bad = int((~((x >= b[:, 0]) & (x <= b[:, 1])).all(1)).sum())
    return _small(spark, [(len(x), bad, bool(np.abs(x.sum(1) - 1).max() < 1e-9), bool(ratio > 0.2))], "n long, violations long, sums_to_one boolean, moves boolean")


@query("x7_ln_like_dirichlet", "SELECT n_nationkey AS i, round(lgamma(6.0) - lgamma(2.0) - lgamma(1.0) - lgamma(3.0) + ln(x) + 2 * ln(z), 6) + 0.0 AS lnp FROM (SELECT n_nationkey, (n_nationkey + 1) / CAST(60 AS DOUBLE) AS x, 0.9 - (n_nationkey + 1) / CAST(60 AS DOUBLE) AS z FROM nation)")
def _(spark, sf):
    lnp = sampling.ln_like_dirichlet([2, 1, 3])

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = (b.column(0).to_numpy() + 1) / 60
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lnp(np.stack([x, np.full(len(x), 0.1), 0.9 - x], 1)))], ["i", "lnp"])

    return _t(spark, sf, "nation").select("n_nationkey").mapInArrow(run, "i int, lnp double").select("i", _r("lnp").alias("lnp"))


# distributions

_ERF = """CASE WHEN z = 0 THEN 0.0 WHEN abs(z) > 6 THEN sign(z) ELSE sign(z) * 2/sqrt(pi())*exp(-z*z)*list_sum(list_transform(range(0,150),
 lambda n: abs(z)*exp(n*ln(2.0*z*z)-(lgamma(2*n+2)-n*ln(2.0)-lgamma(n+1))))) END"""


def _ev(s, sf):
    return _t(s, sf, "events").select("event_id", "value")


def _dist(name: str, rv, which: str, sql: str, x=None) -> None:
    query(name, f"SELECT event_id, round({sql}, 8) + 0.0 AS y FROM events")(
        lambda s, sf: _ev(s, sf).select("event_id", _r(getattr(rv, which)(F.col("value") if x is None else x(F.col("value"))), 8).alias("y")))


_dist("n1_normal_pdf", dist.NormalRv(50.0, 40.0), "pdf", "exp(-0.5*pow((value-50)/40,2))/(40*sqrt(2*pi()))")
_dist("q1_exponential_pdf", dist.ExponentialRv(0.02), "pdf", "0.02*exp(-0.02*value)")
_dist("q2_exponential_cdf", dist.ExponentialRv(0.02), "cdf", "1-exp(-0.02*value)")
_dist("b1_beta_pdf", dist.BetaRv(2.0, 3.0, 0.0, 1000.0), "pdf", "(value/1000)*pow(1-value/1000,2)*exp(lgamma(5.0)-lgamma(2.0)-lgamma(3.0))")
_dist("b2_beta_cdf", dist.BetaRv(2.0, 3.0, 0.0, 1000.0), "cdf", "6*pow(value/1000,2)-8*pow(value/1000,3)+3*pow(value/1000,4)")
query("n2_normal_cdf", f"SELECT event_id, round(0.5*(1+{_ERF}), 8) + 0.0 AS y FROM (SELECT event_id, (value-50)/(40*sqrt(2.0)) AS z FROM events)")(
    lambda s, sf: _ev(s, sf).select("event_id", _r(dist.NormalRv(50.0, 40.0).cdf(F.col("value")), 8).alias("y")))
query("n4_normal_mle", "SELECT round(avg(value), 6) AS mu, round(stddev_pop(value), 6) AS std FROM events")(
    lambda s, sf: _small(s, [(round((f := dist.NormalRv().mlfit(_ev(s, sf), "value")).mu, 6), round(f.std, 6))], "mu double, std double"))
query("l4_normal_mle_lbfgs", "SELECT round(avg(value), 2) AS mu, round(stddev_pop(value), 2) AS std FROM events")(
    lambda s, sf: _small(s, [(round(float((f := dist.NormalRv().mlfit(_ev(s, sf), "value", 2)).mu), 2), round(float(f.std), 2))], "mu double, std double"))
query("q4_exponential_mle", "SELECT round(1/avg(value), 8) AS lam FROM events")(lambda s, sf: _small(s, [(round(dist.ExponentialRv().mlfit(_ev(s, sf), "value").lam, 8),)], "lam double"))
query("l3_exponential_mle_swarm", "SELECT round(1/avg(value), 5) AS lam FROM events")(lambda s, sf: _small(s, [(round(float(dist.ExponentialRv().mlfit(_ev(s, sf), "value", 1).lam), 5),)], "lam double"))
query("l2_exponential_mle_descent", "SELECT round(1/avg(value), 4) AS lam FROM events")(lambda s, sf: _small(s, [(round(float(dist.ExponentialRv().mlfit(_ev(s, sf), "value", 0).lam), 4),)], "lam double"))
query("b4_beta_moments", """WITH m AS (SELECT avg(value/1000) AS m, var_samp(value/1000) AS v FROM events)
SELECT round(m*(m*(1-m)/v-1), 6) AS alpha, round((1-m)*(m*(1-m)/v-1), 6) AS beta FROM m""")(
    lambda s, sf: _small(s, [(round((f := dist.BetaRv(1, 1, 0.0, 1000.0).mlfit(_ev(s, sf), "value")).alpha, 6), round(f.beta, 6))], "alpha double, beta double"))


@query("b5_beta_mle", "SELECT true AS beats_moments, true AS stationary")
def _(spark, sf):
    e = _ev(spark, sf)
    rv = dist.BetaRv(1.0, 1.0, 0.0, 1000.0)
    a, b = rv.mlfit(e, "value"), rv.mlfit(e, "value", 2)
    v = dist.nll_many(e, "value", rv, [(a.alpha, a.beta), (b.alpha, b.beta), (b.alpha * 1.02, b.beta), (b.alpha * 0.98, b.beta), (b.alpha, b.beta * 1.02), (b.alpha, b.beta * 0.98)])
    return _small(spark, [(bool(v[1] <= v[0]), bool((v[1] <= v[2:]).all()))], "beats_moments boolean, stationary boolean")


query("a7_nll", "SELECT round(-sum(ln(exp(-0.5*pow((value-50)/40,2))/(40*sqrt(2*pi())))), 3) AS nll FROM events")(
    lambda s, sf: _small(s, [(round(dist.NormalRv(50.0, 40.0).nll(_ev(s, sf), "value"), 3),)], "nll double"))
query("l6_penalised_cost", "SELECT round(-sum(ln(0.02*exp(-0.02*value))), 3) AS inside, round(-sum(ln(120*exp(-120*value/1000))) + 10*400.0, 3) AS outside FROM events")(
    lambda s, sf: _small(s, [(
        round(float(dist.mle_problem(e := _ev(s, sf), "value", dist.ExponentialRv(), [1.0], [[1e-12], [100.0]]).cost([[0.02]])[0]), 3),
        round(float(dist.mle_problem(e.select((F.col("value") / 1000).alias("value")), "value", dist.ExponentialRv(), [1.0], [[1e-12], [100.0]]).cost([[120.0]])[0]), 3))], "inside double, outside double"))


@query("l7_gradient", "SELECT round(avg(value) - 50, 3) + 0.0 AS d_lam FROM events")
def _(spark, sf):
    p = dist.mle_problem(_ev(spark, sf), "value", dist.ExponentialRv(), [1.0], [[1e-12], [100.0]])
    return _small(spark, [(round(float(p.gradient(np.array([0.02]))[1][0]) / _t(spark, sf, "events").count(), 3) + 0.0,)], "d_lam double")


_KD = "SELECT c_custkey AS q, round(avg({}), 8) + 0.0 AS y FROM customer, supplier GROUP BY 1"


def _kernels(s, sf, digits, scale=1.0, **how):
    """Kernels at the suppliers' balances, summed up at the customers'."""
    q = _t(s, sf, "customer").select(F.col("c_custkey").alias("q"), F.col("c_acctbal").alias("x"))
    out = kde.kernel_sums(q, _t(s, sf, "supplier").select(F.col("s_acctbal").alias("s")), 1500.0, name="y", **how)
    return out.select("q", _r(F.col("y") * scale, digits).alias("y"))


query("k2_kde_pdf", _KD.format("1000*exp(-0.5*pow((c_acctbal-s_acctbal)/1500,2))/(1500*sqrt(2*pi()))"))(lambda s, sf: _kernels(s, sf, 8, 1000.0))
query("k3_kde_cdf", f"SELECT q, round(avg(0.5*(1+{_ERF})), 6) + 0.0 AS y FROM (SELECT c_custkey AS q, (c_acctbal-s_acctbal)/(1500*sqrt(2.0)) AS z FROM customer, supplier) GROUP BY 1")(
    lambda s, sf: _kernels(s, sf, 6, cumulative=True))


def _draws(name: str, fit) -> None:
    """As many draws as events, of a distribution fitted to them: their means agree within five standard errors."""

    @query(name, "SELECT count(*) AS n, true AS mean_ok FROM events")
    def _(spark, sf):
        e = _ev(spark, sf)
        n, m = e.agg(F.count("value"), F.avg("value")).first()
        rv, mean = fit(spark, sf, e), F.avg("x")
        return rv.sample(spark, n, 2).agg(F.count("*").alias("n"), (F.abs(mean - m) < 5 * F.stddev("x") / n**0.5).alias("mean_ok"))


_draws("n3_normal_sample", lambda s, sf, e: dist.NormalRv().mlfit(e, "value"))
_draws("b3_beta_sample", lambda s, sf, e: dist.BetaRv(1.0, 1.0, 0.0, 1000.0).mlfit(e, "value"))
_draws("q3_exponential_sample", lambda s, sf, e: dist.ExponentialRv().mlfit(e, "value"))


@query("k4_kde_sample", "SELECT count(*) AS n, true AS mean_ok FROM customer")
def _(spark, sf):
    """As many draws as customers, around the balances of the nations' mean suppliers."""
    means = _t(spark, sf, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("m")).orderBy("s_nationkey").collect()
    x = np.array([r["m"] for r in means])  # a row for each nation
    n = _t(spark, sf, "customer").count()
    return dist.KdeRv(50.0, x).sample(spark, n, 2).agg(F.count("*").alias("n"), (F.abs(F.avg("x") - float(x.mean())) < 5 * F.stddev("x") / n**0.5).alias("mean_ok"))


@query("k6_build_kde", "SELECT true AS positive, s_acctbal AS median FROM (SELECT s_acctbal, row_number() OVER (ORDER BY s_acctbal) - 1 AS r, count(*) OVER () AS n FROM supplier) WHERE r = n // 2")
def _(spark, sf):
    t = _t(spark, sf, "supplier")
    h = dist.split_bandwidth(t, "s_acctbal", "s_suppkey", 1.0, 5)
    return _small(spark, [(bool(0 < h <= 1000), float(value_at(t, "s_acctbal", t.count() // 2)))], "positive boolean, median double")


# array interface

query("o3_sort_evd", f"WITH {_PC} SELECT 0 AS j, round(l1, 4) AS value FROM e UNION ALL SELECT 1, round(l2, 4) FROM e")(
    lambda s, sf: _small(s, [(j, round(float(v), 4)) for j, v in enumerate(linalg.sort_evd(*np.linalg.eigh(gm.gram(_part(s, sf)).cov))[0])], "j int, value double"))


@query("api_rsvd", "SELECT round(sum(CAST(p_size AS DOUBLE) * p_size + p_retailprice * p_retailprice), 0) AS sum_squares FROM part")
def _(spark, sf):
    from .. import api

    _, s, _ = api.rsvd(src.to_numpy(_part(spark, sf)), 2, 4, 10)
    return _small(spark, [(round(float((s**2).sum()), 0),)], "sum_squares double")


@query("api_rpca", f"WITH {_PC} SELECT 0 AS j, round(l1, 4) AS value FROM e UNION ALL SELECT 1, round(l2, 4) FROM e")
def _(spark, sf):
    from .. import api

    a = src.to_numpy(_part(spark, sf))
    s, _ = api.rpca(a, 2)
    return _small(spark, [(j, round(float(v), 4)) for j, v in enumerate(s[:, 0] ** 2 / (len(a) - 1))], "j int, value double")


@query("api_active_ss", f"WITH {_G} SELECT 0 AS j, round(avg(g1*g1), 4) AS value FROM g UNION ALL SELECT 1, round(avg(g2*g2), 4) FROM g")
def _(spark, sf):
    from .. import api

    rows = _smooth(spark, sf).orderBy("row_id").select("features", "y").toPandas()
    _, _, sens = api.active_ss(spark, np.array(rows["features"].tolist()), rows["y"].to_numpy(), 1, 14, 1)
    return _small(spark, [(j, round(float(v), 4)) for j, v in enumerate(sens)], "j int, value double")


@query("api_dmdc_with_start", _REC + " SELECT i, CAST(t AS INTEGER) AS j, " + _THROUGH.format(x="x", y="y", z="z") + " FROM r, p")
def _(spark, sf):
    from .. import api

    _, p, z, u = _driven(spark, sf)
    out = api.DMDc(spark, p @ z.T, u[None], 4).predict(p @ z[0], u[None, :15], include_start=True)
    return _coo(src.from_numpy(spark, out), 4)


# the least value on a grid of 4,001 widths up to the upper bound
@query("k5_est_bandwidth", """
WITH s AS (SELECT s_acctbal AS s FROM supplier WHERE s_suppkey % 2 = 0), t AS (SELECT s_suppkey AS k, s_acctbal AS x FROM supplier WHERE s_suppkey % 2 = 1),
h AS (SELECT 1000 * exp(-i * 0.0015) AS h FROM range(4001) AS r(i)),
d AS (SELECT h, k, avg(exp(-0.5 * pow((x - s) / h, 2)) / (h * sqrt(2 * pi()))) AS d FROM h, t, s GROUP BY 1, 2),
v AS (SELECT h, sum(CASE WHEN d > 0 THEN -ln(d) ELSE 1e12 END) AS v FROM d GROUP BY 1)
SELECT (SELECT count(*) FROM t) AS n_test, round(min(v), 2) AS nll FROM v""")
def _(spark, sf):
    t = _t(spark, sf, "supplier")
    s = t.where("s_suppkey % 2 = 0").select(F.col("s_acctbal").alias("s"))
    x = t.where("s_suppkey % 2 = 1").select(F.col("s_acctbal").alias("x"))
    h = dist.estimated_bandwidth(s, x, 1500.0)
    each = kde.kernel_sums(x, s, h).select((-F.log("density")).alias("v"))
    return each.agg(F.count("*").alias("n_test"), F.round(F.sum("v"), 2).alias("nll"))
