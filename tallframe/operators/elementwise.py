"""Element-wise, reshaping and predicate operators on row and coordinate matrices.

Everything here is a Column expression or an equi-join: no Python on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.matrices import to_coo

FEATURES = "features"


def _lit(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _with(m: DataFrame, column: Column) -> DataFrame:
    return m.select("row_id", column.alias(FEATURES))


def scalar_fn(m: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """fn (a Column expression) of every entry."""
    return _with(m, F.transform(FEATURES, fn))


def col_vec_add(m: DataFrame, v) -> DataFrame:
    """a[i, j] + v[j]."""
    return _with(m, F.zip_with(FEATURES, _lit(v), lambda a, b: a + b))


def row_vec_add(m: DataFrame, v: DataFrame) -> DataFrame:
    """a[i, j] + v[i]; ``v(row_id, x)``."""
    j = m.join(v, "row_id")
    return j.select("row_id", F.transform(FEATURES, lambda a: a + F.col("x")).alias(FEATURES))


def vec_add(m: DataFrame, v, axis: int) -> DataFrame:
    """Axis 0 adds a value per column, any other a value per row."""
    return col_vec_add(m, v) if axis == 0 else row_vec_add(m, v)


def ele_pow(m: DataFrame, p: float) -> DataFrame:
    return scalar_fn(m, lambda x: F.pow(x, F.lit(float(p))))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entry-wise product of rows with equal ids."""
    j = a.join(b.select("row_id", F.col(FEATURES).alias("other")), "row_id")
    return j.select("row_id", F.zip_with(FEATURES, "other", lambda x, y: x * y).alias(FEATURES))


def scalar_add(m: DataFrame, b: float) -> DataFrame:
    return scalar_fn(m, lambda x: x + F.lit(float(b)))


def scale(m: DataFrame, c: float) -> DataFrame:
    return scalar_fn(m, lambda x: x * F.lit(float(c)))


def set_row(m: DataFrame, row: int, v) -> DataFrame:
    return _with(m, F.when(F.col("row_id") == row, _lit(v)).otherwise(F.col(FEATURES)))


def set_col(m: DataFrame, col: int, v: DataFrame) -> DataFrame:
    """Column ``col`` replaced by ``v(row_id, x)``."""
    j = m.join(v, "row_id")
    return j.select("row_id", F.transform(FEATURES, lambda a, i: F.when(i == col, F.col("x")).otherwise(a)).alias(FEATURES))


col_mod = set_col
row_mod = set_row


def complex_from_parts(re: DataFrame, im: DataFrame) -> DataFrame:
    j = re.join(im.select("row_id", F.col(FEATURES).alias("im")), "row_id")
    return j.select("row_id", F.zip_with(FEATURES, "im", lambda x, y: F.struct(x.alias("re"), y.alias("im"))).alias(FEATURES))


def parts_from_complex(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    return scalar_fn(m, lambda c: c["re"]), scalar_fn(m, lambda c: c["im"])


def vec_to_diag(v: DataFrame) -> DataFrame:
    """(row_id, x) -> coordinates of the diagonal matrix."""
    return v.select(F.col("row_id").alias("i"), F.col("row_id").alias("j"), F.col("x").alias("value"))


def rowvec_to_diag(m: DataFrame) -> DataFrame:
    """A matrix of one row -> coordinates of the diagonal matrix."""
    return m.select(F.posexplode(FEATURES).alias("i", "value")).select("i", F.col("i").alias("j"), "value")


def diag_to_dense(coo: DataFrame, n: int) -> DataFrame:
    """Diagonal coordinates -> n x n row matrix; n is checked to be small
    enough for one array per row."""
    if n > 100_000:
        raise ValueError("a dense diagonal of this size isn't useful; keep coordinates")
    zero = F.sequence(F.lit(0), F.lit(n - 1))
    return coo.where("i = j").select(
        F.col("i").cast("long").alias("row_id"),
        F.transform(zero, lambda k: F.when(k == F.col("i"), F.col("value")).otherwise(F.lit(0.0))).alias(FEATURES),
    )


def pinv_diag(coo: DataFrame) -> DataFrame:
    """1 / (d + 1e-20), exactly 0 where abs(d) < 1e-20."""
    d = F.col("value")
    return coo.where("i = j").select("i", "j", F.when(F.abs(d) < 1e-20, F.lit(0.0)).otherwise(1.0 / (d + F.lit(1e-20))).alias("value"))


def row_to_vec(m: DataFrame, row: int) -> DataFrame:
    return m.where(F.col("row_id") == row).select(F.posexplode(FEATURES).alias("idx", "x"))


def col_to_vec(m: DataFrame, col: int) -> DataFrame:
    return m.select("row_id", F.col(FEATURES)[col].alias("x"))


def diag_to_vec(m: DataFrame) -> DataFrame:
    return m.where(F.col("row_id") < F.size(FEATURES)).select("row_id", F.get(F.col(FEATURES), F.col("row_id").cast("int")).alias("x"))


def hstack(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of ``a`` then of ``b``, rows matched by id."""
    j = a.join(b.select("row_id", F.col(FEATURES).alias("other")), "row_id")
    return j.select("row_id", F.concat(FEATURES, "other").alias(FEATURES))


def vstack(a: DataFrame, b: DataFrame, n_a: int | None = None) -> DataFrame:
    """Rows of ``a`` then of ``b``; ids of ``b`` go on after the largest of ``a``.
    Widths must agree."""
    wa, wb = (x.select(F.max(F.size(FEATURES)), F.min(F.size(FEATURES)), F.max("row_id")).first() for x in (a, b))
    if None not in (wa[0], wb[0]) and {wa[0], wa[1]} != {wb[0], wb[1]}:
        raise ValueError("matrices of different widths")
    start = n_a if n_a is not None else (wa[2] if wa[2] is not None else -1) + 1
    return a.select("row_id", FEATURES).unionByName(b.select((F.col("row_id") + start).alias("row_id"), FEATURES))


def transpose(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def col_slice(m: DataFrame, start: int, stop: int) -> DataFrame:
    return _with(m, F.slice(FEATURES, start + 1, stop - start))


def row_slice(m: DataFrame, start: int, stop: int) -> DataFrame:
    return m.where((F.col("row_id") >= start) & (F.col("row_id") < stop))


def submatrix(m: DataFrame, row: int, col: int, n_rows: int, n_cols: int) -> DataFrame:
    return col_slice(row_slice(m, row, row + n_rows), col, col + n_cols)


def interaction_pairs(k: int, self_terms: bool = True) -> list[tuple[int, int]]:
    return [(a, b) for a in range(k) for b in range(a if self_terms else a + 1, k)]


def col_interactions(m: DataFrame, k: int, self_terms: bool = True) -> DataFrame:
    """Products x_a x_b of the k columns, a <= b (a < b without self terms)."""
    x = F.col(FEATURES)
    return _with(m, F.array(*(x[a] * x[b] for a, b in interaction_pairs(k, self_terms))))


def col_powers(m: DataFrame, degree: int) -> DataFrame:
    """[x, x^2, ..., x^degree], block by block."""
    def power(p: int) -> Column:
        return F.transform(FEATURES, lambda v: F.pow(v, F.lit(float(p))))

    return _with(m, F.concat(*map(power, range(1, degree + 1))))


def vandermonde(m: DataFrame, k: int, self_terms: bool = True) -> DataFrame:
    """[x, interactions, 1]."""
    x = F.col(FEATURES)
    inter = [x[a] * x[b] for a, b in interaction_pairs(k, self_terms)]
    return _with(m, F.concat(x, F.array(*inter, F.lit(1.0))))


def full_vandermonde(m: DataFrame, k: int, degree: int) -> DataFrame:
    """Degree below 2: [x, 1]; 2 and more: always quadratic."""
    if degree < 2:
        return _with(m, F.concat(F.col(FEATURES), F.array(F.lit(1.0))))
    return vandermonde(m, k)


# predicates


def in_box(x: Column, bounds) -> Column:
    """lb_j <= x_j <= ub_j for all j."""
    b = F.array(*(F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for lo, hi in bounds))
    return F.forall(F.zip_with(x, b, lambda v, s: (v >= s["lo"]) & (v <= s["hi"])), lambda ok: ok)


def box_filter(m: DataFrame, bounds) -> DataFrame:
    return m.where(in_box(F.col(FEATURES), bounds))


def ln_prior_uniform(x: Column, bounds) -> Column:
    """0 strictly inside the box, else -infinity."""
    b = F.array(*(F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for lo, hi in bounds))
    inside = F.forall(F.zip_with(x, b, lambda v, s: (v > s["lo"]) & (v < s["hi"])), lambda ok: ok)
    return F.when(inside, F.lit(0.0)).otherwise(F.lit(float("-inf")))


def max_abs_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, max_diff) of two coordinate matrices; an entry that one lacks counts
    as infinitely different."""
    j = a.alias("a").join(b.alias("b"), [F.col("a.i") == F.col("b.i"), F.col("a.j") == F.col("b.j")], "full")
    d = F.coalesce(F.abs(F.col("a.value") - F.col("b.value")), F.lit(float("inf")))
    return j.agg(F.count("*").alias("n"), F.max(d).alias("max_diff"))


def approx_eq(a: DataFrame, b: DataFrame, tol: float) -> bool:
    """Same shape and all entries within ``tol``; row matrices or coordinates."""
    a, b = (to_coo(x) if FEATURES in x.columns else x for x in (a, b))
    worst = max_abs_diff(a, b).first()["max_diff"]
    return worst is None or worst < tol


def scalar_approx_eq(coo: DataFrame, c: float, tol: float) -> bool:
    coo = to_coo(coo) if FEATURES in coo.columns else coo
    worst = coo.agg(F.max(F.abs(F.col("value") - F.lit(float(c))))).first()[0]
    return worst is None or worst < tol


# order


def argsort(v: DataFrame, descending: bool = False) -> DataFrame:
    """(rank from 0, row_id, x) of ``v(row_id, x)``, ties by row_id; NaN raises.

    Ranks come from a range partitioning: rows are numbered inside each range
    and shifted by the sizes of the ranges before, so no task holds them all."""
    from ..plans.ordering import global_rank

    x = F.when(F.isnan("x"), F.raise_error(F.lit("NaN can't be ordered")).cast("double")).otherwise(F.col("x"))
    checked = v.select("row_id", x.alias("x"))
    keys = [-F.col("x") if descending else F.col("x"), F.col("row_id")]
    return global_rank(checked, keys, "rank").select("rank", "row_id", "x")
