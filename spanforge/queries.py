"""The engine's operators applied to the warehouse tables, and SQL that gives the same rows.

T: sums of lineitem by quantity (variable 0), extended price (1), discount (2) and tax (3), brand (point) and ship year
(sample). Closed forms need two samples, for which T's years are added up by parity; E: embeddings, one row a vector, one
sample a component, or few samples over which all components are added up in turn. P: germs from order keys.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanforge.operators import deim, ecsw, linalg, scale, shift, truncate
from spanforge.operators.orthogonalize import EuclideanL2, WeightedL2
from spanforge.operators.space import CompositeSpace, VectorSpace, dictionary_space, pod_space
from spanforge.plans.storage import shared_folder, written
from spanforge.plans.tensor import Extents, Tensor, from_long, from_rows
from spanforge.sources.dakota import read_parameters, template_cases
from spanforge.sources.sinks import nodal_fields, read_space, write_space
from spanforge.streaming.gram import stream_gram, streamed_gram
from spanforge.workflows import greedy, params
from spanforge.workflows.sampling import run_samples

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# Inputs.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T as one row a cell. Sums come before the brands' numbers, so only sums are ranked."""
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year"), *[F.col(m).cast("decimal(18,2)").alias(m) for m in measures])
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    sums = lines.join(parts, "l_partkey").groupBy("p_brand", "year").agg(*[F.sum(m).cast("double").alias(m) for m in measures])
    # One row a brand; the brands' numbers are found among these alone.
    brands = sums.select("p_brand").distinct().withColumn("x", (F.row_number().over(W.orderBy("p_brand")) - 1).cast("long"))
    ranked = sums.join(brands, "p_brand")
    each = F.posexplode(F.array(*measures)).alias("var", "val")
    return ranked.select("x", (F.col("year") - 1995).cast("long").alias("s"), each).select("var", "x", "s", "val")


def tensor_t(spark: SparkSession, sf_dir: str) -> Tensor:
    return from_long(cells(spark, sf_dir), Extents(4, 25, 7))


def scaled(t: Tensor) -> Tensor:
    return scale.VariableScaling("max_abs").fit(t).pre(t)


def scaled_t(spark: SparkSession, sf_dir: str) -> Tensor:
    return scaled(tensor_t(spark, sf_dir))


def scaled_pair(spark: SparkSession, sf_dir: str) -> Tensor:
    """Two samples: the sums of even and of odd years."""
    halves = cells(spark, sf_dir).groupBy("var", "x", F.pmod("s", F.lit(2)).alias("s")).agg(F.sum("val").alias("val"))
    return scaled(from_long(halves, Extents(4, 25, 2)))


def tensor_e(spark: SparkSession, sf_dir: str, samples: int = 64) -> Tensor:
    """All 64 components; with fewer samples, sample k is the sum of the components k, k + samples, ..."""
    e = table(spark, sf_dir, "embeddings")
    n, v = e.count(), F.col("embedding").cast("array<double>")
    if samples < 64:
        v = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.aggregate(F.filter(v, lambda x, i: F.pmod(i, F.lit(samples)) == k), F.lit(0.0), lambda a, x: a + x))
    return from_rows(e.select(F.lit(0).alias("var"), F.col("vec_id").alias("x"), v.alias("v")), Extents(1, n, samples))


def germ_p(spark: SparkSession, sf_dir: str, dimension: int = 3) -> DataFrame:
    k = F.col("o_orderkey")
    u = [(k % m).cast("double") / float(m) for m in (997, 101, 13)][:dimension]
    return table(spark, sf_dir, "orders").select(k.alias("sample_idx"), F.array(*u).alias("u"))


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + 0.0


def emitted(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as bigint, floats rounded."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("int", "bigint", "smallint", "tinyint"):
            out.append(F.col(name).cast("long").alias(name))
        else:
            out.append(rounded(F.col(name), digits).alias(name) if kind == "double" else F.col(name))
    return df.select(*out)


T_SQL = """
b AS (SELECT p_partkey, p_brand FROM part),
c AS (SELECT p_brand, year(l_shipdate) - 1995 AS s, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS m0,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS m1, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS m2,
        CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS m3
      FROM lineitem JOIN b ON l_partkey = p_partkey GROUP BY ALL),
d AS (SELECT dense_rank() OVER (ORDER BY p_brand) - 1 AS x, * FROM c),
t AS (SELECT 0::BIGINT AS var, x::BIGINT AS x, s::BIGINT AS s, m0 AS val FROM d UNION ALL SELECT 1, x, s, m1 FROM d
      UNION ALL SELECT 2, x, s, m2 FROM d UNION ALL SELECT 3, x, s, m3 FROM d),
z AS (SELECT var, x, s, val / max(abs(val)) OVER (PARTITION BY var) AS val FROM t),
t2 AS (SELECT var, x, s % 2 AS s, sum(val) AS val FROM t GROUP BY ALL),
z2 AS (SELECT var, x, s, val / max(abs(val)) OVER (PARTITION BY var) AS val FROM t2)"""
_CELL = "var, x, s, round({0}, 6) + 0.0 AS val"


# Tensor, shifts.


@query(f"WITH {T_SQL} SELECT {_CELL.format('val')} FROM t")
def tensor_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(tensor_t(spark, sf_dir).long())


@query(f"WITH {T_SQL} SELECT var * 25 + x AS row_id, s, round(val, 6) + 0.0 AS val FROM t")
def tensor_matrix_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(tensor_t(spark, sf_dir).row_ids().select("row_id", F.posexplode("v").alias("s", "val")))


@query(f"WITH {T_SQL} SELECT {_CELL.format('val')} FROM t")
def shift_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensor_t(spark, sf_dir)
    return emitted(shift.no_shift(t).apply(t).long())


@query(f"WITH {T_SQL} SELECT {_CELL.format('val - 2.0')} FROM t")
def shift_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensor_t(spark, sf_dir)
    return emitted(shift.constant_shift(2.0, t).apply(t).long())


@query(f"WITH {T_SQL} SELECT {_CELL.format('val - CASE var WHEN 0 THEN 10.0 WHEN 1 THEN 1000.0 WHEN 2 THEN 0.5 ELSE 0.25 END')} FROM t")
def shift_const_pervar(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensor_t(spark, sf_dir)
    return emitted(shift.constant_shift([10.0, 1000.0, 0.5, 0.25], t).apply(t).long())


@query(f"WITH {T_SQL} SELECT {_CELL.format('val - (x * 0.5 + var)::DOUBLE')} FROM t")
def shift_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensor_t(spark, sf_dir)
    vector = t.rows.select("var", "x", (F.col("x") * 0.5 + F.col("var")).alias("shift"))
    return emitted(shift.vector_shift(vector, t).apply(t).long())


@query(f"WITH {T_SQL} SELECT {_CELL.format('val - avg(val) OVER (PARTITION BY var, x)')} FROM t")
def shift_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensor_t(spark, sf_dir)
    return emitted(shift.average_shift(t).apply(t).long())


@query(f"WITH {T_SQL} SELECT var, x, round(avg(val), 6) + 0.0 AS shift FROM t GROUP BY var, x")
def shift_average_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensor_t(spark, sf_dir)
    return emitted(shift.average_shift(t).vector(t))


@query(f"WITH {T_SQL} SELECT {_CELL.format('val - first_value(val) OVER (PARTITION BY var, x ORDER BY s)')} FROM t")
def shift_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensor_t(spark, sf_dir)
    return emitted(shift.first_vector_shift(t).apply(t).long())


@query(f"WITH {T_SQL} SELECT {_CELL.format('val')} FROM t")
def shift_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensor_t(spark, sf_dir)
    average = shift.average_shift(t)
    return emitted(average.invert(average.apply(t)).long())


# Scalings.


def _scales(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return emitted(scale.variable_scales(tensor_t(spark, sf_dir), kind))


def _scale_sql(agg: str) -> str:
    return f"WITH {T_SQL} SELECT var, round(CASE WHEN {agg} < 1e-10 THEN 1.0 ELSE {agg} END, 6) + 0.0 AS scale FROM t GROUP BY var"


@query(_scale_sql("max(abs(val))"))
def scale_max_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scales(spark, sf_dir, "max_abs")


@query(_scale_sql("avg(abs(val))"))
def scale_mean_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scales(spark, sf_dir, "mean_abs")


@query(_scale_sql("stddev_pop(val)"))
def scale_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scales(spark, sf_dir, "variance")


@query(f"WITH {T_SQL} SELECT {_CELL.format('val')} FROM z")
def scale_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(scaled_t(spark, sf_dir).long())


def _weights(t: Tensor) -> DataFrame:
    return t.rows.select("x", (1.0 + F.col("x") / 10.0).alias("w")).distinct()


@query(f"WITH {T_SQL} SELECT {_CELL.format('val / (1.0 + x / 10.0)')} FROM t")
def scale_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensor_t(spark, sf_dir)
    return emitted(scale.VectorScaling(_weights(t)).pre(t).long())


def _both(spark: SparkSession, sf_dir: str) -> tuple[Tensor, scale.VariableAndVectorScaling]:
    t = tensor_t(spark, sf_dir)
    return t, scale.VariableAndVectorScaling(scale.VectorScaling(_weights(t)), scale.VariableScaling("mean_abs")).fit(t)


@query(f"WITH {T_SQL} SELECT {_CELL.format('val / avg(abs(val)) OVER (PARTITION BY var) / (1.0 + x / 10.0)')} FROM t")
def scale_var_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, both = _both(spark, sf_dir)
    return emitted(both.pre(t).long())


@query(f"WITH {T_SQL} SELECT {_CELL.format('val')} FROM t")
def scale_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, both = _both(spark, sf_dir)
    return emitted(both.post(both.pre(t)).long())


# Decompositions.


_PAIR_SQL = f"""WITH {T_SQL},
p AS (SELECT var, x, max(CASE WHEN s = 0 THEN val END) AS a, max(CASE WHEN s = 1 THEN val END) AS b FROM z2 GROUP BY var, x),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM p),
e AS (SELECT *, (aa + bb) / 2 + sqrt(((aa - bb) / 2) * ((aa - bb) / 2) + ab * ab) AS l0, (aa + bb) / 2 - sqrt(((aa - bb) / 2) * ((aa - bb) / 2) + ab * ab) AS l1 FROM g)"""
_BASIS2_SQL = (
    _PAIR_SQL
    + """,
w AS (SELECT 0 AS mode, ab / sqrt(ab * ab + (l0 - aa) * (l0 - aa)) AS v0, (l0 - aa) / sqrt(ab * ab + (l0 - aa) * (l0 - aa)) AS v1, sqrt(l0) AS sigma FROM e
      UNION ALL SELECT 1, ab / sqrt(ab * ab + (l1 - aa) * (l1 - aa)), (l1 - aa) / sqrt(ab * ab + (l1 - aa) * (l1 - aa)), sqrt(l1) FROM e),
u AS (SELECT var, x, mode, (a * v0 + b * v1) / sigma AS val FROM p, w),
f AS (SELECT mode, sign((array_agg(val ORDER BY round(abs(val), 9) DESC, var * 25 + x))[1]) AS sg FROM u GROUP BY mode)
SELECT var, x, mode::BIGINT AS mode, round(val * sg, 6) + 0.0 AS val FROM u JOIN f USING (mode)"""
)


@query(f"WITH {T_SQL} SELECT a.s AS i, b.s AS j, round(sum(a.val * b.val), 6) + 0.0 AS g FROM z a JOIN z b USING (var, x) GROUP BY a.s, b.s")
def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = linalg.gram(scaled_t(spark, sf_dir))
    return emitted(spark.createDataFrame([(i, j, float(g[i, j])) for i in range(7) for j in range(7)], "i long, j long, g double"))


@query(f"""WITH {T_SQL}, g AS (SELECT sum(a.val * b.val) AS g FROM z a JOIN z b USING (var, x) GROUP BY a.s, b.s)
SELECT round((SELECT sum(val * val) FROM z), 6) + 0.0 AS s2, round(sum(g * g), 4) + 0.0 AS s4 FROM g""")
def svd_energy_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s = linalg.decompose(scaled_t(spark, sf_dir), sign="raw")
    return spark.createDataFrame([(float((s**2).sum()), float((s**4).sum()))], "s2 double, s4 double").select(rounded("s2").alias("s2"), rounded("s4", 4).alias("s4"))


@query(_PAIR_SQL + " SELECT 0::BIGINT AS mode, round(sqrt(l0), 6) + 0.0 AS sigma FROM e UNION ALL SELECT 1, round(sqrt(l1), 6) + 0.0 FROM e")
def svd2_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s = linalg.decompose(scaled_pair(spark, sf_dir), sign="raw")
    return emitted(spark.createDataFrame([(k, float(x)) for k, x in enumerate(s)], "mode long, sigma double"))


@query(_BASIS2_SQL)
def pod2_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(pod_space(scaled_pair(spark, sf_dir)).basis.long("mode"))


@query(_BASIS2_SQL)
def pod2_basis_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(pod_space(scaled_pair(spark, sf_dir), svd="gram").basis.long("mode"))


@query()
def pod_of_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average shift, variable scaling, TSQR, four modes."""
    t = tensor_t(spark, sf_dir)
    space = pod_space(t, truncate.BasisSize(4), shift.average_shift(t), scaler=scale.VariableScaling("max_abs"))
    return emitted(space.basis.long("mode"))


@query(f"WITH {T_SQL} SELECT {_CELL.format('val')} FROM t")
def pod_reproduces_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift, scaling and all modes together: the snapshots' projection on their own space is the snapshots."""
    t = tensor_t(spark, sf_dir)
    average, scaling = shift.average_shift(t), scale.VariableScaling("max_abs").fit(t)
    space = pod_space(t, shift=average, scaler=scaling)
    modes, data = scaling.pre(space.basis), scaling.pre(average.apply(t))
    pairs = modes.rows.select("var", "x", F.col("v").alias("l")).join(data.rows.select("var", "x", F.col("v").alias("r")), ["var", "x"])
    coefficients = sum(linalg.products(pairs.select("var", "l", "r"), 4, modes.extents.n_s, 7).values())
    return emitted(average.invert(scaling.post(linalg.times(modes, coefficients))).long())


@query(_BASIS2_SQL)
def snapshots_as_qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method of snapshots in place of a QR: its modes, with the sign rule of a decomposition."""
    return emitted(linalg.signed(EuclideanL2("gram").orthogonalize(scaled_pair(spark, sf_dir))).long("mode"))


@query()
def pod_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tensor_e(spark, sf_dir)
    space = pod_space(e, truncate.Energy(0.9), shift.average_shift(e))
    return emitted(space.basis.long("mode"))


# Truncation, orthogonalisation.


@query(f"""WITH {T_SQL}, g AS (SELECT s AS mode, sum(val) / 1e3 AS sigma FROM t GROUP BY s),
e AS (SELECT mode, sum(sigma * sigma) OVER (ORDER BY mode) / sum(sigma * sigma) OVER () AS share FROM g)
SELECT (coalesce(min(CASE WHEN share > 0.65 THEN mode END), 0) + 1)::BIGINT AS k FROM e""")
def truncate_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = cells(spark, sf_dir).groupBy(F.col("s").alias("mode")).agg((F.sum("val") / 1e3).alias("sigma"))
    return emitted(truncate.energy_modes(sigma, 0.65))


@query(f"WITH {T_SQL} SELECT var, x, s AS mode, round(val, 6) + 0.0 AS val FROM t WHERE s < 3")
def truncate_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(truncate.BasisSize(3).truncate(tensor_t(spark, sf_dir)).long("mode"))


def _gram_schmidt(w: str) -> str:
    return f"""WITH {T_SQL},
p AS (SELECT var, x, {w} AS w, max(CASE WHEN s = 0 THEN val END) AS a, max(CASE WHEN s = 1 THEN val END) AS b FROM z2 GROUP BY var, x),
n AS (SELECT sum(w * a * a) AS aa, sum(w * a * b) AS ab FROM p),
q AS (SELECT var, x, w, a / sqrt(aa) AS q0, b - ab / aa * a AS r FROM p, n),
m AS (SELECT sqrt(sum(w * r * r)) AS rr FROM q)
SELECT var, x, 0::BIGINT AS mode, round(q0, 6) + 0.0 AS val FROM q UNION ALL SELECT var, x, 1, round(r / rr, 6) + 0.0 FROM q, m"""


@query(_gram_schmidt("1.0"))
def orth_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(EuclideanL2().orthogonalize(scaled_pair(spark, sf_dir)).long("mode"))


@query(_gram_schmidt("1.0 + var + x / 10.0"))
def orth_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scaled_pair(spark, sf_dir)
    weights = t.rows.select("var", "x", (1.0 + F.col("var") + F.col("x") / 10.0).alias("w"))
    return emitted(WeightedL2(weights).orthogonalize(t).long("mode"))


# Spaces.


@query(f"""WITH {T_SQL}, p AS (SELECT var, x, s, val - first_value(val) OVER (PARTITION BY var, x ORDER BY s) AS val FROM z)
SELECT var, x, s AS mode, round(val, 6) + 0.0 AS val FROM p""")
def dictionary_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scaled_t(spark, sf_dir)
    return emitted(dictionary_space(t, shift.first_vector_shift(t)).basis.long("mode"))


def _composite(spark: SparkSession, sf_dir: str) -> CompositeSpace:
    """Two variables with a mode a year, and two with one for even and one for odd years."""

    def part(t: Tensor, low: int) -> VectorSpace:
        rows = t.rows.where(F.col("var").between(low, low + 1)).select((F.col("var") - low).alias("var"), "x", "v")
        own = from_rows(rows, Extents(2, 25, t.extents.n_s))
        return dictionary_space(own, shift.average_shift(own))

    return CompositeSpace([part(scaled_t(spark, sf_dir), 0), part(scaled_pair(spark, sf_dir), 2)])


_COMPACT_SQL = f"""WITH {T_SQL},
k AS (SELECT * FROM z WHERE var < 2 UNION ALL SELECT * FROM z2 WHERE var >= 2),
m AS (SELECT var, x, s, val, avg(val) OVER (PARTITION BY var, x) AS shift FROM k),
q AS (SELECT var, x, s + CASE WHEN var < 2 THEN 0 ELSE 7 END AS mode, val - shift AS val, shift FROM m)"""


@query(_COMPACT_SQL + """ SELECT r.var, r.x, j.mode, round(coalesce(q.val, 0.0), 6) + 0.0 AS val
FROM (SELECT DISTINCT var, x FROM q) r CROSS JOIN (SELECT DISTINCT mode FROM q) j LEFT JOIN q ON q.var = r.var AND q.x = r.x AND q.mode = j.mode""")
def composite_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(_composite(spark, sf_dir).basis().long("mode"))


@query(_COMPACT_SQL + " SELECT var, x, mode, round(val, 6) + 0.0 AS val FROM q")
def composite_compact_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(_composite(spark, sf_dir).compact_basis())


@query(_COMPACT_SQL + " SELECT DISTINCT var, x, round(shift, 6) + 0.0 AS shift FROM q")
def composite_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(_composite(spark, sf_dir).shift())


@query(f"""WITH {T_SQL}, m AS (SELECT var, x, s, val, avg(val) OVER (PARTITION BY var, x) AS shift FROM z)
SELECT x, {', '.join(f"round(max(CASE WHEN var = {v} THEN shift END), 6) + 0.0 AS u0_{n}, " + ', '.join(f"round(max(CASE WHEN var = {v} AND s = {k} THEN val - shift END), 6) + 0.0 AS phi_{n}_{k + 1}" for k in range(7)) for v, n in enumerate(('quantity', 'price', 'discount', 'tax')))}
FROM m GROUP BY x""")
def nodal_field_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scaled_t(spark, sf_dir)
    return emitted(nodal_fields(dictionary_space(t, shift.average_shift(t)), ["quantity", "price", "discount", "tax"]))


@query(f"WITH {T_SQL} SELECT {_CELL.format('val - avg(val) OVER (PARTITION BY var, x)').replace(' s, ', ' s AS mode, ')} FROM z")
def space_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scaled_t(spark, sf_dir)
    space = dictionary_space(t, shift.average_shift(t))
    path = f"{shared_folder(spark)}/space-{np.random.default_rng().integers(1 << 62):x}"
    write_space(space, path)
    return emitted(read_space(spark, path, space.extents).basis.long("mode"))


# Empirical interpolation.


def _elimination(rows: str, group: str, modes: int) -> str:
    """CTEs that eliminate mode by mode with the largest pivot; p0, p1, ...: pivot rows."""
    sql, at = "", rows
    over = f"PARTITION BY {group} " if group else ""
    on = f"USING ({group})" if group else "ON true"
    pick = f"{group}, " if group else ""
    for m in range(modes):
        sql += f""", p{m} AS (SELECT {pick}x AS px, {', '.join(f'c{j} AS d{j}' for j in range(modes))} FROM {at} QUALIFY row_number() OVER ({over}ORDER BY abs(c{m}) DESC, x) = 1)"""
        if m + 1 < modes:
            cols = ", ".join(f"c{j} - c{m} / d{m} * d{j} AS c{j}" if j > m else f"c{j}" for j in range(modes))
            sql += f""", e{m + 1} AS (SELECT {pick}x, {cols} FROM {at} JOIN p{m} {on} WHERE x <> px)"""
            at = f"e{m + 1}"
    return sql


_E_SQL = (
    "WITH e0 AS (SELECT vec_id AS x, "
    + ", ".join(f"list_sum(list_transform(range({k}, len(embedding) + 1, 3), lambda i: embedding[i]::DOUBLE)) AS c{k - 1}" for k in (1, 2, 3))
    + " FROM embeddings)"
)
_E2_SQL = _E_SQL.replace(", 3), lambda", ", 2), lambda")


@query(_E_SQL + _elimination("e0", "", 3) + " SELECT 0::BIGINT AS rank, px AS x FROM p0 UNION ALL SELECT 1, px FROM p1 UNION ALL SELECT 2, px FROM p2")
def deim_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(deim.deim_indices(tensor_e(spark, sf_dir, 3)))


_Z2_SQL = f"WITH {T_SQL}, e0 AS (SELECT var, x, max(CASE WHEN s = 0 THEN val END) AS c0, max(CASE WHEN s = 1 THEN val END) AS c1 FROM z2 GROUP BY var, x)"


@query(_Z2_SQL + _elimination("e0", "var", 2) + ", k AS (SELECT DISTINCT px AS x FROM (SELECT px FROM p0 UNION ALL SELECT px FROM p1)) SELECT row_number() OVER (ORDER BY x) - 1 AS rank, x FROM k")
def deim_multi_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(deim.multi_state_deim_indices(scaled_pair(spark, sf_dir)))


#: Two points, which make the pseudo-inverse an inverse; v0 and v1 are their rows.
_TWO_SQL = """, v0 AS (SELECT * FROM {0} WHERE x = 3), v1 AS (SELECT * FROM {0} WHERE x = 11),
i AS (SELECT {1} v1.c1 / det AS i00, -v0.c1 / det AS i01, -v1.c0 / det AS i10, v0.c0 / det AS i11
      FROM (SELECT {2} v0.c0 * v1.c1 - v0.c1 * v1.c0 AS det, v0, v1 FROM v0 JOIN v1 {3}))"""
_POINTS = [(0, 3), (1, 11)]


def _points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_POINTS, "rank int, x long")


@query(_E2_SQL + _TWO_SQL.format("e0", "", "", "ON true") + """ SELECT x, 0::BIGINT AS point, round(c0 * i00 + c1 * i10, 6) + 0.0 AS val FROM e0, i
UNION ALL SELECT x, 1, round(c0 * i01 + c1 * i11, 6) + 0.0 FROM e0, i""")
def deim_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(deim.approximation_matrix(tensor_e(spark, sf_dir, 2), _points(spark)).long("point").drop("var"))


@query(_E_SQL + _TWO_SQL.format("e0", "", "", "ON true") + """, m AS (SELECT sum(c0 * c0) AS m00, sum(c0 * c1) AS m01, sum(c1 * c0) AS m10, sum(c1 * c1) AS m11, sum(c2 * c0) AS m20, sum(c2 * c1) AS m21 FROM e0),
r AS (SELECT 0 AS x, 0 AS mode, m00 * i00 + m01 * i10 AS val FROM m, i UNION ALL SELECT 0, 1, m10 * i00 + m11 * i10 FROM m, i UNION ALL SELECT 0, 2, m20 * i00 + m21 * i10 FROM m, i
UNION ALL SELECT 1, 0, m00 * i01 + m01 * i11 FROM m, i UNION ALL SELECT 1, 1, m10 * i01 + m11 * i11 FROM m, i UNION ALL SELECT 1, 2, m20 * i01 + m21 * i11 FROM m, i)
SELECT x::BIGINT AS x, mode::BIGINT AS mode, round(val, 4) + 0.0 AS val FROM r""")
def deim_test_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tensor_e(spark, sf_dir, 3)
    return emitted(deim.test_basis(e, e.with_values(F.slice("v", 1, 2), 2), _points(spark)).long("mode").drop("var"), 4)


@query(_Z2_SQL + _TWO_SQL.format("e0", "var,", "var,", "USING (var)") + """, m AS (SELECT var, sum(c0 * c0) AS m00, sum(c0 * c1) AS m01, sum(c1 * c1) AS m11 FROM e0 GROUP BY var),
r AS (SELECT var, 0 AS x, 0 AS mode, m00 * i00 + m01 * i10 AS val FROM m JOIN i USING (var) UNION ALL SELECT var, 0, 1, m01 * i00 + m11 * i10 FROM m JOIN i USING (var)
UNION ALL SELECT var, 1, 0, m00 * i01 + m01 * i11 FROM m JOIN i USING (var) UNION ALL SELECT var, 1, 1, m01 * i01 + m11 * i11 FROM m JOIN i USING (var))
SELECT var, x::BIGINT AS x, mode::BIGINT AS mode, round(val, 4) + 0.0 AS val FROM r""")
def deim_multi_test_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = scaled_pair(spark, sf_dir)
    return emitted(deim.multi_state_test_basis(z, z, _points(spark)).long("mode"), 4)


# Sparse quadrature.

_SYSTEM_SQL = f"WITH {T_SQL}, y AS (SELECT r.x, r.s * 2 + p.s AS row, sum(p.val * r.val) AS e FROM z r JOIN z2 p ON r.var = p.var AND r.x = p.x GROUP BY r.x, r.s, p.s)"


@query(_SYSTEM_SQL + " SELECT x, row, round(e, 6) + 0.0 AS e FROM y")
def ecsw_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = ecsw.linear_system(scaled_t(spark, sf_dir), scaled_pair(spark, sf_dir))
    return emitted(system.select("x", F.posexplode("col").alias("row", "e")))


@query(_SYSTEM_SQL + " SELECT row, round(sum(e), 6) + 0.0 AS val FROM y GROUP BY row")
def ecsw_rhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(ecsw.right_hand_side(ecsw.linear_system(scaled_t(spark, sf_dir), scaled_pair(spark, sf_dir))))


@query()
def ecsw_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer equations than points: two modes, seven snapshots."""
    return emitted(ecsw.sample_mesh(scaled_t(spark, sf_dir), scaled_pair(spark, sf_dir), 1e-4))


# Parameter spaces.

_P_SQL = "WITH p AS (SELECT o_orderkey AS sample_idx, (o_orderkey % 997) / 997.0::DOUBLE AS u0, (o_orderkey % 101) / 101.0::DOUBLE AS u1, (o_orderkey % 13) / 13.0::DOUBLE AS u2 FROM orders)"


@query(_P_SQL + " SELECT sample_idx, round(-1.0 + 2.0 * u0, 6) + 0.0 AS a, round(0.0 + 3.0 * u1, 6) + 0.0 AS b FROM p")
def param_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(params.uniform_space(["a", "b"], [-1.0, 0.0], [1.0, 3.0]).samples(germ_p(spark, sf_dir, 2)))


@query(_P_SQL + " SELECT sample_idx, round(-1.0 + 2.0 * u0, 6) + 0.0 AS a_0, round(3.0 * u1, 6) + 0.0 AS a_1, 'p3val' AS c FROM p")
def param_hetero(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = params.ParameterSpace([params.UniformParameter("a", [-1.0, 0.0], [1.0, 3.0]), params.StringParameter("c", "p3val")])
    return emitted(space.samples(germ_p(spark, sf_dir)))


@query(_P_SQL + " SELECT sample_idx, '1' AS p1, '3' AS p2, 'p3val' AS p3 FROM p")
def param_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(params.constant_space(["p1", "p2", "p3"], [1, 3, "p3val"]).samples(germ_p(spark, sf_dir)))


@query(_P_SQL + " SELECT sample_idx FROM p")
def param_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(params.empty_space().samples(germ_p(spark, sf_dir, 3).select("sample_idx", F.expr("cast(array() as array<double>)").alias("u"))))


#: The published draws of seed 12.
_MC_SQL = "SELECT * FROM (VALUES (0::BIGINT, -0.691674, 2.220149), (1, -0.473370, 1.601218), (2, -0.970850, 2.756241), (3, 0.801430, 0.100264)) v(sample_idx, a, b)"
_LHS_SQL = "SELECT * FROM (VALUES (0::BIGINT, -0.125412, 0.789935), (1, 0.405340, 2.865531), (2, 0.825055, 2.077094), (3, -0.835223, 0.663690)) v(sample_idx, a, b)"
_AS_DOUBLES = "SELECT sample_idx, a::DOUBLE AS a, b::DOUBLE AS b FROM ({})"


@query(_AS_DOUBLES.format(_MC_SQL))
def sample_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(params.monte_carlo_sample(spark, params.uniform_space(["a", "b"], [-1.0, 0.0], [1.0, 3.0]), 4, 12))


@query(_AS_DOUBLES.format(_LHS_SQL))
def sample_lhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(params.latin_hypercube_sample(spark, params.uniform_space(["a", "b"], [-1.0, 0.0], [1.0, 3.0]), 4, 12))


@query("SELECT range AS stratum, 1::BIGINT AS n_a, 1::BIGINT AS n_b FROM range((SELECT count(*) FROM customer))")
def sample_lhs_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed sampler draws once in every stratum of either dimension."""
    n = table(spark, sf_dir, "customer").count()
    drawn = written(params.distributed_latin_hypercube(spark, params.uniform_space(["a", "b"], [0.0, 0.0], [1.0, 1.0]), n))
    by = lambda c: drawn.groupBy(F.floor(F.col(c) * n).cast("long").alias("stratum")).agg(F.count(F.lit(1)).alias(f"n_{c}"))
    return by("a").join(by("b"), "stratum")


@query("SELECT r_regionkey AS position, round(r_regionkey + 0.5, 6)::DOUBLE + 0.0 AS value, 'v_' || replace(lower(r_name), ' ', '_') AS name FROM region")
def dakota_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter file with one variable a region, written and read."""
    regions = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    lines = [f"  {len(regions)} variables", *(f" {r['r_regionkey']}.5e0 v_{r['r_name'].lower().replace(' ', '_')}" for r in regions), " 1 functions"]
    path = f"{shared_folder(spark)}/params-{np.random.default_rng().integers(1 << 62):x}"
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return emitted(read_parameters(spark, path))


@query("SELECT n_nationkey AS sample_idx, 'u = ' || (n_nationkey / 100.0::DOUBLE)::VARCHAR || '; name = ' || n_name || ';' AS text FROM nation")
def template_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sample_idx"), (F.col("n_nationkey") / 100.0).alias("u"), F.col("n_name").alias("name"))
    return emitted(template_cases("u = {u}; name = {name};", samples))


# Outer loops.


class _Sum:
    """A model whose quantity of interest is known: a + 2 b."""

    def populate_run_directory(self, run_dir: str, parameters: dict[str, Any]) -> None:
        pass

    def run_model(self, run_dir: str, parameters: dict[str, Any]) -> int:
        return 0

    def compute_qoi(self, run_dir: str, parameters: dict[str, Any]) -> list[float]:
        return [parameters["a"] + 2 * parameters["b"]]


@query(_P_SQL + " SELECT sample_idx, 0::BIGINT AS flag, round(-1.0 + 2.0 * u0 + 2 * (3.0 * u1), 6) + 0.0 AS qoi FROM p")
def sampling_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole study, a run for every order's sample."""
    samples = params.uniform_space(["a", "b"], [-1.0, 0.0], [1.0, 3.0]).samples(germ_p(spark, sf_dir, 2))
    runs = run_samples(_Sum(), samples)
    return emitted(runs.select("sample_idx", "flag", F.col("qoi")[0].alias("qoi")))


@query(f"""WITH {T_SQL}, e AS (SELECT var, x, max(CASE WHEN s = 0 THEN val END) AS f, max(CASE WHEN s = 1 THEN val END) AS r FROM z2 GROUP BY var, x)
SELECT round(sqrt(sum((f - r) * (f - r))) / sqrt(sum(f * f)), 6) + 0.0 AS error FROM e""")
def qoi_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scaled_pair(spark, sf_dir).long()
    of = lambda s: c.where(F.col("s") == s).select("var", "x", F.col("val").alias("q"))
    return emitted(greedy.qoi_error(of(0), of(1), ["var", "x"]))


_HISTORY_SQL = f"WITH {T_SQL}, h AS (SELECT s AS iteration, sum(CASE WHEN var = 0 THEN val END) AS indicator, sum(CASE WHEN var = 2 THEN val END) AS qoi_error FROM t GROUP BY s)"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    of = lambda var: F.sum(F.when(F.col("var") == var, F.col("val")))
    return c.groupBy(F.col("s").alias("iteration")).agg(of(0).alias("indicator"), of(2).alias("qoi_error"))


@query(_HISTORY_SQL + " SELECT iteration, round(avg(qoi_error) OVER w / avg(indicator) OVER w, 6) + 0.0 AS c FROM h WINDOW w AS (ORDER BY iteration)")
def greedy_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emitted(greedy.running_ratio(_history(spark, sf_dir)))


@query(_HISTORY_SQL + " SELECT iteration AS sample, round(indicator, 6) + 0.0 AS indicator FROM h ORDER BY h.indicator DESC, iteration LIMIT 1")
def greedy_largest_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    return emitted(greedy.largest_indicator(h.select(F.col("iteration").alias("position"), F.col("iteration").alias("sample"), "indicator")))


@dataclasses.dataclass
class _Scripted:
    """A coupler with given answers, call by call."""

    indicators: list[float]
    errors: list[float]

    def parameter_space(self) -> params.ParameterSpace:
        return params.uniform_space(["u"], [0.0], [1.0])

    def run_fom(self, samples: DataFrame) -> None:
        pass

    def create_trial_space(self, training: list[int]) -> None:
        pass

    def error_indicators(self, samples: DataFrame, ids: list[int]) -> list[float]:
        return [self.indicators.pop(0) for _ in ids]

    def qoi_error(self, sample: DataFrame, idx: int) -> float:
        return self.errors.pop(0)


#: The trace that the script leads to.
_TRACE_SQL = """SELECT iteration::BIGINT AS iteration, sample::BIGINT AS sample, indicator::DOUBLE AS indicator, qoi_error::DOUBLE AS qoi_error, predicted::DOUBLE AS predicted
FROM (VALUES (1, 4, 4.0, 0.4, NULL), (2, 2, 0.9, 0.09, 0.09), (3, 5, 0.1, 0.01, 0.01), (4, 7, 0.00001, NULL, 0.000001)) v(iteration, sample, indicator, qoi_error, predicted)"""


@query(_TRACE_SQL)
def greedy_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripted = _Scripted([1.0, 2.0, 3.0, 1.5, 4.0, 0.9, 0.4, 0.6, 0.09, 0.1, 0.06, 1e-7, 1e-6, 1e-5], [1.0, 1.0, 0.4, 0.09, 0.01, 1e-6])
    return emitted(greedy.run_greedy(spark, scripted, 1e-5, 5).trace)


# Streams.


def _streamed(spark: SparkSession, sf_dir: str, v: Column) -> DataFrame:
    schema = table(spark, sf_dir, "embeddings").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parquet*")  # a file or a folder of files
    top = f"{shared_folder(spark)}/stream-{np.random.default_rng().integers(1 << 62):x}"
    stream_gram(source.select(v.alias("v")), f"{top}/sums", f"{top}/state").awaitTermination()
    return emitted(streamed_gram(spark.read.parquet(f"{top}/sums")), 4)


@query("""WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, round(sum(a.v * b.v), 4) + 0.0 AS g FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i""")
def stream_gram_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, F.col("embedding").cast("array<double>"))
