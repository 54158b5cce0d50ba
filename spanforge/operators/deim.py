"""Empirical interpolation: which points to sample, and what to do with the samples.

The greedy point of a mode is where the mode, less its interpolation on the points before, is largest. Interpolating and
subtracting needs the coefficients that match the mode at those points, a system of as many equations as points, which is
solved on the driver. One round takes the modes' next column, reduced by these coefficients, finds its largest entry as
one top-1 aggregate, and fetches that row. Rounds read the same base table; only the small coefficient matrix grows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators import linalg
from spanforge.plans.storage import written
from spanforge.plans.tensor import Extents, Tensor


def _pivots(rows: DataFrame, variables: int, modes: int) -> list[list[int]]:
    """``rows``: var, x, v. For each variable its points in the order in which they are chosen; the least of equals.

    One job a mode serves all variables. The coefficients so far come as a small literal table by variable.
    """
    chosen: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(variables)]
    for mode in range(modes):
        weights = []
        for own in chosen:
            at = np.array([v for _, v in own])
            weights.append(np.linalg.lstsq(at[:, :mode], at[:, mode], rcond=None)[0] if own else np.zeros(0))
        by_var = lambda values: F.array(*values)[F.col("var")]
        residual = F.get("v", F.lit(mode))
        for k in range(mode):
            residual = residual - by_var([F.lit(float(w[k])) for w in weights]) * F.get("v", F.lit(k))
        if mode:
            taken = by_var([F.array(*[F.lit(x).cast("long") for x, _ in own]) for own in chosen])
            residual = F.when(F.array_contains(taken, F.col("x")), F.lit(-1.0)).otherwise(F.abs(residual))
        else:
            residual = F.abs(residual)
        best = rows.groupBy("var").agg(F.max_by(F.struct("x", "v"), F.struct(residual, -F.col("x"))).alias("b")).collect()
        for row in best:  # one a variable
            chosen[row["var"]].append((row["b"]["x"], np.array(row["b"]["v"])))
    return [[x for x, _ in own] for own in chosen]


def deim_indices(basis: Tensor) -> DataFrame:
    """rank, x (rows of the matrix view): as many points as modes, in the order of selection."""
    n_var, n_x, modes = basis.extents
    if modes > n_var * n_x:
        raise ValueError("more modes than rows")
    rows = written(basis.row_ids().select(F.lit(0).alias("var"), F.col("row_id").alias("x"), "v"))
    return rows.sparkSession.createDataFrame(list(enumerate(_pivots(rows, 1, modes)[0])), "rank int, x long")


def multi_state_deim_indices(basis: Tensor) -> DataFrame:
    """rank, x: the different points of all variables' own selections, in increasing order."""
    if basis.extents.n_s > basis.extents.n_x:
        raise ValueError("more modes than points")
    rows = written(basis.rows.select("var", "x", "v"))
    found = sorted(set().union(*_pivots(rows, basis.extents.n_var, basis.extents.n_s)))
    return rows.sparkSession.createDataFrame(list(enumerate(found)), "rank int, x long")


def _sampled(rows: DataFrame, points: DataFrame) -> dict[int, np.ndarray]:
    """``rows``: var, x, v. For each variable its rows at the points, in rank order; as many as the sample mesh."""
    order = {r["x"]: r["rank"] for r in points.collect()}
    found: dict[int, dict[int, list[float]]] = {}
    for r in rows.join(F.broadcast(points.select("x")), "x", "left_semi").collect():
        found.setdefault(r["var"], {})[order[r["x"]]] = r["v"]
    return {var: np.array([own[k] for k in sorted(own)]) for var, own in found.items()}


def approximation_matrix(basis: Tensor, points: DataFrame) -> Tensor:
    """U pinv(U[points]): a row for each row of U, a column for each point."""
    at = _sampled(basis.row_ids().select(F.lit(0).alias("var"), F.col("row_id").alias("x"), "v"), points)[0]
    return linalg.times(basis, np.linalg.pinv(at))


def _cross(left: Tensor, right: Tensor) -> dict[int, np.ndarray]:
    """For each variable left^T right over the points; modes x modes numbers each."""
    k, n = left.extents.n_s, right.extents.n_s
    both = left.rows.select("var", "x", F.col("v").alias("l")).join(right.rows.select("var", "x", F.col("v").alias("r")), ["var", "x"])
    return linalg.products(both.select("var", "l", "r"), left.extents.n_var, k, n)


def multi_state_test_basis(space: Tensor, basis: Tensor, points: DataFrame) -> Tensor:
    """For each variable of ``basis`` [(Phi^T U) pinv(U[points])]^T: a row for each point (by rank), a column for each mode."""
    cross, at = _cross(space, basis), _sampled(basis.rows, points)
    spark = basis.rows.sparkSession
    rows: list[tuple[int, int, list[float]]] = []
    for var in range(basis.extents.n_var):
        rows += [(var, rank, line) for rank, line in enumerate((cross[var] @ np.linalg.pinv(at[var])).T.tolist())]
    frame = spark.createDataFrame(rows, "var int, x long, v array<double>")
    return Tensor(frame, Extents(basis.extents.n_var, len(rows) // basis.extents.n_var, space.extents.n_s))


def test_basis(space: Tensor, basis: Tensor, points: DataFrame) -> Tensor:
    """The same over the rows of the matrix view, as one variable."""
    flat = lambda t: Tensor(t.row_ids().select(F.lit(0).alias("var"), F.col("row_id").alias("x"), "v"), Extents(1, t.extents.n_var * t.extents.n_x, t.extents.n_s))
    return multi_state_test_basis(flat(space), flat(basis), points)


test_basis.__test__ = False
