"""Sparse quadrature: few points with positive weights that reproduce projected residuals.

The linear system has a column for each point, kept as one row ``x, col`` of a table; entry ``snap * n_mode + mode`` of a
column is the point's share in that equation. The solver's state is small (the residual, the chosen columns) and stays
on the driver; each outer step is one distributed job, a dot product a row and a top-1.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.plans.storage import written
from spanforge.plans.tensor import Tensor


def linear_system(residuals: Tensor, basis: Tensor) -> DataFrame:
    """x, col with col[snap * n_mode + mode] = sum over var of basis[var, x, mode] * residuals[var, x, snap]."""
    if (residuals.extents.n_var, residuals.extents.n_x) != (basis.extents.n_var, basis.extents.n_x):
        raise ValueError("residuals and basis differ in variables or points")
    both = residuals.rows.select("var", "x", F.col("v").alias("r")).join(basis.rows.select("var", "x", F.col("v").alias("p")), ["var", "x"])
    n_var, k, n = residuals.extents.n_var, residuals.extents.n_s, basis.extents.n_s
    by_x = both.groupBy("x").agg(F.flatten(F.collect_list("r")).alias("r"), F.flatten(F.collect_list("p")).alias("p"))  # a row a variable

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, p = (batch.column(c).flatten().to_numpy().reshape(-1, n_var, size) for c, size in ((1, k), (2, n)))
            col = np.einsum("xvs,xvm->xsm", r, p).reshape(-1, k * n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, col.size + 1, k * n, dtype=np.int32)), pa.array(col.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["x", "col"])

    return by_x.select("x", "r", "p").mapInArrow(columns, "x long, col array<double>")


def right_hand_side(system: DataFrame) -> DataFrame:
    """row, val: each equation's sum over all points."""


    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                here = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["row", "val"])

    return system.select("col").mapInArrow(partial, "row int, val double").groupBy("row").agg(F.sum("val").alias("val"))


@dataclasses.dataclass(frozen=True)
class NonNegativeLeastSquares:
    """Active-set least squares with positive weights, stopped by the relative residual.

    Points enter by the largest signed correlation with the residual (the least point of equals); a fit with a weight
    that is not positive is approached only as far as all stay non-negative, and points that reach zero leave.
    """

    max_iters: int = 10000
    max_non_neg_iters: int = 100
    max_iters_res_unchanged: int = 10
    zero_tol: float = 1e-12

    def __call__(self, system: DataFrame, rhs: np.ndarray, tolerance: float) -> tuple[list[int], np.ndarray]:
        """Points in order of selection and their weights; both empty if the target is met from the start."""
        system = written(system.select("x", "col"))
        columns: dict[int, np.ndarray] = {}  # of every point ever chosen
        chosen: list[int] = []
        weight: dict[int, float] = {}
        rhs = np.asarray(rhs, dtype=float)
        residual, norm = rhs.copy(), float(np.linalg.norm(rhs))
        target, still, iters = tolerance * norm, 0, 0
        while norm > target and still < self.max_iters_res_unchanged and iters < self.max_iters:
            entering = self._next(system, residual, chosen)
            if entering is not None:
                chosen.append(entering[0])
                columns[entering[0]] = entering[1]
            iters += 1
            done = False
            for _ in range(self.max_non_neg_iters):
                matrix = np.array([columns[x] for x in chosen]).T.reshape(len(rhs), len(chosen))
                fit = np.linalg.pinv(matrix) @ rhs
                if (fit > 0).all():
                    weight, done = dict(zip(chosen, fit)), True
                    break
                now = np.array([weight.get(x, 0.0) for x in chosen])
                moved = now + feasible_step(now, fit) * (fit - now)
                weight = {x: w for x, w in zip(chosen, moved) if w >= self.zero_tol}
                chosen = [x for x in chosen if x in weight]
                iters += 1
            if not done:
                raise RuntimeError("no positive weights found within max_non_neg_iters steps")
            before = norm
            residual = rhs - matrix @ np.array([weight[x] for x in chosen])
            norm = float(np.linalg.norm(residual))
            still = still + 1 if abs(norm - before) < self.zero_tol else 0
        return chosen, np.array([weight[x] for x in chosen])

    def _next(self, system: DataFrame, residual: np.ndarray, chosen: list[int]) -> tuple[int, np.ndarray] | None:
        """The unchosen point of largest correlation, and its column."""
        taken = np.array(chosen, dtype=np.int64)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One candidate a batch; the residual and the chosen points come in the closure."""
            for batch in batches:
                x = batch.column(0).to_numpy()
                free = np.flatnonzero(~np.isin(x, taken))
                if len(free):
                    dots = (batch.column(1).flatten().to_numpy().reshape(len(x), -1)[free] * residual).sum(axis=1)
                    at = int(free[np.lexsort((x[free], -dots))[0]])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), pa.array([dots.max()])], ["x", "col", "dot"])

        found = system.select("x", "col").mapInArrow(best, "x long, col array<double>, dot double")
        top = found.agg(F.max_by(F.struct("x", "col"), F.struct("dot", -F.col("x"))).alias("b")).first()["b"]
        return None if top is None else (top["x"], np.array(top["col"]))


def feasible_step(now: np.ndarray, fit: np.ndarray) -> float:
    """The part of the way from ``now`` to ``fit``, 1 at most, on which no weight falls below zero."""
    falling = fit <= 0
    if (now[falling] == 0).any():
        return 0.0
    return float(min(1.0, (now[falling] / (now[falling] - fit[falling])).min(initial=1.0)))


def solve(system: DataFrame, rhs: np.ndarray, tolerance: float, solver: Callable | None = None) -> DataFrame:
    """rank, x, weight of the sample mesh for a system that is given (a test basis that varies)."""
    points, weights = (solver or NonNegativeLeastSquares())(system, rhs, tolerance)
    rows = [(rank, int(x), float(w)) for rank, (x, w) in enumerate(zip(points, weights))]
    return system.sparkSession.createDataFrame(rows, "rank int, x long, weight double")


def sample_mesh(residuals: Tensor, basis: Tensor, tolerance: float, solver: Callable | None = None) -> DataFrame:
    """rank, x, weight of the sample mesh for a fixed test basis."""
    system = written(linear_system(residuals, basis))
    rhs = np.zeros(residuals.extents.n_s * basis.extents.n_s)
    for row in right_hand_side(system).collect():
        rhs[row["row"]] = row["val"]
    return solve(system, rhs, tolerance, solver)
