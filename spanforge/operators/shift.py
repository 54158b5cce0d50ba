"""Affine shifts. A fitted shift is an expression or a table; applying it is a narrow map or one join on the row key."""

from __future__ import annotations

import dataclasses
import numbers
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.plans.tensor import Tensor


@dataclasses.dataclass(frozen=True)
class Shift:
    """``of_row``: the shift as an expression over var, x, v; or ``table``: var, x, shift."""

    of_row: Column | None = None
    table: DataFrame | None = None
    fitted_on: Tensor | None = None

    def _with_shift(self, rows: DataFrame) -> DataFrame:
        if self.table is None:
            return rows.withColumn("shift", self.of_row)
        joined = rows.join(self.table.select("var", "x", "shift"), ["var", "x"], "left")
        gap = F.raise_error(F.lit("the shift vector lacks a row of the tensor"))
        return joined.withColumn("shift", F.when(F.col("shift").isNull(), gap.cast("double")).otherwise(F.col("shift")))

    def _moved(self, tensor: Tensor, sign: int) -> Tensor:
        if self.table is None and self.fitted_on is None and self.of_row is None:
            return tensor
        rows = self._with_shift(tensor.rows)
        moved = F.transform("v", lambda e: e - F.col("shift") if sign < 0 else e + F.col("shift"))
        return Tensor(rows.select("var", "x", moved.alias("v")), tensor.extents)

    def apply(self, tensor: Tensor) -> Tensor:
        return self._moved(tensor, -1)

    def invert(self, tensor: Tensor) -> Tensor:
        return self._moved(tensor, 1)

    def vector(self, tensor: Tensor | None = None) -> DataFrame:
        """var, x, shift."""
        rows = (self.fitted_on or tensor).rows
        if self.of_row is None and self.table is None:
            return rows.select("var", "x", F.lit(0.0).alias("shift"))
        return self._with_shift(rows).select("var", "x", "shift")


def no_shift(tensor: Tensor) -> Shift:
    return Shift(fitted_on=tensor, of_row=F.lit(0.0))


def constant_shift(value: float | Sequence[float], tensor: Tensor) -> Shift:
    """One constant, or one for each variable."""
    if isinstance(value, numbers.Number):
        return Shift(of_row=F.lit(float(value)), fitted_on=tensor)
    values = [float(v) for v in value] if not isinstance(value, str) else None
    if values is None:
        raise TypeError("a constant shift is a number or one number for each variable")
    if len(values) != tensor.extents.n_var:
        raise ValueError(f"{len(values)} constants for {tensor.extents.n_var} variables")
    return Shift(of_row=F.array(*map(F.lit, values))[F.col("var")], fitted_on=tensor)


def vector_shift(table: DataFrame, tensor: Tensor) -> Shift:
    return Shift(table=table, fitted_on=tensor)


def _frozen(of_row: Column, tensor: Tensor) -> Shift:
    """A shift measured on ``tensor``: applied to it, it is narrow; to its shifted copy, it is looked up by key."""
    return _Measured(of_row=of_row, fitted_on=tensor)


class _Measured(Shift):
    def apply(self, tensor: Tensor) -> Tensor:
        return super().apply(tensor) if tensor is self.fitted_on else Shift(table=self.vector()).apply(tensor)

    def invert(self, tensor: Tensor) -> Tensor:
        return Shift(table=self.vector()).invert(tensor)


def average_shift(tensor: Tensor) -> Shift:
    return _frozen(F.aggregate("v", F.lit(0.0), lambda a, e: a + e) / F.size("v"), tensor)


def first_vector_shift(tensor: Tensor) -> Shift:
    return _frozen(F.get("v", F.lit(0)), tensor)
