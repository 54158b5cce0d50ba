"""Scaling before and after a decomposition. ``fit`` measures once and returns an immutable model."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.plans.tensor import Tensor

KINDS = ("max_abs", "mean_abs", "variance")
#: Below this, a variable counts as zero and is not scaled.
ZERO = 1e-10


def variable_scales(tensor: Tensor, kind: str) -> DataFrame:
    """var, scale. ``variance`` is the population standard deviation, as its users expect of it.

    Each row is reduced in place first (a narrow map), then rows by variable with map-side sums. The deviation takes the
    means first (one number a variable), so that it does not cancel.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of scaling {kind!r}; one of {', '.join(KINDS)}")
    added = lambda f: F.sum(F.aggregate("v", F.lit(0.0), lambda a, e: a + f(e))) / F.sum(F.size("v"))
    values = tensor.rows
    if kind == "max_abs":
        scale = F.max(F.array_max(F.transform("v", F.abs)))
    elif kind == "mean_abs":
        scale = added(F.abs)
    else:
        means = values.groupBy("var").agg(added(lambda e: e).alias("mean")).collect()
        by_var = F.create_map(*[F.lit(x) for r in means for x in (r["var"], r["mean"])])[F.col("var")] if means else F.lit(0.0)
        values = values.withColumn("mean", by_var)
        scale = F.sqrt(added(lambda e: (e - F.col("mean")) * (e - F.col("mean"))))
    return values.groupBy("var").agg(scale.alias("scale")).withColumn("scale", F.when(F.col("scale") < ZERO, 1.0).otherwise(F.col("scale")))


class NoScaling:
    def fit(self, tensor: Tensor) -> NoScaling:
        return self

    def pre(self, tensor: Tensor) -> Tensor:
        return tensor

    post = pre


@dataclasses.dataclass(frozen=True)
class VectorScaling:
    """A weight for each point, the same for all variables. ``table``: x, w."""

    table: DataFrame

    def fit(self, tensor: Tensor) -> VectorScaling:
        return self

    def _scaled(self, tensor: Tensor, before: bool) -> Tensor:
        gap = F.raise_error(F.lit("the scaling vector lacks a point of the tensor")).cast("double")
        rows = tensor.rows.join(self.table.select("x", "w"), "x", "left").withColumn("w", F.when(F.col("w").isNull(), gap).otherwise(F.col("w")))
        return Tensor(rows.select("var", "x", F.transform("v", lambda e: (1.0 / F.col("w")) * e if before else F.col("w") * e).alias("v")), tensor.extents)

    def pre(self, tensor: Tensor) -> Tensor:
        return self._scaled(tensor, True)

    def post(self, tensor: Tensor) -> Tensor:
        return self._scaled(tensor, False)


@dataclasses.dataclass(frozen=True)
class VariableScaling:
    """A scale for each variable, measured on the data."""

    kind: str
    scales: tuple[tuple[int, float], ...] | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of scaling {self.kind!r}; one of {', '.join(KINDS)}")

    def fit(self, tensor: Tensor) -> VariableScaling:
        """Measured once; one number a variable comes to the driver."""
        if self.scales is not None:
            return self
        found = variable_scales(tensor, self.kind).collect()
        return dataclasses.replace(self, scales=tuple(sorted((r["var"], r["scale"]) for r in found)))

    def _scaled(self, tensor: Tensor, before: bool) -> Tensor:
        if self.scales is None:
            raise RuntimeError("fit the scaling before it is applied")
        by = F.create_map(*[F.lit(x) for pair in self.scales for x in (int(pair[0]), float(pair[1]))])[F.col("var")]
        rows = tensor.rows.withColumn("by", by)
        return Tensor(rows.select("var", "x", F.transform("v", lambda e: e / F.col("by") if before else e * F.col("by")).alias("v")), tensor.extents)

    def pre(self, tensor: Tensor) -> Tensor:
        return self._scaled(tensor, True)

    def post(self, tensor: Tensor) -> Tensor:
        return self._scaled(tensor, False)


@dataclasses.dataclass(frozen=True)
class VariableAndVectorScaling:
    """Variable then vector before, vector then variable after; variables are measured on unweighted data."""

    vector: VectorScaling
    variable: VariableScaling

    def fit(self, tensor: Tensor) -> VariableAndVectorScaling:
        return dataclasses.replace(self, variable=self.variable.fit(tensor))

    def pre(self, tensor: Tensor) -> Tensor:
        return self.vector.pre(self.variable.pre(tensor))

    def post(self, tensor: Tensor) -> Tensor:
        return self.variable.post(self.vector.post(tensor))
