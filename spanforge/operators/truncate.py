"""How many modes to keep."""

from __future__ import annotations

import dataclasses
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanforge.plans.tensor import Tensor


def energy_modes(sigma: DataFrame, threshold: float) -> DataFrame:
    """One row, ``k``: modes until the running share of squared singular values exceeds the threshold, in mode order.

    ``sigma``: mode, sigma, one row a mode (as many as samples). If no share exceeds it, or there is no energy at all, one
    mode stays.
    """
    order = W.orderBy("mode").rowsBetween(W.unboundedPreceding, W.currentRow)
    square = F.col("sigma") * F.col("sigma")
    ranked = sigma.select("mode", F.try_divide(F.sum(square).over(order), F.sum(square).over(W.partitionBy())).alias("share"), F.row_number().over(W.orderBy("mode")).alias("n"))
    return ranked.agg(F.coalesce(F.min(F.when(F.col("share") > threshold, F.col("n"))), F.lit(1)).alias("k"))


class NoTruncation:
    def modes(self, sigma: Sequence[float], available: int) -> int:
        return available

    def truncate(self, basis: Tensor, sigma: Sequence[float] = ()) -> Tensor:
        k = self.modes(sigma, basis.extents.n_s)
        return basis if k == basis.extents.n_s else basis.with_values(F.slice("v", 1, k), k)


@dataclasses.dataclass(frozen=True)
class BasisSize(NoTruncation):
    k: int

    def __post_init__(self):
        if self.k <= 0:
            raise ValueError("a basis has at least one mode")

    def modes(self, sigma: Sequence[float], available: int) -> int:
        if self.k > available:
            raise ValueError(f"{self.k} modes of {available} are asked for")
        return self.k


@dataclasses.dataclass(frozen=True)
class Energy(NoTruncation):
    threshold: float

    def modes(self, sigma: Sequence[float], available: int) -> int:
        total = sum(s * s for s in sigma)
        if self.threshold >= 1:
            warnings.warn("no share of the energy exceeds 1; one mode stays", stacklevel=2)
        running = 0.0
        for k, s in enumerate(sigma, 1):
            running += s * s
            if total > 0 and running / total > self.threshold:
                return k
        return 1
