"""Orthonormal bases in the Euclidean or a weighted inner product."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators import linalg
from spanforge.plans.tensor import Tensor


def _qr(tensor: Tensor) -> Tensor:
    """Q with the sign rule of a positive diagonal of R."""
    factored = linalg.Tsqr(tensor)
    return factored.times(np.diag(np.where(np.diag(factored.r[:, : len(factored.r)]) < 0, -1.0, 1.0)))


QR: dict[str, Callable[[Tensor], Tensor]] = {"tsqr": _qr, "gram": lambda t: linalg.svd_gram(t)[0]}


class NoOrthogonalization:
    def orthogonalize(self, basis: Tensor) -> Tensor:
        return basis


@dataclasses.dataclass(frozen=True)
class EuclideanL2(NoOrthogonalization):
    """Q^T Q = I. ``qr``: tsqr, gram, or a callable from a tensor to a tensor."""

    qr: str | Callable[[Tensor], Tensor] = "tsqr"

    def orthogonalize(self, basis: Tensor) -> Tensor:
        return (self.qr if callable(self.qr) else QR[self.qr])(basis)


@dataclasses.dataclass(frozen=True)
class WeightedL2(NoOrthogonalization):
    """Q^T diag(w) Q = I. ``weights``: var, x, w, positive, one for each row."""

    weights: DataFrame
    qr: str | Callable[[Tensor], Tensor] = "tsqr"

    def orthogonalize(self, basis: Tensor) -> Tensor:
        def scaled(t: Tensor, up: bool) -> Tensor:
            bad = F.raise_error(F.lit("every row needs a positive weight")).cast("double")
            rows = t.rows.join(self.weights.select("var", "x", "w"), ["var", "x"], "left")
            root = F.sqrt(F.when(F.coalesce(F.col("w") > 0, F.lit(False)), F.col("w")).otherwise(bad))
            rows = rows.withColumn("root", root)
            return Tensor(rows.select("var", "x", F.transform("v", lambda e: e * F.col("root") if up else e / F.col("root")).alias("v")), t.extents)

        return scaled(EuclideanL2(self.qr).orthogonalize(scaled(basis, True)), False)
