"""Affine vector spaces: a shift and a basis."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators import linalg
from spanforge.operators.orthogonalize import NoOrthogonalization
from spanforge.operators.scale import NoScaling
from spanforge.operators.shift import Shift, no_shift
from spanforge.operators.truncate import NoTruncation
from spanforge.plans.tensor import Extents, Tensor


@dataclasses.dataclass(frozen=True)
class VectorSpace:
    """``shift``: var, x, shift. ``sigma``: singular values, where there are any."""

    shift: DataFrame
    basis: Tensor
    sigma: np.ndarray | None = None

    @property
    def extents(self) -> Extents:
        return self.basis.extents


def dictionary_space(snapshots: Tensor, shift: Shift | None = None, orthogonalizer: NoOrthogonalization | None = None) -> VectorSpace:
    """The shifted snapshots themselves, made orthonormal if wanted; nothing is truncated."""
    shift = shift or no_shift(snapshots)
    return VectorSpace(shift.vector(snapshots), (orthogonalizer or NoOrthogonalization()).orthogonalize(shift.apply(snapshots)))


def pod_space(
    snapshots: Tensor, truncater: NoTruncation | None = None, shift: Shift | None = None, orthogonalizer: NoOrthogonalization | None = None,
    scaler: NoScaling | None = None, svd: str | Callable = "tsqr", sign: str = "largest",
) -> VectorSpace:
    """Proper orthogonal decomposition: shift, scale, decompose, truncate, scale back, orthogonalize."""
    shift = shift or no_shift(snapshots)
    shifted = shift.apply(snapshots)
    scaler = (scaler or NoScaling()).fit(shifted)
    u, sigma = linalg.decompose(scaler.pre(shifted), svd, sign)
    basis = (truncater or NoTruncation()).truncate(u, list(sigma))
    basis = (orthogonalizer or NoOrthogonalization()).orthogonalize(scaler.post(basis))
    return VectorSpace(shift.vector(snapshots), basis, sigma)


@dataclasses.dataclass(frozen=True)
class CompositeSpace:
    """Spaces over one mesh stacked: variables one after the other, modes block-diagonal."""

    spaces: Sequence[VectorSpace]

    def __post_init__(self):
        if not self.spaces or len({s.extents.n_x for s in self.spaces}) != 1:
            raise ValueError("the spaces of a composite have the same number of points")

    @property
    def extents(self) -> Extents:
        return Extents(sum(s.extents.n_var for s in self.spaces), self.spaces[0].extents.n_x, sum(s.extents.n_s for s in self.spaces))

    def _offsets(self) -> list[tuple[VectorSpace, int, int]]:
        out, var, mode = [], 0, 0
        for s in self.spaces:
            out.append((s, var, mode))
            var, mode = var + s.extents.n_var, mode + s.extents.n_s
        return out

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        all_parts = parts[0]
        for part in parts[1:]:
            all_parts = all_parts.unionByName(part)
        return all_parts

    def shift(self) -> DataFrame:
        return self._union([s.shift.select((F.col("var") + v).cast("int").alias("var"), "x", "shift") for s, v, _ in self._offsets()])

    def basis(self) -> Tensor:
        """Dense, with zeros outside the blocks."""
        total = self.extents.n_s
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        parts = [s.basis.rows.select((F.col("var") + v).cast("int").alias("var"), "x", F.concat(zeros(m), "v", zeros(total - m - s.extents.n_s)).alias("v")) for s, v, m in self._offsets()]
        return Tensor(self._union(parts), self.extents)

    def compact_basis(self) -> DataFrame:
        """var, x, mode, val of the blocks alone."""
        return self._union([s.basis.long("mode").select((F.col("var") + v).cast("int").alias("var"), "x", (F.col("mode") + m).alias("mode"), "val") for s, v, m in self._offsets()])

    def compact_blocks(self) -> tuple[list[Tensor], list[DataFrame]]:
        """The spaces' own bases and shifts, as they are."""
        return [s.basis for s in self.spaces], [s.shift for s in self.spaces]
