"""Where vector spaces go: parquet tables, an export for numpy, and a table of named nodal fields."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.space import VectorSpace
from spanforge.plans.tensor import Extents, Tensor


def write_space(space: VectorSpace, path: str, compress: bool = True) -> None:
    """Tables ``basis`` and ``shift`` below ``path``."""
    codec = "zstd" if compress else "none"
    space.basis.rows.select("var", "x", "v").write.option("compression", codec).parquet(f"{path}/basis")
    space.shift.select("var", "x", "shift").write.option("compression", codec).parquet(f"{path}/shift")


def read_space(spark: SparkSession, path: str, extents: Extents) -> VectorSpace:
    return VectorSpace(spark.read.parquet(f"{path}/shift"), Tensor(spark.read.parquet(f"{path}/basis"), extents))


def export_npz(space: VectorSpace, path: str, compress: bool = True) -> None:
    """One file with the arrays ``shift`` and ``basis``; for spaces that fit on the driver."""
    n_var, n_x, _ = space.extents
    shift = np.zeros((n_var, n_x))
    for r in space.shift.toLocalIterator():
        shift[r["var"], r["x"]] = r["shift"]
    (np.savez_compressed if compress else np.savez)(path, shift=shift, basis=space.basis.numpy())


def export_hdf5(space: VectorSpace, path: str) -> None:
    """The same arrays as datasets of an HDF5 file, where h5py is installed."""
    import h5py

    n_var, n_x, _ = space.extents
    shift = np.zeros((n_var, n_x))
    for r in space.shift.toLocalIterator():
        shift[r["var"], r["x"]] = r["shift"]
    with h5py.File(path, "w") as out:
        out.create_dataset("shift", data=shift)
        out.create_dataset("basis", data=space.basis.numpy())


class MeshWriter(Protocol):
    """What a mesh library has to offer for ``export_mesh_fields``."""

    def define(self, names: Sequence[str]) -> None: ...

    def put(self, name: str, step: int, values: np.ndarray) -> None: ...

    def close(self) -> None: ...


def export_mesh_fields(space: VectorSpace, writer: MeshWriter, var_names: Sequence[str] | None = None) -> None:
    """The space's fields, one after the other, each with its values at all points, to a mesh file; step 1, as meshes
    count. ``writer`` opens the copy of the mesh; it is closed whatever happens."""
    n_var, _, k = space.extents
    names = field_names(n_var, k, var_names)
    try:
        writer.define(names)
        table = nodal_fields(space, var_names).orderBy("x")
        for at in range(0, len(names), k + 1):  # a variable at a time, so the driver holds k + 1 fields
            own = table.select(*names[at : at + k + 1]).toPandas()
            for name in own.columns:
                writer.put(name, 1, own[name].to_numpy())
    finally:
        writer.close()


#: The names under which meshes keep these fields.
def field_names(n_var: int, n_modes: int, var_names: Sequence[str] | None = None) -> list[str]:
    """u0_<var>, then phi_<var>_<mode> from 1, padded with zeros to one width."""
    names = list(var_names) if var_names is not None else [str(i) for i in range(n_var)]
    if len(names) != n_var:
        raise ValueError(f"{len(names)} names for {n_var} variables")
    width = int(math.log10(n_modes)) + 1
    return [field for name in names for field in [f"u0_{name}", *(f"phi_{name}_{str(m + 1).zfill(width)}" for m in range(n_modes))]]


def nodal_fields(space: VectorSpace, var_names: Sequence[str] | None = None) -> DataFrame:
    """x and one column a field: the layout in which meshes store nodal variables."""
    n_var, _, k = space.extents
    names = field_names(n_var, k, var_names)
    rows = space.basis.rows.join(space.shift, ["var", "x"]).select("var", "x", F.concat(F.array("shift"), "v").alias("f"))
    of = lambda var, m: F.max(F.when(F.col("var") == var, F.col("f")[m]))
    return rows.groupBy("x").agg(*(of(var, m).alias(names[var * (k + 1) + m]) for var in range(n_var) for m in range(k + 1)))
