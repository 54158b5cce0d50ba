"""Snapshot and basis tensors as DataFrames.

One row a degree of freedom, ``var INT, x BIGINT, v ARRAY<DOUBLE>``: the sample (or mode) axis is the array, so maps over
samples are narrow and the matrix view (row ``var * n_x + x``) is only another key. Tensors are immutable: operators
return new ones and never change their input.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Extents:
    """Variables, points and samples (or modes); carried along, never recounted."""

    n_var: int
    n_x: int
    n_s: int

    def __iter__(self):
        return iter((self.n_var, self.n_x, self.n_s))


@dataclasses.dataclass(frozen=True)
class Tensor:
    rows: DataFrame
    extents: Extents

    def with_values(self, value: Column, n_s: int | None = None) -> Tensor:
        e = self.extents if n_s is None else dataclasses.replace(self.extents, n_s=n_s)
        return Tensor(self.rows.select("var", "x", value.alias("v")), e)

    def long(self, sample: str = "s") -> DataFrame:
        """var, x, sample, val."""
        return self.rows.select("var", "x", F.posexplode("v").alias(sample, "val")).select("var", "x", F.col(sample).cast("long").alias(sample), "val")

    def row_ids(self) -> DataFrame:
        """The matrix view: row_id, v."""
        return self.rows.select((F.col("var") * F.lit(self.extents.n_x) + F.col("x")).cast("long").alias("row_id"), "v")

    def numpy(self) -> np.ndarray:
        """The whole tensor on the driver; for small ones, such as tests and exports."""
        out = np.full(tuple(self.extents), np.nan)
        for r in self.rows.toLocalIterator():
            out[r["var"], r["x"]] = r["v"]
        return out


def from_long(df: DataFrame, extents: Extents, sample: str = "s") -> Tensor:
    """From one row a cell (var, x, sample, val). Each row's samples meet in one array of n_s values."""
    grouped = df.groupBy(F.col("var").cast("int").alias("var"), F.col("x").cast("long").alias("x")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(sample).alias("s"), F.col("val").cast("double").alias("val")))).alias("cells")
    )
    return Tensor(grouped.select("var", "x", F.transform("cells", lambda c: c["val"]).alias("v")), extents)


def from_rows(df: DataFrame, extents: Extents) -> Tensor:
    return Tensor(df.select(F.col("var").cast("int").alias("var"), F.col("x").cast("long").alias("x"), F.col("v").cast("array<double>").alias("v")), extents)


def from_matrix_rows(df: DataFrame, extents: Extents) -> Tensor:
    """From row_id, v: the inverse of the matrix view."""
    n = F.lit(extents.n_x)
    return Tensor(df.select(F.floor(F.col("row_id") / n).cast("int").alias("var"), F.pmod("row_id", n).cast("long").alias("x"), "v"), extents)


def from_numpy(spark: SparkSession, data: np.ndarray) -> Tensor:
    """From an array (n_var, n_x, n_s) on the driver; integers become doubles."""
    data = np.asarray(data, dtype=float)
    n_var, n_x, n_s = data.shape
    rows = [(k // n_x, k % n_x, v) for k, v in enumerate(data.reshape(-1, n_s).tolist())]
    return Tensor(spark.createDataFrame(rows, "var int, x long, v array<double>"), Extents(n_var, n_x, n_s))


def checked(tensor: Tensor) -> Tensor:
    """Fails unless every cell is there once and none is null: a hole would change means without a sign."""
    n_var, n_x, n_s = tensor.extents
    bad = (F.size("v") != n_s) | F.exists("v", lambda e: e.isNull())
    n, keys, holes = tensor.rows.agg(F.count(F.lit(1)), F.count_distinct("var", "x"), F.count_if(bad)).first()
    if n != n_var * n_x or keys != n or holes:
        raise ValueError(f"not dense: {n} rows ({keys} different) for {n_var} x {n_x}, {holes} of them without {n_s} values")
    return tensor


def scalars(spark: SparkSession, data: np.ndarray, name: str) -> DataFrame:
    """(var, x, name) from an array (n_var, n_x), or (x, name) from one of (n_x,)."""
    data = np.asarray(data, dtype=float)
    if data.ndim == 1:
        return spark.createDataFrame(pd.DataFrame({"x": np.arange(len(data)), name: data}), f"x long, {name} double")
    n_var, n_x = data.shape
    frame = pd.DataFrame({"var": np.repeat(np.arange(n_var), n_x), "x": np.tile(np.arange(n_x), n_var), name: data.ravel()})
    return spark.createDataFrame(frame, f"var int, x long, {name} double")
