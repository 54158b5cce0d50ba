"""Parameter spaces and samplers.

A space turns a germ, uniform numbers in [0, 1) with one column a dimension, into typed columns. Germs come from numpy's
generators on the driver where draws must repeat published ones, or from Spark's where their number is what matters.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence
from typing import Any, Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class Parameter(Protocol):
    name: str
    dimension: int

    def columns(self, germ: Column, at: int) -> list[Column]:
        """Named columns from germ entries ``at`` .. ``at + dimension - 1``."""


@dataclasses.dataclass(frozen=True)
class UniformParameter:
    """Uniform between bounds; bounds of several entries make a vector, whose columns are name_0, name_1, ..."""

    name: str
    lower: float | Sequence[float] = 0.0
    upper: float | Sequence[float] = 1.0

    def __post_init__(self):
        lower, upper = self._bounds()
        if len(lower) != len(upper):
            raise ValueError("as many lower as upper bounds are needed")
        if any(a >= b for a, b in zip(lower, upper)):
            raise ValueError("lower bounds are less than upper ones")

    def _bounds(self) -> tuple[list[float], list[float]]:
        return [float(a) for a in np.atleast_1d(self.lower)], [float(b) for b in np.atleast_1d(self.upper)]

    @property
    def dimension(self) -> int:
        return len(self._bounds()[0])

    def columns(self, germ: Column, at: int) -> list[Column]:
        names = [self.name] if np.ndim(self.lower) == 0 else [f"{self.name}_{k}" for k in range(self.dimension)]
        return [(F.lit(a) + F.lit(b - a) * germ[at + k]).alias(name) for k, (name, a, b) in enumerate(zip(names, *self._bounds()))]


@dataclasses.dataclass(frozen=True)
class StringParameter:
    """A constant; it takes up one germ column all the same."""

    name: str
    value: Any
    dimension: int = 1

    def columns(self, germ: Column, at: int) -> list[Column]:
        return [F.lit(str(self.value)).alias(self.name)]


@dataclasses.dataclass(frozen=True)
class ParameterSpace:
    """Any mix of parameters; each keeps its type."""

    parameters: Sequence[Parameter]

    @property
    def names(self) -> list[str]:
        return [p.name for p in self.parameters]

    @property
    def dimension(self) -> int:
        return sum(p.dimension for p in self.parameters)

    def samples(self, germ: DataFrame) -> DataFrame:
        """``germ``: sample_idx, u. Returns sample_idx and the parameters' columns."""
        wrong = F.raise_error(F.lit(f"the germ needs {self.dimension} numbers in [0, 1] a sample")).cast("array<double>")
        good = (F.size("u") == self.dimension) & F.forall("u", lambda u: (u >= 0) & (u <= 1))
        rows = germ.select("sample_idx", F.when(good, F.col("u")).otherwise(wrong).alias("u"))
        columns, at = [], 0
        for p in self.parameters:
            columns += p.columns(F.col("u"), at)
            at += p.dimension
        return rows.select("sample_idx", *columns)

    def as_strings(self, samples: DataFrame) -> DataFrame:
        """All columns as text, as spaces with a text parameter may be wanted."""
        return samples.select("sample_idx", *[F.col(c).cast("string").alias(c) for c in samples.columns if c != "sample_idx"])


def homogeneous_space(names: Sequence[str], kind: Callable[..., Parameter], **values: Sequence[Any]) -> ParameterSpace:
    """One kind of parameter; each keyword has one value a name."""
    return ParameterSpace([kind(name, **{k: v[i] for k, v in values.items()}) for i, name in enumerate(names)])


def empty_space() -> ParameterSpace:
    return ParameterSpace([])


def uniform_space(names: Sequence[str], lower: Sequence[float], upper: Sequence[float]) -> ParameterSpace:
    return homogeneous_space(names, UniformParameter, lower=lower, upper=upper)


def constant_space(names: Sequence[str], values: Sequence[Any]) -> ParameterSpace:
    """Constants, always as text."""
    return homogeneous_space(names, StringParameter, value=values)


def germ_from_numpy(spark: SparkSession, u: np.ndarray, start: int = 0) -> DataFrame:
    rows = list(enumerate(np.asarray(u, dtype=float).reshape(len(u), -1).tolist(), start))
    return spark.createDataFrame(rows, "sample_idx int, u array<double>")


def monte_carlo_germ(n: int, dimension: int, rng: np.random.RandomState | int | None = None) -> np.ndarray:
    """Draws of the Mersenne twister; a generator that is passed goes on from where it is."""
    rng = rng if isinstance(rng, np.random.RandomState) else np.random.RandomState(rng)
    return rng.random_sample((n, dimension))


def latin_hypercube_germ(n: int, dimension: int, seed: int | None = None) -> np.ndarray:
    """One draw in each of n strata of every dimension, strata in random order."""
    rng = np.random.default_rng(seed)
    inside = rng.uniform(size=(n, dimension))
    strata = np.tile(np.arange(1, n + 1), (dimension, 1))
    for line in strata:
        rng.shuffle(line)
    return (strata.T - inside) / n


def monte_carlo_sample(spark: SparkSession, space: ParameterSpace, n: int = 1, seed: int | None = None) -> DataFrame:
    return space.samples(germ_from_numpy(spark, monte_carlo_germ(n, space.dimension, seed)))


def latin_hypercube_sample(spark: SparkSession, space: ParameterSpace, n: int = 1, seed: int | None = None) -> DataFrame:
    return space.samples(germ_from_numpy(spark, latin_hypercube_germ(n, space.dimension, seed)))


def distributed_monte_carlo(spark: SparkSession, space: ParameterSpace, n: int, seed: int = 0) -> DataFrame:
    """Draws made where they are used, for very many samples; another stream than the driver's."""
    u = F.array(*[F.rand(seed + k) for k in range(space.dimension)]) if space.dimension else F.expr("cast(array() as array<double>)")
    return space.samples(spark.range(n).select(F.col("id").alias("sample_idx"), u.alias("u")))


def distributed_latin_hypercube(spark: SparkSession, space: ParameterSpace, n: int, seed: int = 0) -> DataFrame:
    """Strata from ranks of hashes. Ranks run within hash buckets whose sizes are summed first, so no task sorts all n."""
    rows = spark.range(n).withColumnRenamed("id", "sample_idx")
    buckets = max(1, n // 10_000)
    for k in range(space.dimension):
        key = F.xxhash64(F.lit(seed), F.lit(k), "sample_idx")
        rows = rows.withColumn("key", key).withColumn("bucket", F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * buckets).cast("long"))
        before = rows.groupBy("bucket").count().withColumn("before", F.sum("count").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
        rank = F.row_number().over(W.partitionBy("bucket").orderBy("key", "sample_idx")) + F.coalesce("before", F.lit(0))
        rows = rows.join(before.select("bucket", "before"), "bucket").withColumn(f"u{k}", (rank - F.rand(seed + k)) / n).drop("bucket", "key", "before")
    u = F.array(*[F.col(f"u{k}") for k in range(space.dimension)]) if space.dimension else F.expr("cast(array() as array<double>)")
    return space.samples(rows.select("sample_idx", u.alias("u")))
