"""Greedy choice of training samples for a reduced model.

The loop is on the driver; each sweep of the reduced model over the pool is one job. Its state is a small list of rows,
which become the trace.
"""

from __future__ import annotations

import dataclasses
import logging
import time
from collections.abc import Callable, Sequence
from typing import Any, Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanforge.workflows.params import ParameterSpace, germ_from_numpy, monte_carlo_germ


log = logging.getLogger(__name__)


class GreedyCoupler(Protocol):
    """``samples``: a DataFrame sample_idx and parameters, in the order of the ids that are asked for."""

    def parameter_space(self) -> ParameterSpace: ...

    def run_fom(self, samples: DataFrame) -> None: ...

    def create_trial_space(self, training: Sequence[int]) -> None: ...

    def error_indicators(self, samples: DataFrame, ids: Sequence[int]) -> Sequence[float]:
        """Runs the reduced model for all samples and returns their indicators in the order of ``ids``."""

    def qoi_error(self, sample: DataFrame, idx: int) -> float: ...


def qoi_error(fom: DataFrame, rom: DataFrame, key: Sequence[str], value: str = "q") -> DataFrame:
    """One row, ``error``: norm of the difference over the norm of the full model; NaN or infinity where that is zero.

    A quantity that only one side has is zero on the other, so what the reduced model lacks counts as wholly wrong.
    """
    sides = fom.select(*key, F.col(value).alias("f")).join(rom.select(*key, F.col(value).alias("r")), list(key), "full")
    both = sides.select(F.coalesce("f", F.lit(0.0)).alias("f"), F.coalesce("r", F.lit(0.0)).alias("r"))
    difference, size = F.sqrt(F.sum(F.pow(F.col("f") - F.col("r"), F.lit(2.0)))), F.sqrt(F.sum(F.pow("f", F.lit(2.0))))
    infinite = F.when(F.col("d") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return both.agg(difference.alias("d"), size.alias("n")).select(F.when(F.col("n") > 0, F.try_divide("d", "n")).otherwise(infinite).alias("error"))


def running_ratio(history: DataFrame, order: str = "iteration", x: str = "indicator", y: str = "qoi_error") -> DataFrame:
    """iteration, c: mean error over mean indicator of all iterations so far."""
    past = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return history.select(order, F.try_divide(F.avg(y).over(past), F.avg(x).over(past)).alias("c"))


def largest_indicator(sweep: DataFrame) -> DataFrame:
    """One row, sample and indicator: the largest one, the first in ``position`` of equals. ``sweep``: position, sample, indicator."""
    best = F.max_by(F.struct("sample", "indicator"), F.struct("indicator", -F.col("position"))).alias("b")
    return sweep.agg(best).select("b.sample", "b.indicator")


@dataclasses.dataclass
class Regressor:
    """Predicts the error from the indicator by one factor."""

    c: float = 1.0

    def fit(self, indicators: Sequence[float], errors: Sequence[float]) -> None:
        self.c = float(np.mean(errors) / np.mean(indicators))

    def predict(self, indicator: float) -> float:
        return self.c * indicator


@dataclasses.dataclass(frozen=True)
class GreedyResult:
    training: list[int]
    pool: list[int]
    converged: bool
    trace: DataFrame  # iteration, sample, indicator, qoi_error, predicted
    times: DataFrame  # full_model, reduced_model, basis: seconds of the whole run
    parameters: DataFrame  # sample_idx and the parameters of every sample that was drawn


TRACE_SCHEMA = "iteration int, sample int, indicator double, qoi_error double, predicted double"


def run_greedy(spark: SparkSession, coupler: GreedyCoupler, tolerance: float, testing_sample_size: int = 10, seed: int = 1, max_iterations: int = 1000) -> GreedyResult:
    """Starts from samples 0 and 1 and adds the pool's sample of largest indicator until the predicted error is below
    ``tolerance``. Each sample taken from the pool is replaced by a new one. The first round never stops, as there is no
    prediction yet; the last round, which converges, is in the trace too, without an error."""
    if testing_sample_size < 3:
        raise ValueError("at least three samples are needed: two to train on and one to test")
    space, seconds = coupler.parameter_space(), dict.fromkeys(("full_model", "reduced_model", "basis"), 0.0)

    def timed(what: str, call: Callable, *given: Any) -> Any:
        began = time.perf_counter()
        out = call(*given)
        seconds[what] += time.perf_counter() - began
        return out

    rng = np.random.RandomState(seed)  # one stream for the whole run
    drawn = monte_carlo_germ(testing_sample_size, space.dimension, rng)

    def samples(ids: Sequence[int]) -> DataFrame:
        chosen = germ_from_numpy(spark, drawn).where(F.col("sample_idx").isin(list(ids)))
        return space.samples(chosen)

    training, pool = [0, 1], list(range(2, testing_sample_size))
    log.info("first samples %s", [r.asDict() for r in samples(training).orderBy("sample_idx").collect()])
    timed("full_model", coupler.run_fom, samples(training))
    timed("basis", coupler.create_trial_space, list(training))
    timed("reduced_model", coupler.error_indicators, samples(training), list(training))  # the loop makes no use of them
    for i in training:
        coupler.qoi_error(samples([i]), i)
    regressor, rows, converged = Regressor(), [], False
    for iteration in range(1, max_iterations + 1):
        found = np.asarray(timed("reduced_model", coupler.error_indicators, samples(pool), list(pool)), dtype=float)
        best = int(np.argmax(found))
        pick, indicator = pool[best], float(found[best])
        predicted = regressor.predict(indicator) if iteration > 1 else None
        log.info("round %d: sample %d has the largest indicator, %g; predicted error %s", iteration, pick, indicator, predicted)
        if predicted is not None and predicted < tolerance:
            rows.append((iteration, pick, indicator, None, predicted))
            converged = True
            break
        log.info("round %d: full model for %s", iteration, samples([pick]).first().asDict())
        timed("full_model", coupler.run_fom, samples([pick]))
        training.append(pick)
        pool.remove(pick)
        rows.append((iteration, pick, indicator, float(coupler.qoi_error(samples([pick]), pick)), predicted))
        regressor.fit([r[2] for r in rows], [r[3] for r in rows])
        timed("basis", coupler.create_trial_space, list(training))
        drawn = np.concatenate([drawn, monte_carlo_germ(1, space.dimension, rng)])
        pool.append(len(drawn) - 1)
    times = spark.createDataFrame([tuple(seconds.values())], ", ".join(f"{k} double" for k in seconds))
    return GreedyResult(training, pool, converged, spark.createDataFrame(rows, TRACE_SCHEMA), times, samples(range(len(drawn))))


def write_statistics(result: GreedyResult, path: str) -> None:
    """Tables ``trace``, ``times`` and ``parameters`` below ``path``."""
    for name in ("trace", "times", "parameters"):
        getattr(result, name).write.mode("overwrite").parquet(f"{path}/{name}")


