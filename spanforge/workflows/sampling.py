"""Running a model for many parameter samples, each in a folder of its own, all at once."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.plans.storage import written
from spanforge.workflows.params import ParameterSpace, monte_carlo_sample


class Model(Protocol):
    def populate_run_directory(self, run_dir: str, parameters: dict[str, Any]) -> None: ...

    def run_model(self, run_dir: str, parameters: dict[str, Any]) -> int:
        """0 if all went well."""


class QoiModel(Model, Protocol):
    def compute_qoi(self, run_dir: str, parameters: dict[str, Any]) -> Sequence[float]: ...


class QoiModelWithErrorEstimate(QoiModel, Protocol):
    def compute_error_estimate(self, run_dir: str, parameters: dict[str, Any]) -> float: ...


RUN_SCHEMA = "sample_idx long, params map<string, string>, flag int, run_time double, qoi array<double>, error_estimate double, failure string"


def create_empty_dir(parent: str | None = None) -> str:
    """A new folder; nothing that exists is ever removed."""
    return tempfile.mkdtemp(prefix="run-", dir=parent)


def setup_directory(target: str, links: Sequence[str] = (), copies: Sequence[str] = ()) -> None:
    """Files linked or copied into a run folder."""
    Path(target).mkdir(parents=True, exist_ok=True)
    for name in links:
        (Path(target) / Path(name).name).symlink_to(Path(name).resolve())
    for name in copies:
        shutil.copy(name, target)


#: Loads the module named $1, if any, then reads the script $2, if any, then becomes the program. Nothing of it is ever
#: pasted into the text of a command.
_PREPARED = 'if [ -n "$1" ]; then module load "$1" || exit; fi; if [ -n "$2" ]; then . "$2" || exit; fi; shift 2; exec "$@"'


def run_executable(
    executable: str, directory: str, num_procs: int = 1, launcher: Sequence[str] = ("mpirun", "-n"), module: str | None = None, pre_script: str | None = None, **flags: Any
) -> int:
    """Runs a program in a folder; keyword arguments become --name=value.

    ``module``: an environment module to load first; ``pre_script``: a file of shell commands that set the environment.
    Only then a login shell prepares the program's environment; names and values reach it as arguments.
    """
    command = [*launcher, str(num_procs), executable] if num_procs > 1 else [executable]
    command += [f"--{k}={v}" for k, v in flags.items()]
    if module or pre_script:
        command = ["bash", "-lc", _PREPARED, "run", module or "", str(Path(pre_script).resolve()) if pre_script else "", *command]
    return subprocess.run(command, cwd=directory, check=False).returncode


def run_one(model: Model, parameters: dict[str, Any], prefix: str | None = None, keep: bool | None = None) -> dict[str, Any]:
    """Flag, wall time and what else the model computes; a failure is a row, not the end of the job.

    ``keep``: whether the run's folder stays; by default if a place is given for it.
    """
    folder = create_empty_dir(prefix)
    out: dict[str, Any] = {"flag": 1, "run_time": 0.0, "qoi": None, "error_estimate": None, "failure": None}
    began = time.time()
    try:
        model.populate_run_directory(folder, parameters)
        began = time.time()
        out["flag"] = int(model.run_model(folder, parameters))
        out["run_time"] = time.time() - began
        if hasattr(model, "compute_qoi"):
            out["qoi"] = [float(q) for q in model.compute_qoi(folder, parameters)]
        if hasattr(model, "compute_error_estimate"):
            out["error_estimate"] = float(model.compute_error_estimate(folder, parameters))
    except Exception as error:  # the sample's own failure is reported in its row
        out |= {"run_time": time.time() - began, "failure": f"{type(error).__name__}: {error}"}
    finally:
        if not (prefix is not None if keep is None else keep):
            shutil.rmtree(folder, ignore_errors=True)
    return out


def run_samples(model: Model, samples: DataFrame, prefix: str | None = None, tasks: int | None = None) -> DataFrame:
    """``samples``: sample_idx and parameters. One row a run; runs happen once, as the rows are written down.

    A run costs far more than its row, so rows are dealt out to ``tasks`` (four a core), however they lie in files.
    """
    samples = samples.repartition(tasks or 4 * samples.sparkSession.sparkContext.defaultParallelism, "sample_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Folders that do not stay lie in one of the task's own, so that tasks do not wait for each other to make them.
        with tempfile.TemporaryDirectory(prefix="runs-", ignore_cleanup_errors=True) as own:
            for batch in batches:
                rows = []
                for record in batch.to_dict("records"):
                    index = record.pop("sample_idx")
                    out = run_one(model, record, prefix or own, prefix is not None)
                    rows.append({"sample_idx": index, "params": {k: str(v) for k, v in record.items()}} | out)
                yield pd.DataFrame(rows, columns=["sample_idx", "params", "flag", "run_time", "qoi", "error_estimate", "failure"])

    return written(samples.mapInPandas(run, RUN_SCHEMA))


def run_sampling(spark: SparkSession, model: Model, space: ParameterSpace, n: int = 10, seed: int = 1, prefix: str | None = None, stats: str | None = None) -> DataFrame:
    """Monte Carlo samples run in parallel; ``stats``: where to append the run times as parquet."""
    runs = run_samples(model, monte_carlo_sample(spark, space, n, seed), prefix, min(n, 4 * spark.sparkContext.defaultParallelism))
    if stats is not None:
        runs.select("sample_idx", "flag", "run_time").write.mode("append").parquet(stats)
    return runs


class SamplingCoupler:
    """Couples an application by a template: subclasses say how to set parameters in it and how to run it."""

    def __init__(self, template: str, set_parameters: Callable[[str, dict[str, Any]], str], run: Callable[[str, dict[str, Any]], Sequence[float]], file_name: str = "input.dat"):
        self.template, self.set_parameters, self.run, self.file_name = template, set_parameters, run, file_name

    def cases(self, samples: DataFrame, start: int = 0, prefix: str = "run_") -> DataFrame:
        """The case table: sample_idx, case, and the parameters."""
        number = (F.col("sample_idx") + start).cast("long")
        return samples.select(number.alias("sample_idx"), F.concat(F.lit(prefix), number).alias("case"), *[c for c in samples.columns if c != "sample_idx"])

    def populate_run_directory(self, run_dir: str, parameters: dict[str, Any]) -> None:
        (Path(run_dir) / self.file_name).write_text(self.set_parameters(self.template, parameters))

    def run_model(self, run_dir: str, parameters: dict[str, Any]) -> int:
        self._qoi = self.run(str(Path(run_dir) / self.file_name), parameters)
        return 0

    def compute_qoi(self, run_dir: str, parameters: dict[str, Any]) -> Sequence[float]:
        return self._qoi
