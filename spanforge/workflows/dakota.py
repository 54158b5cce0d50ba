"""A study that another program drives: it gives a parameter file, and takes a results file."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from spanforge.sources.dakota import read_parameters


class DakotaCoupler:
    """``set_parameters(template, values)`` gives the input's text, ``run(input file)`` the quantities of interest."""

    def __init__(self, template: str, set_parameters: Callable[[str, Sequence[float]], str], run: Callable[[str], Sequence[float]], input_name: str = "input.dat"):
        self.template, self.set_parameters, self.run, self.input_name = template, set_parameters, run, input_name


def run_dakota_sampling(spark: SparkSession, coupler: DakotaCoupler, parameter_file: str, results_file: str, directory: str = ".") -> list[float]:
    values = [r["value"] for r in read_parameters(spark, parameter_file).orderBy("position").collect()]
    target = Path(directory) / coupler.input_name
    target.write_text(coupler.set_parameters(coupler.template, values))
    found = [float(q) for q in coupler.run(str(target))]
    Path(results_file).write_text("".join(f"{q!r}\n" for q in found))
    return found
