import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from spanforge.queries import _Scripted
from spanforge.sources import dakota as dakota_source
from spanforge.workflows import dakota, greedy, params, sampling


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests


def values(df):
    return [tuple(r)[1:] for r in df.orderBy("sample_idx").collect()]


def test_parameters(spark):
    germ = params.germ_from_numpy(spark, np.array([[0.1], [0.5], [0.7]]))
    assert np.allclose(values(params.uniform_space(["u"], [-1], [1]).samples(germ)), [[-0.8], [0.0], [0.4]])
    germ = params.germ_from_numpy(spark, np.array([[0.1, 0.2], [0.5, 0.6], [0.7, 0.5]]))
    expected = [(-0.8, 0.6), (0.0, 1.8), (0.4, 1.5)]
    assert np.allclose(values(params.uniform_space(["u", "v"], [-1, 0], [1, 3]).samples(germ)), expected)
    vector = params.ParameterSpace([params.UniformParameter("u", [-1, 0], [1, 3])])
    assert vector.samples(germ).columns == ["sample_idx", "u_0", "u_1"] and np.allclose(values(vector.samples(germ)), expected)
    assert values(params.constant_space(["p1", "p2"], [1, "x"]).samples(germ)) == [("1", "x")] * 3
    mixed = params.ParameterSpace([params.UniformParameter("u"), params.StringParameter("p", "val")])
    assert values(mixed.as_strings(mixed.samples(germ)))[0] == ("0.1", "val")
    assert values(params.empty_space().samples(params.germ_from_numpy(spark, np.zeros((3, 0))))) == [()] * 3


def test_parameter_errors(spark):
    with pytest.raises(ValueError):
        params.UniformParameter("u", [0, 1], [1])
    with pytest.raises(ValueError):
        params.UniformParameter("u", 1, 1)
    for bad in ([[0.5, 0.5]], [[1.5]]):
        with pytest.raises(Exception, match="germ needs"):
            values(params.uniform_space(["u"], [0], [1]).samples(params.germ_from_numpy(spark, np.array(bad))))


def test_published_draws(spark):
    space = params.uniform_space(["u", "v"], [-1, 0], [1, 3])
    # The published draws.
    carlo = [(-0.69167432, 2.22014909), (-0.47336997, 1.60121818), (-0.97085008, 2.75624102), (0.80142971, 0.10026428)]
    cube = [(-0.12541223, 0.78993529), (0.40533981, 2.86553144), (0.82505538, 2.07709407), (-0.83522287, 0.66369046)]
    assert np.allclose(values(params.monte_carlo_sample(spark, space, 4, 12)), carlo)
    assert np.allclose(values(params.latin_hypercube_sample(spark, space, 4, 12)), cube)


def test_distributed_draws(spark):
    space = params.uniform_space(["u", "v"], [0, 0], [1, 1])
    drawn = np.array(values(params.distributed_latin_hypercube(spark, space, 25_000, 3)))
    for k in range(2):
        assert (np.sort(np.floor(drawn[:, k] * 25_000)) == np.arange(25_000)).all()
    carlo = np.array(values(params.distributed_monte_carlo(spark, space, 2_000, 3)))
    assert carlo.shape == (2_000, 2) and abs(carlo.mean() - 0.5) < 0.05


class Model:
    def populate_run_directory(self, run_dir, parameters):
        with open(f"{run_dir}/in", "w") as out:
            out.write(repr(parameters["u"]))

    def run_model(self, run_dir, parameters):
        with open(f"{run_dir}/in") as source:
            self.u = float(source.read())
        if self.u > 0.9:
            raise RuntimeError("too large")
        return 1 if self.u > 0.5 else 0

    def compute_qoi(self, run_dir, parameters):
        return [2 * self.u]

    def compute_error_estimate(self, run_dir, parameters):
        return self.u / 10


def test_sampling(spark, tmp_path):
    runs = sampling.run_sampling(spark, Model(), params.uniform_space(["u"], [0], [1]), 10, 1, stats=str(tmp_path / "stats")).orderBy("sample_idx").collect()
    drawn = np.random.RandomState(1).random_sample((10, 1))[:, 0]
    assert len(runs) == 10 and spark.read.parquet(str(tmp_path / "stats")).count() == 10
    for u, r in zip(drawn, runs):
        assert np.isclose(float(r["params"]["u"]), u)
        if u > 0.9:
            assert r["flag"] == 1 and "too large" in r["failure"] and r["qoi"] is None
        else:
            assert r["flag"] == int(u > 0.5) and np.isclose(r["qoi"][0], 2 * u) and np.isclose(r["error_estimate"], u / 10) and r["run_time"] >= 0


def test_cases_and_templates(spark, tmp_path):
    coupler = sampling.SamplingCoupler("u = {u}", lambda t, p: t.format(**p), lambda path, p: [float(open(path).read()[4:])])
    samples = params.uniform_space(["u"], [0], [1]).samples(params.germ_from_numpy(spark, np.array([[0.25], [0.5]])))
    assert [r["case"] for r in coupler.cases(samples, 7).orderBy("sample_idx").collect()] == ["run_7", "run_8"]
    assert sampling.run_one(coupler, {"u": 0.25})["qoi"] == [0.25]
    assert [r["text"] for r in dakota_source.template_cases("u = {u}", samples).orderBy("sample_idx").collect()] == ["u = 0.25", "u = 0.5"]
    (tmp_path / "a").write_text("x")
    sampling.setup_directory(str(tmp_path / "run"), [str(tmp_path / "a")], [])
    assert (tmp_path / "run" / "a").read_text() == "x"
    assert sampling.run_executable("true", str(tmp_path), name="x") == 0


def test_dakota(spark, tmp_path):
    (tmp_path / "params.in").write_text("   2 variables\n 1.5e0 a\n -2.0 b\n 1 functions\n 7 other\n")
    rows = dakota_source.read_parameters(spark, str(tmp_path / "params.in")).orderBy("position").collect()
    assert [(r["value"], r["name"]) for r in rows] == [(1.5, "a"), (-2.0, "b")]
    coupler = dakota.DakotaCoupler("{} {}", lambda t, v: t.format(*v), lambda path: [sum(map(float, open(path).read().split()))])
    assert dakota.run_dakota_sampling(spark, coupler, str(tmp_path / "params.in"), str(tmp_path / "out"), str(tmp_path)) == [-0.5]
    assert (tmp_path / "out").read_text() == "-0.5\n"


def test_greedy(spark):
    scripted = _Scripted([1.0, 2.0, 3.0, 1.5, 4.0, 0.9, 0.4, 0.6, 0.09, 0.1, 0.06, 1e-7, 1e-6, 1e-5], [1.0, 1.0, 0.4, 0.09, 0.01, 1e-6])
    result = greedy.run_greedy(spark, scripted, 1e-5, 5)
    assert result.training == [0, 1, 4, 2, 5] and result.pool == [3, 6, 7] and result.converged
    trace = result.trace.orderBy("iteration").collect()
    assert [r["indicator"] for r in trace] == [4.0, 0.9, 0.1, 1e-5]
    assert [r["qoi_error"] for r in trace] == [0.4, 0.09, 0.01, None]
    assert trace[0]["predicted"] is None and np.allclose([r["predicted"] for r in trace[1:]], [0.09, 0.01, 1e-6])
    endless = _Scripted([1.0] * 100, [1.0] * 100)
    assert not greedy.run_greedy(spark, endless, 1e-5, 5, max_iterations=3).converged
    with pytest.raises(ValueError):
        greedy.run_greedy(spark, scripted, 1e-5, 2)


def test_greedy_statistics(spark, tmp_path, caplog):
    # The published script.
    scripted = _Scripted([1.0, 2.0, 3.0, 1.5, 4.0, 0.9, 0.4, 0.6, 0.09, 0.1, 0.06, 1e-7, 1e-6, 1e-5], [1.0, 1.0, 0.4, 0.09, 0.01, 1e-6])
    with caplog.at_level("INFO", logger="spanforge.workflows.greedy"):
        result = greedy.run_greedy(spark, scripted, 1e-5, 5)
    greedy.write_statistics(result, str(tmp_path / "statistics"))
    read = lambda name: spark.read.parquet(str(tmp_path / "statistics" / name))
    assert read("trace").count() == 4
    times = read("times").first().asDict()
    assert set(times) == {"full_model", "reduced_model", "basis"} and all(v >= 0 for v in times.values())
    drawn = {r["sample_idx"]: r["u"] for r in read("parameters").collect()}
    assert sorted(drawn) == list(range(8)) and np.allclose([drawn[k] for k in range(5)], np.random.RandomState(1).random_sample((5, 1))[:, 0])
    logged = caplog.text
    assert all(f"{drawn[k]}" in logged for k in result.training)


def test_prepared_runs(spark, tmp_path):
    (tmp_path / "set up.sh").write_text("export WHAT='from the script'\n")
    (tmp_path / "program").write_text("#!/bin/bash\necho \"$WHAT $1\" > out\n")
    (tmp_path / "program").chmod(0o755)
    assert sampling.run_executable(str(tmp_path / "program"), str(tmp_path), pre_script=str(tmp_path / "set up.sh"), name="a b; false") == 0
    assert (tmp_path / "out").read_text() == "from the script --name=a b; false\n"
    assert sampling.run_executable("true", str(tmp_path), module="no-such-module") != 0


def test_errors_and_choices(spark):
    of = lambda xs: spark.createDataFrame(list(enumerate(map(float, xs))), "k int, q double")
    assert np.isclose(greedy.qoi_error(of([3, 4]), of([3, 2]), ["k"]).first()["error"], 2 / 5)
    assert greedy.qoi_error(of([0, 0]), of([1, 0]), ["k"]).first()["error"] == math.inf
    assert math.isnan(greedy.qoi_error(of([0]), of([0]), ["k"]).first()["error"])
    short = spark.createDataFrame([(0, 3.0)], "k int, q double")  # the reduced model lacks a quantity
    assert np.isclose(greedy.qoi_error(of([3, 4]), short, ["k"]).first()["error"], 4 / 5)
    sweep = spark.createDataFrame([(0, 7, 1.0), (1, 3, 2.0), (2, 9, 2.0)], "position int, sample int, indicator double")
    assert tuple(greedy.largest_indicator(sweep).first()) == (3, 2.0)
