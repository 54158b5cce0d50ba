from itertools import combinations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spanforge.operators import deim, ecsw, truncate
from spanforge.plans.tensor import from_numpy
from spanforge.streaming.gram import stream_gram, streamed_gram


def pivot_rows(u):
    """The rows that Gaussian elimination with row pivots takes as its pivots, column after column."""
    left, order = u.astype(float).copy(), np.arange(len(u))
    for k in range(u.shape[1]):
        at = k + int(np.abs(left[k:, k]).argmax())
        left[[k, at]], order[[k, at]] = left[[at, k]], order[[at, k]]
        left[k + 1 :] -= np.outer(left[k + 1 :, k] / left[k, k], left[k])
    return order[: u.shape[1]].tolist()


def points_of(df):
    return [r["x"] for r in df.orderBy("rank").collect()]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), rows=st.integers(5, 30))
def test_indices_equal_pivot_rows(spark, seed, rows):
    u = np.random.default_rng(seed).normal(size=(1, rows, 5))
    assert points_of(deim.deim_indices(from_numpy(spark, u))) == pivot_rows(u[0])


def test_one_mode_and_all_points(spark):
    u = np.random.default_rng(2).normal(size=(1, 5, 5))
    assert sorted(points_of(deim.deim_indices(from_numpy(spark, u)))) == [0, 1, 2, 3, 4]
    assert points_of(deim.deim_indices(from_numpy(spark, u[:, :, :1]))) == [int(np.argmax(np.abs(u[0, :, 0])))]
    with pytest.raises(ValueError):
        deim.deim_indices(from_numpy(spark, np.ones((1, 2, 3))))


def test_multi_state(spark):
    u, phi = np.random.default_rng(3).normal(size=(3, 10, 5)), np.random.default_rng(4).normal(size=(3, 10, 3))
    points = deim.multi_state_deim_indices(from_numpy(spark, u))
    expected = sorted(set(sum((pivot_rows(u[v]) for v in range(3)), [])))
    assert points_of(points) == expected
    basis = deim.multi_state_test_basis(from_numpy(spark, phi), from_numpy(spark, u), points).numpy()
    for v in range(3):
        assert np.allclose(basis[v], (phi[v].T @ u[v] @ np.linalg.pinv(u[v][expected])).T)


def test_approximation(spark):
    u, phi = np.random.default_rng(5).normal(size=(1, 10, 5)), np.random.default_rng(6).normal(size=(1, 10, 3))
    order = [3, 0, 4, 1, 2, 7]  # one more than modes
    points = spark.createDataFrame(list(enumerate(order)), "rank int, x long")
    a = deim.approximation_matrix(from_numpy(spark, u), points).numpy()[0]
    assert a.shape == (10, 6)
    f = u[0] @ np.arange(5.0)
    assert np.allclose(a @ f[order], f)
    b = deim.test_basis(from_numpy(spark, phi), from_numpy(spark, u), points).numpy()[0]
    assert b.shape == (6, 3) and np.allclose(b.T @ f[order], phi[0].T @ f)


def system_of(spark, lhs):
    return spark.createDataFrame([(x, c.tolist()) for x, c in enumerate(lhs.T)], "x long, col array<double>")


@pytest.mark.parametrize("seed", range(4))
def test_nnls_is_optimal(spark, seed):
    """The conditions of the least residual with weights that are not negative: no gradient where a weight is positive,
    none that would let a zero weight grow. Right-hand sides that weights can meet, and others that none can."""
    rng = np.random.default_rng(seed)
    lhs = np.abs(rng.normal(size=(12, 8))) if seed % 2 else rng.normal(size=(12, 8))
    rhs = lhs @ np.where(rng.random(8) < 0.5, rng.random(8), 0) + (rng.normal(size=12) * 0.3 if seed > 1 else 0)
    points, weights = ecsw.NonNegativeLeastSquares(max_iters_res_unchanged=3)(system_of(spark, lhs), rhs, 1e-10)
    w = np.zeros(8)
    w[points] = weights
    gradient = lhs.T @ (rhs - lhs @ w)
    assert (weights > 0).all() and np.abs(gradient[points]).max() < 1e-8
    assert np.linalg.norm(rhs - lhs @ w) <= np.linalg.norm(rhs) and (seed > 1 or np.linalg.norm(rhs - lhs @ w) < 1e-8)
    best = min((float(np.linalg.norm(rhs - lhs[:, list(c)] @ f)) for k in range(9) for c in combinations(range(8), k) if (f := np.linalg.lstsq(lhs[:, list(c)], rhs, rcond=None)[0]).min(initial=1) >= 0))
    assert np.linalg.norm(rhs - lhs @ w) == pytest.approx(best, abs=1e-7)


def test_nnls_edges(spark):
    lhs = np.eye(3)
    assert ecsw.solve(system_of(spark, lhs), np.zeros(3), 1e-6).count() == 0
    assert ecsw.solve(system_of(spark, lhs), np.ones(3), 1.0).count() == 0
    points = ecsw.solve(system_of(spark, lhs), np.ones(3), 1e-9).orderBy("rank").collect()
    assert [r["x"] for r in points] == [0, 1, 2]  # equal correlations: the least point first
    assert ecsw.feasible_step(np.array([1.0, 0.0]), np.array([2.0, -1.0])) == 0.0
    assert ecsw.feasible_step(np.array([1.0, 1.0]), np.array([2.0, -1.0])) == 0.5


def test_system_and_mesh(spark):
    r, p = np.random.default_rng(8).normal(size=(2, 10, 3)), np.linalg.qr(np.random.default_rng(9).normal(size=(20, 2)))[0].reshape(2, 10, 2)
    system = ecsw.linear_system(from_numpy(spark, r), from_numpy(spark, p))
    lhs = np.array([row["col"] for row in system.orderBy("x").collect()]).T
    expected = np.array([[(p[:, x, m] * r[:, x, s]).sum() for x in range(10)] for s in range(3) for m in range(2)])
    assert np.allclose(lhs, expected)
    rhs = {row["row"]: row["val"] for row in ecsw.right_hand_side(system).collect()}
    assert np.allclose([rhs[k] for k in range(6)], (p.reshape(20, 2).T @ r.reshape(20, 3)).ravel(order="F"))
    mesh = ecsw.sample_mesh(from_numpy(spark, r), from_numpy(spark, p), 1e-4).collect()
    approximate = sum(expected[:, m["x"]] * m["weight"] for m in mesh)
    assert len(mesh) < 10 and np.linalg.norm(approximate - expected.sum(axis=1)) <= 1e-4 * np.linalg.norm(expected.sum(axis=1))
    with pytest.raises(ValueError):
        ecsw.linear_system(from_numpy(spark, r), from_numpy(spark, p[:1]))


def test_streamed_gram_counts_each_batch_once(spark, tmp_path):
    a = np.random.default_rng(10).normal(size=(1, 40, 3))
    from_numpy(spark, a).rows.repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("var int, x long, v array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream_gram(source, str(tmp_path / "sums"), str(tmp_path / "state")).awaitTermination()
    found = np.zeros((3, 3))
    for row in streamed_gram(spark.read.parquet(str(tmp_path / "sums"))).collect():
        found[row["i"], row["j"]] = row["g"]
    assert np.allclose(found, a[0].T @ a[0])


def test_no_energy(spark):
    assert truncate.Energy(0.9).modes([0, 0], 2) == 1
    assert truncate.energy_modes(spark.createDataFrame([(0, 0.0), (1, 0.0)], "mode long, sigma double"), 0.9).first()["k"] == 1
