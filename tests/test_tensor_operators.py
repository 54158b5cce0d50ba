import numpy as np
import pytest

from spanforge.operators import linalg, scale, shift, truncate
from spanforge.operators.orthogonalize import EuclideanL2, WeightedL2
from spanforge.operators.space import CompositeSpace, dictionary_space, pod_space
from spanforge.plans.storage import drop_written, written
from spanforge.plans.tensor import Extents, checked, from_long, from_matrix_rows, from_numpy, scalars
from spanforge.sources import sinks


def table_of(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["var"], r["x"]] = r["shift"]
    return out


def sign_fixed(u):
    for k in range(u.shape[1]):
        best = np.argmax(np.round(np.abs(u[:, k]), 9))
        u[:, k] *= 1 if u[best, k] >= 0 else -1
    return u


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(3).normal(size=(3, 10, 5))


def test_round_trips_and_matrix_view(spark, data):
    t = from_numpy(spark, data)
    assert np.array_equal(t.numpy(), data)
    assert np.array_equal(from_long(t.long(), t.extents).numpy(), data)
    assert np.array_equal(from_matrix_rows(t.row_ids(), t.extents).numpy(), data)
    assert from_numpy(spark, np.ones((1, 2, 2), dtype=int)).rows.schema["v"].dataType.elementType.typeName() == "double"


def test_holes_and_nulls_are_refused(spark, data):
    t = from_numpy(spark, data)
    checked(t)
    with pytest.raises(ValueError, match="not dense"):
        checked(from_long(t.long().where("not (var = 1 and x = 2 and s = 3)"), t.extents))
    with pytest.raises(ValueError, match="not dense"):
        checked(from_long(t.long().selectExpr("var", "x", "s", "if(x = 4 and s = 1, null, val) as val"), t.extents))


def test_shifts(spark, data):
    t = from_numpy(spark, data)
    vector = np.random.default_rng(4).normal(size=(3, 10))
    cases = [
        (shift.no_shift(t), np.zeros((3, 10))), (shift.constant_shift(2, t), np.full((3, 10), 2.0)),
        (shift.constant_shift([4, 1, 3], t), np.repeat([[4.0], [1.0], [3.0]], 10, axis=1)), (shift.vector_shift(scalars(spark, vector, "shift"), t), vector),
        (shift.average_shift(t), data.mean(axis=2)), (shift.first_vector_shift(t), data[:, :, 0]),
    ]
    for s, expected in cases:
        assert np.allclose(table_of(s.vector(t), (3, 10)), expected)
        moved = s.apply(t)
        assert np.allclose(moved.numpy(), data - expected[:, :, None])
        assert np.allclose(s.invert(moved).numpy(), data)
    assert np.array_equal(t.numpy(), data)  # the input is as it was
    with pytest.raises(ValueError):
        shift.constant_shift([1.0, 2.0], t)
    with pytest.raises(TypeError):
        shift.constant_shift("2", t)
    with pytest.raises(Exception, match="lacks a row"):
        shift.vector_shift(scalars(spark, vector[:2], "shift"), t).apply(t).numpy()


def test_scalings(spark, data):
    t, w = from_numpy(spark, data), np.abs(np.random.default_rng(5).normal(size=10))
    for kind, f in (("max_abs", lambda a: np.abs(a).max()), ("mean_abs", lambda a: np.abs(a).mean()), ("variance", np.std)):
        by = np.array([f(data[v]) for v in range(3)])[:, None, None]
        model = scale.VariableScaling(kind).fit(t)
        assert np.allclose(model.pre(t).numpy(), data / by)
        assert np.allclose(model.post(model.pre(t)).numpy(), data)
        both = scale.VariableAndVectorScaling(scale.VectorScaling(scalars(spark, w, "w")), scale.VariableScaling(kind)).fit(t)
        assert np.allclose(both.pre(t).numpy(), data / by / w[:, None])
        assert np.allclose(both.post(both.pre(t)).numpy(), data)
    assert np.allclose(scale.VariableScaling("max_abs").fit(from_numpy(spark, 0 * data)).pre(from_numpy(spark, 0 * data)).numpy(), 0)
    with pytest.raises(Exception, match="lacks a point"):
        scale.VectorScaling(scalars(spark, w[:4], "w")).pre(t).numpy()
    with pytest.raises(ValueError):
        scale.VariableScaling("other")
    with pytest.raises(RuntimeError):
        scale.VariableScaling("max_abs").pre(t)


def test_truncation(spark):
    basis = from_numpy(spark, np.random.default_rng(1).normal(size=(1, 10, 8)))
    assert np.array_equal(truncate.BasisSize(4).truncate(basis).numpy(), basis.numpy()[:, :, :4])
    for bad in (0, -1):
        with pytest.raises(ValueError):
            truncate.BasisSize(bad)
    with pytest.raises(ValueError):
        truncate.BasisSize(9).truncate(basis)
    sigma = np.random.default_rng(1).normal(size=8) ** 2  # in the order given, not sorted
    k = int(np.argmax(np.cumsum(sigma**2) / (sigma**2).sum() > 0.65)) + 1
    assert truncate.Energy(0.65).truncate(basis, list(sigma)).extents.n_s == k
    table = spark.createDataFrame([(i, float(s)) for i, s in enumerate(sigma)], "mode int, sigma double")
    assert truncate.energy_modes(table, 0.65).first()["k"] == k
    assert truncate.energy_modes(table, 1.0).first()["k"] == 1
    with pytest.warns(UserWarning):
        assert truncate.Energy(1.0).modes(list(sigma), 8) == 1


@pytest.mark.parametrize("block_rows,fan", [(8192, 256), (7, 256), (6, 4)])
def test_tsqr(spark, block_rows, fan):
    a = np.random.default_rng(7).normal(size=(1, 200, 5))
    a -= a.mean(axis=2, keepdims=True)  # rank 4
    t = from_numpy(spark, a)
    t = type(t)(t.rows.repartition(3), t.extents)
    factored = linalg.Tsqr(t, block_rows, fan)
    u, s, vt = factored.svd()
    full = u.numpy()[0]
    assert np.abs(full.T @ full - np.eye(5)).max() < 1e-12
    assert np.allclose(full * s @ vt, a[0], atol=1e-12)
    assert np.allclose(s, np.linalg.svd(a[0], compute_uv=False), atol=1e-12)
    q = factored.q().numpy()[0]
    assert np.abs(q.T @ q - np.eye(5)).max() < 1e-12
    assert np.allclose(q @ factored.r, a[0], atol=1e-12)


def test_fewer_rows_than_columns(spark):
    a = np.random.default_rng(8).normal(size=(1, 3, 5))
    u, s, vt = linalg.Tsqr(from_numpy(spark, a)).svd()
    assert np.allclose(u.numpy()[0] * s @ vt, a[0])


def test_method_of_snapshots(spark):
    a = np.concatenate([np.random.default_rng(k).normal(size=(n, 5)) for k, n in enumerate((9, 15, 9))])[None]
    t = from_numpy(spark, a)
    u, s = linalg.decompose(t, "gram")
    expected_u, expected_s, _ = np.linalg.svd(a[0], full_matrices=False)
    assert np.allclose(s, expected_s)
    assert np.allclose(np.abs(u.numpy()[0]), np.abs(expected_u))
    low, s = linalg.svd_gram(from_numpy(spark, np.repeat(a[:, :, :1], 3, axis=2)))
    assert len(s) == 1 and low.extents.n_s == 1


def test_orthogonalizers(spark):
    a, w = np.random.default_rng(1).normal(size=(1, 10, 2)), np.abs(np.random.default_rng(2).normal(size=(1, 10)))
    for qr in ("tsqr", "gram", lambda t: linalg.svd_tsqr(t)[0]):
        q = EuclideanL2(qr).orthogonalize(from_numpy(spark, a)).numpy()[0]
        assert np.allclose(q.T @ q, np.eye(2))
        q = WeightedL2(scalars(spark, w, "w"), qr).orthogonalize(from_numpy(spark, a)).numpy()[0]
        assert np.allclose(q.T @ np.diag(w[0]) @ q, np.eye(2))
    with pytest.raises(Exception, match="positive weight"):
        WeightedL2(scalars(spark, 0 * w, "w")).orthogonalize(from_numpy(spark, a)).numpy()


def test_pod_with_everything(spark):
    data = np.random.default_rng(11).normal(size=(3, 8, 6))
    w = np.abs(np.random.default_rng(12).normal(size=(3, 8)))
    t = from_numpy(spark, data)
    space = pod_space(t, truncate.BasisSize(3), shift.average_shift(t), WeightedL2(scalars(spark, w, "w")), scale.VariableScaling("max_abs"))
    centred = data - data.mean(axis=2, keepdims=True)
    by = np.abs(centred).max(axis=(1, 2))[:, None, None]
    u = sign_fixed(np.linalg.svd((centred / by).reshape(24, 6), full_matrices=False)[0])[:, :3]
    scaled = np.sqrt(w.reshape(24, 1)) * (u.reshape(3, 8, 3) * by).reshape(24, 3)
    q, r = np.linalg.qr(scaled)
    expected = q * np.where(np.diag(r) < 0, -1, 1) / np.sqrt(w.reshape(24, 1))
    assert np.allclose(space.basis.numpy().reshape(24, 3), expected)
    assert tuple(space.extents) == (3, 8, 3)
    assert np.allclose(table_of(space.shift, (3, 8)), data.mean(axis=2))


def test_dictionary_and_injected_svd(spark):
    data = np.random.default_rng(13).normal(size=(3, 8, 6))
    t = from_numpy(spark, data)
    centred = dictionary_space(t, shift.average_shift(t), EuclideanL2())
    q = centred.basis.numpy().reshape(24, 6)
    assert np.allclose(q.T @ q, np.eye(6))
    fake = pod_space(t, svd=lambda s: (s.with_values(s.rows["v"], 6), np.ones(6)), sign="raw")
    assert np.array_equal(fake.basis.numpy(), data)


def test_composites(spark):
    data = np.random.default_rng(14).normal(size=(5, 8, 4))
    parts, ks, spaces = [(0, 2), (2, 4), (4, 5)], (3, 2, 4), []
    for (a, b), k in zip(parts, ks):
        t = from_numpy(spark, data[a:b, :, :k])
        spaces.append(dictionary_space(t, shift.average_shift(t)))
    both = CompositeSpace(spaces)
    expected, mode = np.zeros((5, 8, 9)), 0
    for (a, b), k in zip(parts, ks):
        expected[a:b, :, mode : mode + k] = data[a:b, :, :k] - data[a:b, :, :k].mean(axis=2, keepdims=True)
        mode += k
    assert tuple(both.extents) == (5, 8, 9)
    assert np.allclose(both.basis().numpy(), expected)
    compact = {(r["var"], r["x"], r["mode"]): r["val"] for r in both.compact_basis().collect()}
    assert len(compact) == 8 * (2 * 3 + 2 * 2 + 4) and all(np.isclose(expected[k], v) for k, v in compact.items())
    assert np.allclose(table_of(both.shift(), (5, 8)), np.concatenate([data[a:b, :, :k].mean(axis=2) for (a, b), k in zip(parts, ks)]))
    assert len(both.compact_blocks()[0]) == 3
    with pytest.raises(ValueError):
        CompositeSpace([spaces[0], dictionary_space(from_numpy(spark, data[:, :4]))])


def test_sinks(spark, tmp_path, data):
    t = from_numpy(spark, data)
    space = dictionary_space(t, shift.average_shift(t))
    for compress in (True, False):
        path = str(tmp_path / f"space{compress}")
        sinks.write_space(space, path, compress)
        again = sinks.read_space(spark, path, space.extents)
        assert np.allclose(again.basis.numpy(), space.basis.numpy())
        sinks.export_npz(space, path + ".npz", compress)
        held = np.load(path + ".npz")
        assert np.allclose(held["basis"], space.basis.numpy()) and np.allclose(held["shift"], data.mean(axis=2))
    assert sinks.field_names(1, 10, ["p"])[:3] == ["u0_p", "phi_p_01", "phi_p_02"]
    with pytest.raises(ValueError):
        sinks.field_names(2, 3, ["p"])
    fields = sinks.nodal_fields(space).orderBy("x").toPandas()
    assert list(fields.columns)[:3] == ["x", "u0_0", "phi_0_1"] and np.allclose(fields["phi_2_5"], space.basis.numpy()[2, :, 4])


def test_extents_unpack():
    assert tuple(Extents(1, 2, 3)) == (1, 2, 3)


def test_written_tables_can_be_dropped(spark):
    again = written(spark.range(5).selectExpr("id as x", "'text' as t"))
    assert again.count() == 5 and [r["x"] for r in again.orderBy("x").collect()] == list(range(5))
    assert drop_written(spark) >= 1 and drop_written(spark) == 0


class Fields:
    """A mesh writer that remembers."""

    def __init__(self):
        self.names, self.values, self.closed = [], {}, False

    def define(self, names):
        self.names = list(names)

    def put(self, name, step, values):
        self.values[name] = (step, values)

    def close(self):
        self.closed = True


def test_mesh_fields_are_written(spark):
    from spanforge.operators import shift, space
    from spanforge.sources import sinks

    data = np.random.default_rng(11).normal(size=(2, 6, 3))
    t = from_numpy(spark, data)
    own, writer = space.dictionary_space(t, shift.average_shift(t)), Fields()
    sinks.export_mesh_fields(own, writer, ["a", "b"])
    assert writer.closed and writer.names == ["u0_a", "phi_a_1", "phi_a_2", "phi_a_3", "u0_b", "phi_b_1", "phi_b_2", "phi_b_3"]
    mean = data.mean(axis=2)
    for v, name in enumerate("ab"):
        assert writer.values[f"u0_{name}"][0] == 1 and np.allclose(writer.values[f"u0_{name}"][1], mean[v])
        for k in range(3):
            assert np.allclose(writer.values[f"phi_{name}_{k + 1}"][1], data[v, :, k] - mean[v])


def test_hdf5_export(spark, tmp_path, monkeypatch):
    """With h5py where it is installed; else a stand-in with the two calls that are made."""
    import sys
    import types

    from spanforge.operators import shift, space
    from spanforge.sources import sinks

    t = from_numpy(spark, np.random.default_rng(12).normal(size=(2, 4, 3)))
    own, held = space.dictionary_space(t, shift.average_shift(t)), {}
    try:
        import h5py
    except ImportError:

        class File:
            def __init__(self, path, mode):
                assert mode == "w"

            def __enter__(self):
                return self

            def __exit__(self, *error):
                return False

            def create_dataset(self, name, data):
                held[name] = np.array(data)

        monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=File))
        sinks.export_hdf5(own, str(tmp_path / "space.h5"))
    else:
        sinks.export_hdf5(own, str(tmp_path / "space.h5"))
        with h5py.File(tmp_path / "space.h5") as source:
            held = {k: source[k][:] for k in ("shift", "basis")}
    assert np.allclose(held["basis"], own.basis.numpy()) and held["shift"].shape == (2, 4)
    assert np.allclose(held["basis"] + held["shift"][:, :, None], t.numpy())


def test_tables_since_a_mark_are_dropped(spark):
    from spanforge.plans import storage

    first = written(spark.range(3))
    mark = storage.written_so_far()
    gone, kept = written(spark.range(4)), written(spark.range(5))
    assert storage.drop_written(spark, mark, keep=kept) == 1 and storage.written_so_far() == mark + 1
    assert first.count() == 3 and kept.count() == 5
    with pytest.raises(Exception, match="(?i)not.*exist"):
        gone.count()
