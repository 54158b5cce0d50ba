"""Every engine query against its SQL at the smallest scale."""

import duckdb
import numpy as np
import pytest

from spanforge import queries as engine
from spanforge.operators import ecsw

SF = "/root/testdata/sf0.001"
TABLES = "customer embeddings lineitem nation orders part region".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = engine.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(engine.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in expected.fetchall())


def test_every_order_is_run(spark, duck):
    found = engine.queries()["sampling_runs"](spark, SF).select("sample_idx").collect()
    assert sorted(r[0] for r in found) == sorted(r[0] for r in duck.sql("select o_orderkey from orders").fetchall())


def test_all_components_are_streamed(spark):
    found = engine.queries()["stream_gram_of_embeddings"](spark, SF).select("i", "j").collect()
    assert sorted(map(tuple, found)) == [(i, j) for i in range(64) for j in range(64)]


def test_mesh_meets_the_equations_of_all_snapshots(spark):
    mesh = {r["x"]: r["weight"] for r in engine.queries()["ecsw_nnls"](spark, SF).collect()}
    system = {r["x"]: np.array(r["col"]) for r in ecsw.linear_system(engine.scaled_t(spark, SF), engine.scaled_pair(spark, SF)).collect()}
    rhs = sum(system.values())
    assert len(rhs) == 14
    assert np.linalg.norm(sum(w * system[x] for x, w in mesh.items()) - rhs) <= 1.1e-4 * np.linalg.norm(rhs)


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_other_queries_run(spark, name):
    assert engine.queries()[name](spark, SF).count() > 0
