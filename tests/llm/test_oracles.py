"""The operators' queries against their SQL at the smallest scale."""

import duckdb
import pytest

from spanforge.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, expected = llm.queries()[name](spark, SF), duck.sql(llm.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(expected.columns) == columns
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, expected.project(", ".join(columns)).fetchall()))
