"""The operators that SQL can express give the rows that DuckDB gives."""

import os

import duckdb
import pytest

from tests.test_oracles import DATA, TABLES, rows
from venuelake.llm import queries


@pytest.mark.skipif(not TABLES, reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_operator_matches_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(DATA, t)}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)
