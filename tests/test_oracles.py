"""Each registered query with an oracle gives the rows that DuckDB gives for its SQL."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from venuelake.plans import registry

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = [f.removesuffix(".parquet") for f in sorted(os.listdir(DATA))] if os.path.isdir(DATA) else []


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not TABLES, reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    if name not in registry.ORACLES:
        assert got.count() > 0
        return
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


def test_entry_is_the_inventory(spark):
    assert entry.entry(spark).columns == list(registry.PAGE)
