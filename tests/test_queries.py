"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace.plans.oracles import ORACLES
from millrace.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    tidy = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(repr([tidy(v) for v in row]) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() == 3
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
