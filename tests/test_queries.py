"""Every registered query of the engine's own operators against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lattica import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)

    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return float(f"{v:.10g}")
        return int(v) if hasattr(v, "item") and not isinstance(v, str) and float(v) == int(v) else v

    return cols, sorted((tuple(value(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    got = rows(catalog.queries()[name](spark, SF).toPandas())
    assert got == rows(duck.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_without_oracle(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
