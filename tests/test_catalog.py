"""Every query with an oracle against DuckDB on the small tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
OWN = sorted(n for n in entry.queries() if not n.startswith("op") or not n[2:3].isdigit())
OWN = [n for n in OWN if n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return ""
        return repr(float(v)) if isinstance(v, float | np.floating) else str(v)

    out = df[sorted(df.columns)].map(text)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    pd.testing.assert_frame_equal(canonical(got), canonical(duck.execute(sql).fetchdf()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
