"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera import plans

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else x


def rows(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("key", sorted(plans.QUERIES))
def test_query(spark, database, key):
    got = plans.QUERIES[key](spark, DATA).toPandas()
    if key in plans.SQL:
        expected = database.sql(plans.SQL[key]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)
    else:
        assert len(got.columns)
