"""Every query with an oracle gives the rows of its SQL on the smallest tables; the others run."""

import os

import duckdb
import pandas as pd
import pytest

from boxloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if hasattr(x, "dtype") and getattr(x, "ndim", 0) or isinstance(x, (list, tuple)):
        return str([value(y) for y in x])
    try:
        return repr(round(float(x), 6) + 0.0)
    except (TypeError, ValueError):
        return str(x)


def rows(frame):
    return sorted(tuple(value(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
