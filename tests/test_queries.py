"""Every record query against its SQL on DuckDB, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import samples.layouts  # noqa: F401  registers its queries
from passaura.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(df):
    show = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else x if isinstance(x, str) else round(float(x), 9)
    return sorted((tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, sf_dir, name):
    a, b = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert plain(a) == plain(b) and len(a)
