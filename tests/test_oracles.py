"""Every query with an oracle, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from symgraph.oracles import ORACLES
from symgraph.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "~"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 9))
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def rows(df):
    return sorted(tuple(map(_plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, duck):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_impact_order_is_the_locale(spark):
    from pyspark.sql import functions as F

    names = ["B", "a", "A", "b", "_z"]
    df = spark.createDataFrame([(n,) for n in names], "file string")
    assert [r.file for r in df.orderBy(F.collate("file", "UNICODE")).collect()] == ["_z", "a", "A", "b", "B"]
