"""The SQL of the queries that have some, on the smallest tables and on odd pages."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from symgraph.llm import urls
from symgraph.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def rows(df):
    return sorted(tuple("~" if pd.isna(v) else str(int(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark):
    con = duckdb.connect()
    for t in "embeddings pages conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_aliases_in_sql(spark, tmp_path):
    link = '<link rel="canonical" href="{}">'.format
    pages = [(1, "http://a.fr/1", link("http://x.com/en/1")), (2, "http://a.fr/2", "<META content='0; url=/1' http-equiv=refresh>"), (3, "http://b.fr/d/1", link("2")), (4, "http://b.fr/d/2", link("http://example.com/en/7") + link("//q.com/en/8")), (5, None, None), (6, "http://c.fr", link("?q=1")), (7, "x://C.fr?q=1", link("http://h.org/es/")), (8, "http://e.fr/1", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/p")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/p/*.parquet'")
    got = urls.op4_urls(df).toPandas()
    assert rows(got) == rows(con.sql(urls.ORACLE).df())
    assert sorted(got[got.verdict == "block"].page_id) == [1, 2, 6, 7]


def test_mirrors_in_sql(spark, tmp_path):
    pages = [(1, "http://a.fr/1", "x"), (2, "http://x.com/en/9", "x"), (3, "http://b.fr/d", "y"), (4, "http://x.com/en/8", "y"), (5, "http://example.com/en/7", "y"), (6, None, "x"), (7, "http://c.fr", None), (8, "http://d.org/es/", "z"), (9, "http://e.fr", "z"), (9, "http://f.fr", "z")]
    df = spark.createDataFrame([(*p, "h", "t", 1) for p in pages], "page_id long, url string, html string, host string, tag string, component int")
    df.coalesce(1).write.parquet(f"{tmp_path}/p")
    con = duckdb.connect()
    con.sql(f"create view pages as select page_id, url, html from '{tmp_path}/p/*.parquet'")
    got = urls.op4_aliases(df).toPandas()
    assert rows(got) == rows(con.sql(urls.ALIASES).df())
    assert sorted(got[got.verdict == "block"].page_id) == [1, 2, 4, 8, 9, 9]
    assert urls.op4_aliases(df.limit(0)).count() == 0
