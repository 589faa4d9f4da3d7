"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from loomwork.catalog import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(text, r)) for r in df[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, D).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got) and not got.columns.duplicated().any()
