"""The driver's contract: every query of the engine against its oracle on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from penumbra.plans import catalogue

SMALL = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def canonical(f: pd.DataFrame) -> list[tuple]:
    cell = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted((tuple(map(cell, r)) for r in f[sorted(f.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
