"""Every query of the catalogue against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from siltstone.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def rows(frame: pd.DataFrame) -> list:
    def show(v):
        if pd.isna(v):
            return None
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted((tuple(map(show, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
    assert len(catalogue.QUERIES) == 37


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_matches_sql(spark, duck, name):
    got, expected = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
