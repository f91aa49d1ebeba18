"""Every query with SQL equals it on the smallest tables (the driver compares them on larger ones)."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def names():
    from rowloom.session import local_session

    local_session(4, app="tests", shuffle="4")
    from rowloom.plans import catalogue

    return sorted(catalogue.ORACLES)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", names())
def test_equals_sql(spark, duck, name):
    from rowloom.plans import catalogue

    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
