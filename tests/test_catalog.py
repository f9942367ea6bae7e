"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import pandas as pd
import pytest

from graphloom.plans import catalog, source_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    if v is None or pd.isna(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(shown(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        assert rows(got) == rows(duck.execute(catalog.ORACLES[name]).df())


def test_stream_equals_batch(spark):
    a = catalog.QUERIES["session_fold"](spark, SF).toPandas()
    b = catalog.QUERIES["session_stream_fold"](spark, SF).toPandas()
    assert rows(a) == rows(b)
