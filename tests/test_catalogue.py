"""Every registered query against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from veritab.plans import catalogue
from veritab.plans.sources_sql import TEST_TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value) or str(value) in ("NaT", "<NA>"):
        return None
    if isinstance(value, (bool, str)):
        return str(value)
    try:
        return f"{float(value):.6g}"
    except (TypeError, ValueError):
        return str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(str(plain(v)) for v in r) for r in frame[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.execute(ORACLES[name]).df())
    else:
        assert len(got.columns)
