"""Every registered query of the reference's operators beside its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from plumbline.plans import catalog
from tools.compare import TABLES, tidy

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.SQL:
        a, b = tidy(got), tidy(con.execute(catalog.SQL[name]).df())
        assert list(a.columns) == list(b.columns)
        assert len(a) == len(b)
        for c in a.columns:
            assert a[c].tolist() == b[c].tolist(), c
    else:
        assert len(got.columns)
