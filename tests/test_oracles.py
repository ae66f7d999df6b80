"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from compare import same
from corpuscle.plans import linking, tables

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PARTS = (linking, tables)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", [n for p in PARTS for n in p.QUERIES])
def test_query(spark, name):
    query = next(p.QUERIES[name] for p in PARTS if name in p.QUERIES)
    sql = next((p.ORACLES[name] for p in PARTS if name in p.ORACLES), None)
    equal, rows, _, diff = same(spark, DATA, query, sql)
    assert equal in (True, None) and rows > 0, diff
