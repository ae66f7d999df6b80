"""The queries of the subpackage on the smallest tables."""

import os

import pytest

from compare import same
from corpuscle.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "p2_found": [("field_name", "string"), ("item", "bigint")],
    "p4_found": [("ref_table", "string"), ("text_a", "string"), ("text_b", "string")],
    "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("subject", "string")],
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    equal, _, _, diff = same(spark, DATA, queries.QUERIES[name], queries.ORACLES.get(name))
    assert equal in (True, None), diff
    if name in COLUMNS:
        assert queries.QUERIES[name](spark, DATA).dtypes == COLUMNS[name]
