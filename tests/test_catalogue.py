import pytest
from tests.compare import differences

from firegrid.plans.validated import ORACLES, QUERIES

SLOW: set[str] = set()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_equals_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", name, QUERIES[name], ORACLES[name]) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
