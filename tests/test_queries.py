import pytest

from mutalog.plans.catalog import ORACLES, QUERIES
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_known_counts(spark):
    counts = {"kv_all": 120, "kv_range": 75, "kv_all_from": 40, "kv_all_to": 5, "kv_ttl_all": 116, "kv_tombstones": 30, "kv_snapshot_gen": 123, "kv_range_inverted": 0}
    assert {n: QUERIES[n](spark, SF).count() for n in counts} == counts


def test_plans(spark):
    """Newest-per-key is limited before its shuffle, and nothing runs Python."""
    plan = lambda n: QUERIES[n](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan("kv_all")
    for n in QUERIES:
        assert "Python" not in plan(n) and "CartesianProduct" not in plan(n)
