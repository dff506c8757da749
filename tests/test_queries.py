import os

import pytest

from leafstrata.plans.registry import ORACLE_SQL, QUERIES, UNCHECKED
from tests.check import same

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(QUERIES[name], ORACLE_SQL[name], spark, DATA)


@pytest.mark.parametrize("name", UNCHECKED)
def test_unchecked_query_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
