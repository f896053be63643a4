"""Every catalog query against its SQL on the smallest test data."""

import pytest

from moodmill.catalog import all_queries
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"
SLOW = {"run_full_training"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - SLOW))
def test_query_matches_sql(spark, duck, name):
    assert difference(spark, duck, all_queries()[name], SF_DIR) is None


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_queries()) <= set(entry.queries())
    assert set(all_queries()) - set(entry.oracle_sql()) == {"distill_student", "run_full_training"}
