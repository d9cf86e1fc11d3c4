"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_runs(spark):
    found = entry.entry(spark)
    assert found.columns == ["county_fips_code", "county_name", "state",
                             "new_cases_per_10k_difference"]
    assert found.count() > 0


def test_every_check_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
