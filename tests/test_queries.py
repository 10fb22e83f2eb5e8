"""Every named query against its DuckDB twin, value by value."""

import pytest
from oracle import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from tagshift.catalog import QUERIES

# the optional part has its own tests
OWN = set(QUERIES)


@pytest.mark.parametrize("name", sorted(OWN & set(oracle_sql())))
def test_matches_duckdb(spark, sf_dir, name):
    with duck(sf_dir) as con:
        assert compare(queries()[name](spark, sf_dir), con, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(OWN - set(oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
