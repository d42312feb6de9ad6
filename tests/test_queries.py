"""Every query with SQL against DuckDB on small tables."""

import pytest

import __spark_entry__ as entry
import verify
from allelo.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return verify.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf, name):
    assert ": ok" in verify.compare(spark, con, name, sf)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
