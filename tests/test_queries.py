"""Every registered query against DuckDB on the same files."""

import pytest

import __spark_entry__ as entry
from docloom.plans import catalog
from tests.compare import check, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, con, name):
    sql = entry.oracle_sql()[name]
    assert check(spark, con, data, name, entry.queries()[name], sql) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["modname", "category", "n", "n_ref", "max_hops"]
