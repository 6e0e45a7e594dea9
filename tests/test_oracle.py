"""Every registered query against its SQL, and the rows-only smoke check."""

import pytest
from compare import difference, duck
from conftest import SF

import __spark_entry__ as entry
from stepview.plans.oracles import oracle_sql
from stepview.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert difference(spark, con, SF, QUERIES[name], oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert QUERIES.keys() == oracle_sql().keys() and entry.queries().items() >= QUERIES.items()


def test_entry(spark):
    assert entry.entry(spark).head() is not None
