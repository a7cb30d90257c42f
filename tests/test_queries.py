"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from loomstream.plans import queries as plans

from .compare import SF, same, tables


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_gives_what_its_sql_gives(spark, con, name):
    df = entry.queries()[name](spark, SF)
    same(df.collect(), df.columns, con, plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.Q) - set(plans.SQL)))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 1


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
