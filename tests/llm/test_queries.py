"""The operators' queries against their SQL on the smallest tables."""

import pytest

from loomstream.llm import queries

from ..compare import SF, same, tables


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    df = queries.QUERIES[name](spark, SF)
    same(df.collect(), df.columns, tables(), queries.SQL[name])
