"""Queries of the training-data operators against DuckDB where SQL can say the same."""

import pytest
from oracle import compare

from prismcube.llm import queries


@pytest.mark.parametrize("name", list(queries.catalog.sql))
def test_matches_sql(spark, name):
    assert compare(spark, name, queries.catalog.queries[name], queries.catalog.sql[name], "sf0.001") == ""


def test_all_are_registered():
    import __spark_entry__ as entry

    assert set(queries.catalog.queries) <= set(entry.queries())
