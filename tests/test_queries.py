"""Every query of the core that SQL can express, against DuckDB."""

import pytest
from oracle import compare

import __spark_entry__ as entry
from prismcube.plans import cubes, problems

CASES = [(n, c.queries[n], c.sql[n]) for c in (problems.catalog, cubes.catalog) for n in c.sql]


@pytest.mark.parametrize("name,run,sql", CASES, ids=[c[0] for c in CASES])
def test_matches_sql(spark, name, run, sql):
    assert compare(spark, name, run, sql, "sf0.001") == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["type", "time", "count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
