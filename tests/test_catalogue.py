"""Registered queries beside their SQL in DuckDB, on the smallest test tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import connect, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
NEED_SURFACES = {"surfaces_daily", "surface_quality", "surface_factors", "surface_coverage", "feature_rows", "supervised_windows", "grid_component_scores", "curated_quotes", "chain_against_trades"}
LLM = set(entry.llm_queries.QUERIES) if entry.llm_queries else set()

@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LLM))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, con.sql(entry.oracle_sql()[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - LLM))
def test_query_without_sql_runs(spark, name):
    """Every row is computed; the smallest tables are too thin for surfaces, whose queries may be empty there."""
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got.columns) and (len(got) or name in NEED_SURFACES)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
