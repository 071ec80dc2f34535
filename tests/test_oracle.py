"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import oracle
import pytest

from stanzaflow.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, con, sf_dir, name):
    assert oracle.compare(catalog.QUERIES[name](spark, sf_dir), con, catalog.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0
