"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import pytest

from conftest import SF_SMALL
from verdant.plans.catalog import ORACLE, QUERIES
from verdant.plans.compare import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    res = compare(QUERIES[name](spark, SF_SMALL), ORACLE[name], duck)
    assert res["ok"], res


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert "rank" in df.columns and "esg_score" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
