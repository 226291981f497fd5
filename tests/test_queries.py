"""Every query of the claim graph against its SQL, and runs without one."""

import pytest
from oracle import compare

from claimloom.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, name):
    assert compare(spark, sf, name, QUERIES[name], ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["topic", "subtopic", "n_claims", "n_docs"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
