"""Queries over the training-data operators against their SQL, and that all are registered."""

import pytest
from oracle import compare

import __spark_entry__ as entry
from claimloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    assert compare(spark, sf, name, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def test_all_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
