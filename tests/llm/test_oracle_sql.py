"""Queries with SQL against it, over the smallest test tables."""

import pytest
from oracle_check import compare, duck

from readpaths.llm import queries as Q

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    ok, said = compare(Q.queries()[name](spark, SF_DIR), duck(SF_DIR), Q.oracle_sql()[name])
    assert ok, said
