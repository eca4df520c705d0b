"""Queries that SQL can express, against their DuckDB SQL."""
import pytest

from markscope.llm import queries as Q
from tests.oracle_check import compare


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle_equal(spark, name):
    problems, n = compare(spark, name, "/root/testdata/sf0.01", Q.QUERIES[name], Q.ORACLE[name])
    assert problems == [] and n > 0
