"""Registered queries that SQL can express, on whole tables."""

import pytest
from comparing import SMALL, assert_same, connect

from sparsewell.llm import queries


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert_same(queries.queries()[name](spark, SMALL), con, queries.oracle_sql()[name])


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
