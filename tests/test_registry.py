"""Every registered query of the engine, on whole tables, against its SQL."""

import pytest
from comparing import SMALL, assert_same, connect

import __spark_entry__
from sparsewell.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SMALL), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_repeats(spark, name):
    a, b = (sorted(map(tuple, QUERIES[name](spark, SMALL).collect()), key=repr) for _ in range(2))
    assert a and a == b


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
