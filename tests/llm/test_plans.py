"""Shapes of plans: native operators run no Python, none runs a cross join."""

import pytest
from comparing import SMALL

from sparsewell.llm import linededup, mixing, quality, queries


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_quality_rules", "op8_mixing"])
def test_native_queries_run_no_python(spark, name):
    text = plan(queries.queries()[name](spark, SMALL))
    assert not any(word in text for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_native_parts_run_no_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for part in (linededup.windows(linededup.line_hashes(docs)), quality.features(docs, {"en": ["the", "of"]}), mixing.sizes(docs), mixing.mixed_documents(docs)):
        assert not any(word in plan(part) for word in ("Python", "Pandas", "Arrow"))


def test_the_schedule_joins_by_cell(spark):
    shares = spark.createDataFrame([(0, 2.0), (1, 1.0)], "sid int, target double")
    text = plan(mixing.schedule(spark, shares, 1, 100))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
