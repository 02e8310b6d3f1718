"""Mixing sources of which some are far smaller than the others."""

from collections import Counter

import duckdb
import pytest

from comparing import rows as sorted_rows

from sparsewell.llm import mixing


@pytest.mark.parametrize("sizes", [(50_000, 30_000, 20, 80, 6), (50_000, 30_000, 20_000, 2, 1), (1000, 100_000, 400, 30, 100_000)])
def test_every_source_comes_near_its_target(spark, sizes):
    rows = []
    for k, n in enumerate(sizes):
        step = 50 if n > 1000 else 2
        rows += [(len(rows) + i, " ".join(["w"] * min(step, n - at)), f"s{k}") for i, at in enumerate(range(0, n, step))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    documents = docs.toPandas()
    con.register("documents", documents)
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted_rows(mixing.mix(docs).toPandas(), columns) == sorted_rows(con.sql(mixing.ORACLE_SQL).df(), columns)
    out = mixing.mix(docs).collect()
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for source, target in {r.source: r.target for r in out}.items():
        assert abs(taken[source] - target) <= max(0.5, mixing.NEAR * target), (source, taken[source], target)
    assert mixing.mixed_documents(docs).select("source").distinct().count() == len(sizes)


def test_many_sources_are_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 17), f"s{i % 23}") for i in range(400)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want
