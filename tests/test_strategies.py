"""All strategies give the same rows; properties of rankings; shapes of plans."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparsewell.functions.encode import to_dense
from sparsewell.operators import index, metrics, query, score
from sparsewell.operators.topk import top_k
from sparsewell.plans.retrieve import retrieve
from sparsewell.sources import synthetic

slow = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
weights = st.sampled_from([0.25, 0.5, 1.0, 2.0, 3.0])
postings = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 6), weights), min_size=1, max_size=40)
queries = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 7), weights), min_size=1, max_size=12)


def rows(run):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in run.collect())


def by_hand(p, q, k):
    sums = {}
    for i, t, w in q:
        for d, u, v in p:
            if t == u:
                sums[i, d] = sums.get((i, d), 0) + w * v
    out = []
    for i in {i for i, _ in sums}:
        best = sorted((-s, d) for (j, d), s in sums.items() if j == i)[:k]
        out += [(i, n + 1, d, -s) for n, (s, d) in enumerate(best)]
    return sorted(out)


@slow
@given(p=postings, q=queries, k=st.integers(1, 15), chunk=st.integers(1, 20))
def test_strategies_agree(spark, p, q, k, chunk):
    pf = spark.createDataFrame(p, "doc_id long, term int, weight float")
    qf = spark.createDataFrame(q, "query_id long, term int, weight float")
    want = by_hand(p, q, k)
    assert rows(score.scatter(qf, pf, k)) == want
    assert rows(score.docparallel(qf, score.by_document(pf, 3), k)) == want
    assert rows(score.queryparallel(qf, pf, k)) == want
    assert rows(score.chunked(qf, pf, k, chunk)) == want
    assert rows(score.compacted(qf, pf, k, chunk)) == want
    dense = to_dense(qf.withColumnRenamed("query_id", "doc_id"), 8).withColumnRenamed("doc_id", "query_id")
    assert rows(score.dense(dense, to_dense(pf, 8), k)) == want


@pytest.fixture(scope="module")
def data(spark):
    p = synthetic.documents(spark, 300, 20, 80).cache()
    q = synthetic.queries(spark, 8, 80, mean_terms=8).cache()
    return p, q


def test_a_shorter_list_is_a_prefix(data):
    p, q = data
    long = rows(score.scatter(q, p, 20))
    assert rows(score.scatter(q, p, 5)) == [r for r in long if r[1] <= 5]


def test_recall_grows_with_width(data):
    p, q = data
    exact = score.scatter(q, p, 10).cache()
    found = [metrics.recall_vs_exact(exact, score.scatter(query.truncated(q, w), p, 10), 10).first()[0] for w in (1, 3, 6, None)]
    exact.unpersist()  # else later plans read it
    assert found == sorted(found) and found[-1] == 1.0


def test_retrieve_strategies(spark, data):
    p, q = data
    i = index.build_index(p, spark.range(300).withColumnRenamed("id", "doc_id"))
    want = rows(retrieve(q, i, 10))
    for strategy in ("scatter", "queryparallel", "chunked", "sharded", "compacted"):
        assert rows(retrieve(q, i, 10, strategy, chunk=64)) == want
    assert rows(retrieve(q, i, 10, prune="terms", prune_ratio=0.0)) == want
    with pytest.raises(ValueError, match="strategy"):
        retrieve(q, i, strategy="magic")
    with pytest.raises(ValueError, match="prune"):
        retrieve(q, i, prune="magic")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_limited_before_the_exchange(data):
    p, q = data
    assert plan(score.scatter(q, p, 10)).count("WindowGroupLimit") == 2


def test_a_large_k_raises_the_limit(spark, data):
    p, q = data
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    try:
        assert "WindowGroupLimit" in plan(top_k(score.scores(q, p), 2000))
    finally:
        spark.conf.set(name, "1000")


def test_no_python_and_a_broadcast_of_the_queries(data):
    p, q = data
    text = plan(score.scatter(q, p, 10))
    assert "BroadcastHashJoin" in text and "Python" not in text and "Arrow" not in text


def test_clustered_postings_sum_without_exchange(spark, data):
    p, q = data
    i = score.by_document(p, 4)
    scatter, clustered = plan(score.scatter(q, p, 10)), plan(score.docparallel(q, i, 10))
    assert "hashpartitioning(query_id" in scatter
    assert not any("hashpartitioning(query_id" in x and "doc_id" in x.split("hashpartitioning", 1)[1][:60] for x in clustered.splitlines())


def test_large_query_side_is_not_broadcast(data):
    _, q = data
    assert score.small(q, 10**9) is q
