"""All pairs in blocks: the same rows as the joins, and no pair is exchanged."""

import numpy as np
import pytest

from sparsewell.operators import metrics, nearest, score
from sparsewell.operators.blockmax import blockmax
from sparsewell.operators.topk import top_k
from sparsewell.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())  # NaN equals itself


def vectors(seed, gap=1, copies=0, repeats=0, n=150, size=20):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, size)) < 0.4, rng.random((n, size)), 0)
    x[1 : 1 + copies] = x[0]
    out = [(int(i) * gap, int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return out + out[:repeats]


CASES = {"copies": {"copies": 60}, "gaps and repeated rows": {"gap": 1000, "repeats": 40}, "few": {"n": 4}}


@pytest.mark.parametrize("case", CASES)
def test_blocks_equal_joins(spark, monkeypatch, case):
    monkeypatch.setattr(nearest, "BLOCK_FLOATS", 400)  # many blocks, groups of few queries
    monkeypatch.setattr(nearest, "GROUP", 40)
    p = spark.createDataFrame(vectors(1, **CASES[case]), "doc_id long, term int, weight float").cache()
    q = p.withColumnRenamed("doc_id", "query_id")
    s = score.scores(q, p).where("score <> 0").cache()
    want = rows(score.scatter(q, p, 7).select("query_id", "doc_id", "score", "rank"))
    for chunk in (None, 8):
        assert rows(nearest.top_k(q, p, 7, chunk)) == want
    assert rows(nearest.blockmax(q, p, 7, 8)) == want
    assert rows(nearest.blockmax(q, p, 7, 8, 0.5)) == rows(blockmax(q, p, 7, 8, 0.5).select("query_id", "doc_id", "score", "rank"))
    assert rows(nearest.near_kth(q, p, 7, 0.1)) == rows(metrics.near_kth(s, top_k(s, 7), 0.1))
    assert rows(nearest.candidate_decay(q, p, 7, 8)) == rows(score.candidate_decay(q, p, 7, 8))
    p.unpersist(), s.unpersist()


def test_negative_and_not_finite_weights(spark):
    p = [(d, t, w) for d, t, w in vectors(2, n=60)]
    p = [(d, t, -w if d % 3 == 0 else w) for d, t, w in p] + [(100, 1, float("nan")), (101, 2, float("inf")), (102, 3, 1.0)]
    p = spark.createDataFrame(p, "doc_id long, term int, weight float")
    q = p.where("doc_id % 5 <> 1").withColumnRenamed("doc_id", "query_id")
    assert rows(nearest.top_k(q, p, 9)) == rows(score.scatter(q, p, 9).select("query_id", "doc_id", "score", "rank"))
    with pytest.raises(Exception, match="must not be negative"):
        nearest.blockmax(q, p, 9, 8).collect()


def test_dense_rows_of_one_id_stay_apart(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "doc_id long, dense array<float>")
    run = score.dense(d.withColumnRenamed("doc_id", "query_id"), d, 3)
    assert rows(run.select("query_id", "doc_id", "score", "rank")) == ["(1, 1, 0.5, 2)", "(1, 1, 0.5, 3)", "(1, 1, 1.0, 1)", "(2, 1, 0.5, 2)", "(2, 2, 1.0, 1)"]


def test_dense_has_no_limit_of_its_own(spark):
    n = 1 << 15
    d = spark.range(n + 1).selectExpr("id AS doc_id", "array(float(1), float(id % 7)) AS dense")
    run = score.dense(d.where("doc_id < 2").withColumnRenamed("doc_id", "query_id").unionByName(d.where("doc_id >= 2").selectExpr("doc_id AS query_id", "array(float(0), float(0)) AS dense")), d, 1)  # before, more than 2**30 pairs were refused
    assert rows(run.select("query_id", "doc_id", "score")) == ["(0, 0, 1.0)", "(1, 6, 7.0)"]


PAIRS = ["vector_topk", "self_match_removal", "evaluate_classes", "vector_chunked_topk", "strategies_identical", "near_kth", "candidate_decay", "blockmax_alpha_topk", "blockmax_topk", "chunk_size_sweep", "dense_topk", "densified_topk"]


@pytest.mark.parametrize("name", PAIRS)
def test_no_pair_of_vectors_is_joined(spark, name):
    """Before, a join by term made the pairs, and a sum by (query, document) held them all."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert not any("Join" in line and "term" in line for line in plan.splitlines())
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
