"""Tasks hold a bounded number of pairs, however many documents and queries there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsewell.operators import few, query, score
from sparsewell.plans.inputs import Tables
from sparsewell.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_pairs_of_a_task_are_bounded(spark):
    cores = spark.sparkContext.defaultParallelism
    for docs, queries in ((0, 0), (1, 1), (10_000, 200), (3_000_000, 200), (1000, 10**6)):
        n = score.partitions(spark, docs, queries)
        assert n >= 1 and docs * queries <= n * score.TASK_PAIRS
    assert score.partitions(spark, 10_000, 1) == min(2 * cores, 10) and score.partitions(spark, 200, 40) == 1


def test_texts_are_dealt_by_the_pairs_they_make(spark, monkeypatch):
    """Before, the planner merged partitions by bytes of text, down to one a core."""
    monkeypatch.setattr(score, "TASK_PAIRS", 100)
    t = Tables(spark, SMALL)
    assert t.parts() == 80  # 200 documents, 40 passages
    assert t.postings().rdd.getNumPartitions() == 80


def test_evaluation_keeps_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(score, "TASK_PAIRS", 100)
    for name in ("mrr_judged", "batched_topk", "recall_vs_exact_micro", "scatter_topk_padzero", "impact_topk"):
        assert "(doc_id#" in (plan := QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString())
        assert ", 80), REPARTITION_BY_NUM" in plan


def test_a_shard_is_no_task(spark, monkeypatch):
    """Before, the postings of each shard went to one task."""
    monkeypatch.setattr(score, "TASK_PAIRS", 100)
    plan = QUERIES["sharded_topk"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "hashpartitioning(chunk" in x]
    assert len(lines) == 1 and "REPARTITION" not in lines[0]  # after the limit of each task
    assert plan.index("WindowGroupLimit [chunk") < plan.index("hashpartitioning(chunk") < plan.rindex("WindowGroupLimit [chunk")


def test_sweep_reads_the_texts_once(spark):
    """Before, eight rankings each counted the words of all documents."""
    plan = QUERIES["query_width_sweep"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("documents.parquet") == 1


def test_bm25_exchanges_no_postings(spark, monkeypatch):
    """Before, all postings met their document frequencies, and then all scores their sums."""
    monkeypatch.setattr(score, "TASK_PAIRS", 100)
    plan = QUERIES["bm25_topk"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert "SortMergeJoin" not in plan and sum("doc_id" in x and "REPARTITION" not in x for x in dealt) == 0


@pytest.mark.parametrize("cells", [1 << 20, 30])
def test_few_queries_equal_joins(spark, monkeypatch, cells):
    rng = np.random.default_rng(3)
    weights = [0.25, 0.5, 1.0, 2.0]
    p = [(int(d), f"t{t}", float(rng.choice(weights)) * (-1 if d == 7 else 1)) for d in range(120) for t in np.unique(rng.integers(0, 25, 12))]
    q = [(int(i), f"t{t}", float(rng.choice(weights))) for i in range(9) for t in np.unique(rng.integers(0, 30, 10))]
    p, q = spark.createDataFrame(p, "doc_id long, term string, weight float"), spark.createDataFrame(q, "query_id long, term string, weight float")
    columns = ["query_id", "doc_id", "score", "rank"]
    got = few.top_k(q, p, 5, (None, 3)).cache()
    for width, cut in ((-1, q), (3, query.truncated(q, 3))):
        assert sorted(got.where(f"width = {width}").select(columns).collect()) == sorted(score.scatter(cut, p, 5).select(columns).collect())
    got.unpersist()
    one = few.Queries(q.withColumn("place", F.lit(1)).collect(), {f"t{t}": t for t in range(30)})
    monkeypatch.setattr(few, "CELLS", cells)
    docs = p.where("term <> 't99'").groupBy("doc_id").agg(F.collect_list(F.struct(F.substr("term", F.lit(2)).cast("long").alias("_id"), "weight")).alias("p")).toArrow().to_batches()
    found = sorted((r["query_id"], r["doc_id"], r["score"]) for b in few._rank(iter(docs), one, 5, [None]) for r in b.to_pylist())
    assert found == sorted(tuple(r)[:3] for r in score.scatter(q, p, 5).select(columns).collect())
