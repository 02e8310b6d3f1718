"""Small collections with answers worked out by hand."""

import math

import pytest

from sparsewell.operators import index, metrics, query, score
from sparsewell.plans.retrieve import retrieve

POSTINGS = [(0, 1, 1.0), (0, 2, 2.0), (1, 1, 3.0), (2, 2, 1.0), (2, 3, 4.0), (3, 9, 5.0)]
QUERY = [(1, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0), (2, 77, 9.0)]


@pytest.fixture(scope="module")
def tables(spark):
    p = spark.createDataFrame(POSTINGS, "doc_id long, term long, weight float")
    q = spark.createDataFrame(QUERY, "query_id long, term long, weight float")
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    return p, q, docs


def got(run):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in run.collect())


def test_scatter_ignores_unknown_terms(tables):
    p, q, _ = tables
    assert got(score.scatter(q, p, 10)) == [(1, 1, 0, 5.0), (1, 2, 1, 3.0), (1, 3, 2, 2.0), (2, 1, 2, 4.0)]


def test_k_cuts_and_may_exceed_the_corpus(tables):
    p, q, _ = tables
    assert got(score.scatter(q, p, 2))[:2] == [(1, 1, 0, 5.0), (1, 2, 1, 3.0)]


def test_padding_with_zero(tables):
    p, q, docs = tables
    run = retrieve(q, index.SparseIndex(p, docs, index.term_stats(p)), 10, pad_zero=True)
    assert [x[2:] for x in got(run) if x[0] == 1] == [(0, 5.0), (1, 3.0), (2, 2.0), (3, 0.0), (4, 0.0)]
    assert [x[2:] for x in got(run) if x[0] == 2] == [(2, 4.0), (0, 0.0), (1, 0.0), (3, 0.0), (4, 0.0)]


def test_ties_by_least_document(spark, tables):
    p, q, _ = tables
    tied = p.unionByName(spark.createDataFrame([(3, 1, 3.0)], p.schema))
    assert [x[2] for x in got(score.scatter(q, tied, 10)) if x[0] == 1] == [0, 1, 3, 2]


def test_duplicates_add_up(spark, tables):
    p, q, _ = tables
    twice = p.unionByName(spark.createDataFrame([(0, 1, 1.0)], p.schema))
    assert got(score.scatter(q, twice, 1))[0] == (1, 1, 0, 6.0)


def test_truncation_keeps_the_heaviest(tables):
    p, q, _ = tables
    assert [x[2:] for x in got(score.scatter(query.truncated(q, 1), p, 10)) if x[0] == 1] == [(0, 4.0), (2, 2.0)]


def test_pruning(tables):
    p, q, _ = tables
    stats = index.term_stats(p)
    one = query.prune_by_terms(q.where("query_id = 1"), stats, 0.5)
    assert [r.term for r in one.collect()] == [2]
    assert query.prune_by_width(q.where("query_id = 1"), stats, 128, 0.5).count() == 2
    assert query.prune_by_bound(q.where("query_id = 1"), stats, 0.0).count() == 2


def test_statistics(tables):
    p, _, _ = tables
    rows = {r.term: (r.length, r.padded, r.offset, r.max_weight) for r in index.offsets(index.term_stats(p)).collect()}
    assert rows == {1: (2, 32, 0, 3.0), 2: (2, 32, 32, 2.0), 3: (1, 32, 64, 4.0), 9: (1, 32, 96, 5.0)}
    assert index.memory(index.term_stats(p)).first().overhead == 0.953125


def test_chunks_and_threshold(tables):
    p, q, _ = tables
    one = q.where("query_id = 1")
    for run in (score.chunked(one, p, 1, 2), score.compacted(one, p, 1, 2)):
        assert got(run) == [(1, 1, 0, 5.0)]
    decay = {r.chunk: (r.scored, r.candidates) for r in score.candidate_decay(one, p, 1, 2).collect()}
    assert decay == {0: (2, 1), 1: (1, 0)}


def test_unsorted_lists_raise(spark):
    bad = spark.createDataFrame([(1, 5, 0), (1, 3, 1)], "term long, doc_id long, position long")
    with pytest.raises(ValueError, match="1 posting lists"):
        index.check_sorted(bad)


@pytest.fixture(scope="module")
def run(spark):
    rows = [(1, d, 3.0 - d, d + 1) for d in (0, 1, 2)]
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank long")


def qrels(spark, grades):
    return spark.createDataFrame([(1, d, g) for d, g in grades.items()], "query_id long, doc_id long, relevance long")


def test_mrr_and_its_denominators(spark, run):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    assert metrics.mrr(run, qrels(spark, {1: 1})).first().mrr == 0.5
    assert metrics.mrr(run, qrels(spark, {1: 1}), denominator="all", queries=q).first().mrr == round(0.5 / 3, 6)
    with pytest.raises(ValueError, match="kind"):
        metrics.mrr(run, qrels(spark, {77: 1}), strict=True)


@pytest.mark.parametrize(("gain", "want"), [("linear", 0.669672), ("exponential", 0.659002)])
def test_ndcg(spark, run, gain, want):
    assert metrics.ndcg(run, qrels(spark, {1: 2, 2: 1}), 10, gain).first().ndcg == want


def test_negative_grades_gain_nothing(spark, run):
    dcg = 2 / math.log2(3)
    assert metrics.ndcg(run, qrels(spark, {1: 2, 2: -1})).first().ndcg == round(dcg / 2, 6)


def test_self_match(spark):
    r = spark.createDataFrame([(7, 7, 3.0, 1), (7, 1, 2.0, 2), (7, 3, 1.0, 3)], "query_id long, doc_id long, score double, rank long")
    assert [(x.doc_id, x["rank"]) for x in metrics.without_self(r).orderBy("rank").collect()] == [(1, 1), (3, 2)]


def test_repeated_documents_do_not_raise_ndcg(spark):
    r = spark.createDataFrame([(1, 0, 3.0, 1), (1, 0, 3.0, 2)], "query_id long, doc_id long, score double, rank long")
    assert metrics.ndcg(metrics.deduplicated(r), qrels(spark, {0: 1})).first().ndcg == 1.0
