"""Collections, batches, block-max pruning, guards and the one-pass evaluation."""

import json

import pytest
from comparing import SMALL

from sparsewell.__main__ import main
from sparsewell.functions.encode import model_postings
from sparsewell.operators import metrics, profile, query, score
from sparsewell.operators.blockmax import blockmax
from sparsewell.operators.index import build_index
from sparsewell.plans.retrieve import retrieve, retrieve_in_batches
from sparsewell.sources import synthetic, vectors
from sparsewell.sources.collection import read_collection


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("collection")
    corpus = [{"_id": f"d{i}", "title": "A title" if i % 2 else "", "text": f"word{i} common text"} for i in range(6)]
    queries = [{"_id": "q1", "text": "word1 common"}, {"_id": "q2", "text": "word4"}, {"_id": "q3", "text": "nothing judged"}, {"_id": "q4", "text": "word2"}]
    for name, rows in (("corpus", corpus), ("queries", queries)):
        (path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (path / "qrels").mkdir()
    (path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td3\t1\nq2\td4\t1\nq4\td2\t0\n")
    return str(path)


def test_read_collection(spark, folder):
    c = read_collection(spark, folder)
    assert {r.doc_id: r.text for r in c.documents.collect()}["d1"] == "A title word1 common text"
    assert {r.query_id for r in c.queries.collect()} == {"q1", "q2", "q4"} and c.qrels.count() == 4
    few = read_collection(spark, folder, max_docs=3)
    assert few.documents.count() == 3 and {(r.query_id, r.doc_id) for r in few.qrels.collect()} == {("q1", "d1"), ("q4", "d2")}
    assert {r.query_id for r in few.queries.collect()} == {"q1", "q4"}


@pytest.mark.parametrize("weights", ["logtf", "bm25"])
def test_collection_command(folder, capsys, weights):
    main(["collection", "--folder", folder, "--name", "mine", "--k", "1", "10", "--weights", weights, "--max-queries", "2"])
    text = capsys.readouterr().out
    assert text.count("|2        |") == 2
    assert "mine" in text and "|1  |" in text and "|10 |" in text


def test_batches_equal_one_ranking(spark, tmp_path):
    p = synthetic.exact_documents(spark, 80, 12, 101)
    q = p.where("doc_id < 25").withColumnRenamed("doc_id", "query_id")
    index = build_index(p, p.select("doc_id").distinct())
    rows = lambda df: sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in df.collect())
    want = rows(retrieve(q, index, 5))
    assert rows(retrieve_in_batches(q, index, 5, 4, str(tmp_path / "r"))) == want
    assert sorted(x.name for x in (tmp_path / "r").iterdir()) == [f"batch={b}" for b in range(7)]
    assert rows(retrieve_in_batches(q, index, 5, 4, str(tmp_path / "r"))) == want  # nothing is computed again
    sizes = query.batches(q, 4).select("query_id", "batch").distinct().groupBy("batch").count().collect()
    assert sorted(r["count"] for r in sizes) == [1, 4, 4, 4, 4, 4, 4]


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_block_max_is_exact(spark, block):
    p = synthetic.documents(spark, 90, 12, 60)
    p = p.groupBy("doc_id", "term").agg({"weight": "max"}).withColumnRenamed("max(weight)", "weight")
    q = p.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "query_id")
    rows = lambda df: sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in df.collect())
    want = rows(score.scatter(q, p, 5))
    assert rows(blockmax(q, p, 5, block)) == want
    assert rows(score.chunked(q, p, 5, block)) == rows(score.compacted(q, p, 5, block)) == want


def test_negative_weights_are_refused(spark):
    p = spark.createDataFrame([(1, "a", -1.0), (2, "a", 1.0)], "doc_id long, term string, weight float")
    q = spark.createDataFrame([(1, "a", 1.0)], "query_id long, term string, weight float")
    for run in (score.compacted(q, p, 2, 10), blockmax(q, p, 2, 10), query.prune_by_bound(q.withColumn("weight", -q.weight), p.groupBy("term").agg({"weight": "max"}).withColumnRenamed("max(weight)", "max_weight"), 1.0)):
        with pytest.raises(Exception, match="must not be negative"):
            run.collect()
    assert query.uncut(q, 1).count() == 1
    with pytest.raises(Exception, match="more than 0 terms"):
        query.uncut(q, 0).collect()
    with pytest.raises(ValueError, match="too many"):
        score.dense(q, p, 1, max_pairs=1)


def test_one_pass_equals_single_metrics(spark):
    rel = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 1), (2, 9, 3), (3, 5, 0), (4, 1, 1)], "query_id long, doc_id long, relevance long")
    run = spark.createDataFrame([(1, 2, 1), (1, 7, 2), (1, 1, 3), (2, 8, 1), (2, 9, 2), (3, 5, 1), (5, 1, 1)], "query_id long, doc_id long, rank long").selectExpr("*", "1D / rank AS score")
    queries = spark.range(1, 7).withColumnRenamed("id", "query_id")
    for gain in ("linear", "exponential"):
        for denominator, n in (("judged", 3), ("graded", 4), ("all", 6)):
            for r in metrics.evaluate(run, rel, (1, 2, 3), gain, denominator, queries).collect():
                a, b, c = metrics.mrr(run, rel, r.k, denominator, queries), metrics.ndcg(run, rel, r.k, gain, denominator, queries), metrics.recall(run, rel, r.k, denominator, queries)
                assert (r.mrr, r.ndcg, r.recall, r.n_queries) == (a.first().mrr, b.first().ndcg, c.first().recall, n)


def test_evaluation_ranks_once(spark):
    rel = spark.createDataFrame([(1, 1, 2)], "query_id long, doc_id long, relevance long")
    run = spark.range(9).selectExpr("id AS query_id", "id AS doc_id", "1L AS rank", "uuid() AS mark")
    text = metrics.evaluate(run, rel, (1, 5, 10))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Range (0, 9") == 1


def test_repeated_documents_are_refused(spark):
    run = spark.createDataFrame([(1, 2, 1), (1, 2, 2)], "query_id long, doc_id long, rank long").selectExpr("*", "1D AS score")
    with pytest.raises(Exception, match="twice"):
        metrics.without_repeats(run).collect()
    assert metrics.without_repeats(metrics.deduplicated(run)).count() == 1


def test_the_last_known_query_stays(spark):
    lines = ['{"qid": "a", "vector": {"x": 1.0}}', '{"qid": "a", "vector": {"x": 2.0, "zz": 1}}', '{"qid": "a", "vector": {"zz": 3}}', '{"qid": "b", "vector": {"zz": 3}}']
    vocab = spark.createDataFrame([("x", 4)], "token string, term_id int")
    got = vectors.query_vectors(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "line string, ordinal long"), vocab)
    assert [(r.id, r.term_id, r.weight) for r in got.collect()] == [("a", 4, 2.0)]


def test_exact_documents(spark):
    rows = synthetic.exact_documents(spark, 20, 30, 100).collect()
    for d in range(20):
        terms = [r.term for r in rows if r.doc_id == d]
        assert len(terms) == len(set(terms)) == 30 and max(terms) < 97
    with pytest.raises(ValueError, match="larger vocabulary"):
        synthetic.exact_documents(spark, 1, 98, 100)


def test_model_postings(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, "c")], "doc_id long, text string")
    got = model_postings(docs, "doc_id", "text", lambda texts: texts.map(lambda t: {w: float(ord(w)) - 97.0 for w in t.split()}))
    assert sorted((r.doc_id, r.term, r.weight) for r in got.collect()) == [(1, "b", 1.0), (3, "c", 2.0)]


def test_work_counts_what_a_query_costs(spark):
    w = profile.work(spark, lambda: spark.range(200_000).repartition(4).selectExpr("sum(sqrt(id))"))
    assert w["cpu_s"] > 0 and w["run_s"] > 0 and w["shuffled_mb"] > 0.1 and 0 < w["cpu_per_wall"] < 8


def test_sweep_command(tmp_path):
    main(["sweep", "--vary", "strategy", "--values", "auto", "blockmax", "none", "--docs", "300", "--queries", "5", "--terms", "20", "--vocab", "500", "--k", "5", "--repeats", "1", "--out", str(tmp_path / "r")])
    rows = [json.loads(x) for x in (tmp_path / "r").read_text().splitlines()]
    assert [r["strategy"] for r in rows] == ["auto", "blockmax", "none"] and "error" in rows[2]
    assert all(r["overlap"] == 1 and r["median"] > 0 and r["cpu_s"] > 0 and r["docs"] == 300 for r in rows[:2])
    main(["sweep", "--vary", "max_terms", "--values", "2", "--docs", "300", "--queries", "5", "--vocab", "500", "--repeats", "1", "--out", str(tmp_path / "s")])
    assert json.loads((tmp_path / "s").read_text())["overlap"] < 1


def test_verify_command(capsys):
    main(["verify", "--tables", SMALL, "--only", "scatter_topk", "qrels_tsv"])
    assert "scatter_topk: equal" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["verify", "--tables", SMALL, "--only", "no_such_query"])
