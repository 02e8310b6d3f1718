"""Files in and out."""

import gzip
import io
import json
import tarfile

from sparsewell.__main__ import main
from sparsewell.operators.index import SparseIndex, build_index, load_index, save_index, term_stats
from sparsewell.operators.profile import safely, spread_percent, sweep
from sparsewell.sources import sinks, vectors
from sparsewell.sources.qrels import read_qrels, read_run
from sparsewell.streaming.queries import answer_stream


def test_qrels(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("5\t0\t9\t1\n5\t8\t1\n5\t7\n5\t0\t6\t0\n5\t0\t4\tx\n5\t0\t9\t2\n")
    got = {tuple(r) for r in read_qrels(spark, str(tmp_path / "q.tsv")).collect()}
    assert got == {("5", "9", 2), ("5", "8", 1)}


def test_json_vectors(spark, tmp_path):
    lines = ['{"id": "a", "vector": {"x": 1.0, "zz": 2}}', "{broken", '{"_id": "b", "vector": {}}', '{"docid": "c", "vector": {"x": 2.5}}', '{"vector": {"y": 1}}', '{"id": "a", "vector": {"x": 9}}']
    with gzip.open(tmp_path / "v.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    parsed = vectors.parse_json_vectors(vectors.read_json_vectors(spark, str(tmp_path / "v.jsonl.gz")))
    vocab = spark.createDataFrame([("x", 4), ("y", 5)], "token string, term_id int")
    got = {tuple(r) for r in vectors.with_vocabulary(parsed, vocab).select("id", "term_id", "weight").collect()}
    assert got == {("a", 4, 1.0), ("a", 4, 9.0), ("c", 4, 2.5), ("4", 5, 1.0)}
    assert vectors.unknown_tokens(parsed, vocab).first()[0] == 1
    queries = vectors.last_queries(vectors.parse_json_vectors(vectors.read_json_vectors(spark, str(tmp_path / "v.jsonl.gz")), query_side=True))
    assert {(r.id, r.token, r.weight) for r in queries.where("id = 'a'").collect()} == {("a", "x", 9.0)}
    numbers = {r.id: r.doc_id for r in vectors.numbered_documents(parsed).collect()}
    assert numbers == {"a": 0, "c": 1, "4": 2}


def test_tar_vectors(spark, tmp_path):
    for k in range(2):
        with tarfile.open(tmp_path / f"v{k}.tar.gz", "w:gz") as tar:
            for part in range(2):
                data = "".join(json.dumps({"id": f"{k}-{part}-{i}", "vector": {"x": i + 1.0}}) + "\n" for i in range(3)).encode()
                info = tarfile.TarInfo(f"part{part}.jsonl")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    lines = vectors.read_tar_vectors(spark, [f"file://{tmp_path}/v{k}.tar.gz" for k in range(2)])
    numbers = {r.id: r.doc_id for r in vectors.numbered_documents(vectors.parse_json_vectors(lines)).collect()}
    assert numbers == {f"{k}-{p}-{i}": k * 6 + p * 3 + i for k in range(2) for p in range(2) for i in range(3)}
    few = vectors.parse_json_vectors(vectors.read_tar_vectors(spark, [f"file://{tmp_path}/v{k}.tar.gz" for k in range(2)], max_docs=4))
    assert {r.id for r in few.collect()} == {f"{k}-{p}-{i}" for k in range(2) for p in range(2) for i in range(3) if p * 3 + i < 4}


def test_run_file(spark, tmp_path):
    run = spark.createDataFrame([(2, 7, 1.5, 1), (2, 8, 0.0, 2), (1, 9, 0.25, 1)], "query_id long, doc_id long, score double, rank long")
    sinks.write_run(run, str(tmp_path / "run"))
    got = {tuple(r) for r in read_run(spark, str(tmp_path / "run")).collect()}
    assert got == {("2", "7", 1.5, 1), ("1", "9", 0.25, 1)}
    sinks.write_rankings(run, str(tmp_path / "rankings"))
    assert spark.read.json(str(tmp_path / "rankings")).where("query_id = 2").first().docs == [7, 8]
    sinks.write_collection(spark.createDataFrame([(1, "x")], "doc_id long, text string"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).first().contents == "x"
    sinks.write_results(spark.createDataFrame([(1, 2.0)], "k int, seconds double"), str(tmp_path / "r"))


def small_index(spark):
    p = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "doc_id long, term string, weight float")
    return build_index(p, spark.range(3).withColumnRenamed("id", "doc_id"), "term")


def test_saved_index_is_bucketed(spark):
    i = small_index(spark)
    save_index(i, "kept", 4)
    back = load_index(spark, "kept")
    assert back.n_docs == 3 and back.postings.count() == 3
    text = back.postings.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


def test_query_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "query_id long, term string, weight float").write.parquet(str(src))
    stream = spark.readStream.schema("query_id long, term string, weight float").parquet(str(src))
    i, got = small_index(spark), []
    answer_stream(stream, SparseIndex(i.postings, i.documents, term_stats(i.postings)), lambda df, n: got.extend(map(tuple, df.collect()))).awaitTermination()
    assert sorted(got) == [(1, 0, 1.0, 2), (1, 2, 3.0, 1), (2, 1, 2.0, 1)]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    spark.createDataFrame([(0, "red fox"), (1, "blue fox fox")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(5, "fox")], "query_id long, text string").write.parquet(str(tmp_path / "q"))
    (tmp_path / "rel.tsv").write_text("5\t0\t1\t1\n")
    main(["index", "--documents", str(tmp_path / "d"), "--out", str(tmp_path / "i")])
    main(["search", "--index", str(tmp_path / "i"), "--queries", str(tmp_path / "q"), "--k", "5", "--out", str(tmp_path / "run")])
    main(["evaluate", "--run", str(tmp_path / "run"), "--qrels", str(tmp_path / "rel.tsv"), "--k", "10"])
    assert "|10 |1.0|1.0 |1.0   |1" in capsys.readouterr().out


def test_sweep_survives_a_failure(spark):
    def build(n):
        if n == 2:
            raise MemoryError("too much")
        return spark.range(n)

    out = sweep("n", (1, 2, 3), build)
    assert out[1] == {"n": 2, "error": "too much"} and out[2]["median"] > 0
    assert spread_percent(out) >= 0 and "error" not in safely(lambda: spark.range(1), repeats=1)
