"""Readers of sparse vectors: JSON lines, arrays, and the tables of a corpus."""

from __future__ import annotations

import tarfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VECTOR_JSON = "id string, _id string, docid string, qid string, vector map<string,double>"


def read_json_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON files (also gzipped), with a number that follows their order."""
    lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())
    return lines.withColumnRenamed("value", "line")


def read_tar_vectors(spark: SparkSession, paths: list[str], max_docs: int | None = None) -> DataFrame:
    """The same from (compressed) tar files of such lines, of each the first max_docs.  A task streams a file; the ordinal
    numbers its lines, above the number of the file."""
    files = spark.createDataFrame(list(enumerate(paths)), "number long, path string").repartition(max(1, len(paths)), "number")

    def lines(batches):
        for batch in batches:
            for number, path in zip(*(batch.column(c).to_pylist() for c in ("number", "path")), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                n = number << 33
                end = n + (max_docs if max_docs is not None else 1 << 33)
                with store.open_input_stream(name, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                    for member in tar:
                        held = tar.extractfile(member)
                        while held and n < end and (some := held.readlines(1 << 20)):
                            text = [x.decode(errors="replace").rstrip("\r\n") for x in some][: end - n]
                            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(range(n, n + len(text)), pa.int64())], names=["line", "ordinal"])
                            n += len(text)

    return files.mapInArrow(lines, "line string, ordinal long")


def parse_json_vectors(lines: DataFrame, query_side: bool = False) -> DataFrame:
    """id, ordinal, token, weight from (line, ordinal).  Broken lines, and empty or missing
    vectors, are skipped; the id is the first of id, _id, docid (queries: qid) or the
    ordinal."""
    x = lines.withColumn("x", F.from_json("line", VECTOR_JSON)).where(F.size("x.vector") > 0)
    third = "x.qid" if query_side else "x.docid"
    x = x.select(F.coalesce("x.id", "x._id", third, F.col("ordinal").cast("string")).alias("id"), "ordinal", F.col("x.vector").alias("vector"))
    return x.select("id", "ordinal", F.explode("vector").alias("token", "weight"))


def last_queries(parsed: DataFrame) -> DataFrame:
    """Of queries of one id the last.  Apply it after the vocabulary: a line of which no token
    is known is no query, and does not replace an earlier one."""
    last = F.max("ordinal").over(W.partitionBy("id"))
    return parsed.withColumn("_last", last).where("ordinal = _last").drop("_last")


def query_vectors(lines: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, ordinal, term_id, weight of queries, those of one id being the last known one."""
    return last_queries(with_vocabulary(parse_json_vectors(lines, query_side=True), vocab))


def with_vocabulary(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens replaced by their term_id; unknown ones are dropped."""
    return tokens.join(vocab, "token").drop("token").withColumn("weight", F.col("weight").cast("float"))


def unknown_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: vectors' entries whose token is not in the vocabulary."""
    return tokens.join(vocab, "token", "left_anti").agg(F.count("*").alias("n_unknown"))


def numbered_documents(parsed: DataFrame) -> DataFrame:
    """id, doc_id: documents numbered without gaps in their order.  Two levels, so no task
    sees all of them: by partition of the ordinal, then within it."""
    ids = parsed.groupBy("id").agg(F.min("ordinal").alias("ordinal")).withColumn("part", F.shiftright("ordinal", 33))
    n = ids.groupBy("part").agg(F.count("*").alias("n"))
    n = n.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ids = ids.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("ordinal")) - 1)
    return ids.join(n, "part").select("id", (F.col("base") + F.col("at")).cast("long").alias("doc_id"))


def first_documents(docs: DataFrame, key: str = "doc_id", order: str = "ordinal") -> DataFrame:
    """Of documents of one id the first."""
    w = W.partitionBy(key).orderBy(order)
    return docs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def judged_and_filler(docs: DataFrame, qrels: DataFrame, max_docs: int) -> DataFrame:
    """All judged documents, then unjudged ones in order of doc_id up to max_docs in all."""
    judged = docs.join(qrels.select("doc_id").distinct(), "doc_id", "left_semi")
    room = max(0, max_docs - judged.count())
    filler = docs.join(qrels.select("doc_id").distinct(), "doc_id", "left_anti").orderBy("doc_id").limit(room)
    return judged.unionByName(filler)


def judged_queries(queries: DataFrame, qrels: DataFrame, documents: DataFrame | None = None, max_queries: int | None = None) -> DataFrame:
    """Queries with a positive judgement (of a document at hand), the first max_queries."""
    rel = qrels.where("relevance > 0")
    if documents is not None:
        rel = rel.join(documents.select("doc_id"), "doc_id", "left_semi")
    kept = queries.join(rel.select("query_id").distinct(), "query_id", "left_semi")
    return kept if max_queries is None else kept.orderBy("query_id").limit(max_queries)
