"""Collections of titled documents, queries and judgements in a folder.

    corpus.jsonl       _id, title, text
    queries.jsonl      _id, text
    qrels/<split>.tsv  a head line, then query id, document id, grade
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import title_text


@dataclass
class Collection:
    """documents(doc_id, text), queries(query_id, text), qrels(query_id, doc_id, relevance)."""

    documents: DataFrame
    queries: DataFrame
    qrels: DataFrame


def read_collection(spark: SparkSession, folder: str, split: str = "test", max_docs: int | None = None) -> Collection:
    """The collection; queries are those with a judgement.  With max_docs, the documents of
    the least ids are kept, and judgements of others go, with queries that lose all theirs."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    documents = corpus.where(F.col("_id").isNotNull()).select(F.col("_id").alias("doc_id"), title_text("title", "text").alias("text"))
    rows = spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True, schema="query_id string, doc_id string, relevance string")
    grade = F.expr("try_cast(relevance AS BIGINT)")
    qrels = rows.select("query_id", "doc_id", grade.alias("relevance")).where("relevance is not null").distinct()
    if max_docs is not None:
        documents = documents.orderBy("doc_id").limit(max_docs)
        qrels = qrels.join(documents.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "relevance")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), "text")
    return Collection(documents, queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), qrels)
