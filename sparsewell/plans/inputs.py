"""The driver's tables as collections: documents, queries, judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import array_postings, text_postings
from ..functions.text import tokens
from ..operators.score import partitions


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # texts: documents, and benchmark passages as queries
    def postings(self, only: DataFrame | None = None) -> DataFrame:
        """Of all terms, or of those of the few queries ``only``, which alone make scores."""
        return text_postings(self.documents, partitions=self.parts(), only=only)

    def parts(self) -> int:
        """Partitions of documents, by what they make with all queries."""
        return partitions(self.spark, self.documents.count(), self.benchmark.count())

    def queries(self) -> DataFrame:
        return text_postings(self.benchmark, "item_id", as_key="query_id")

    def qrels(self) -> DataFrame:
        """Graded: a document that contains the passage has 1 plus its quality label.  All but
        the first and last token of a passage are whole tokens of such a document, so the
        longest of them finds the candidates; ids alone are joined, texts last.  Passages
        without one, which are few words long, are looked for in every document, in one scan."""
        d = self.documents.select("doc_id", F.col("text").alias("body"))
        b = self.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
        words = tokens("passage")
        inner = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))
        b = b.withColumn("key", F.array_max(inner)["t"])
        terms = d.select("doc_id", F.explode(F.array_distinct(tokens("body"))).alias("key"))
        near = terms.join(b.where("key is not null").select("key", "query_id"), "key").groupBy("doc_id").agg(F.collect_set("query_id").alias("of"))
        near = d.join(near, "doc_id").select("doc_id", "body", F.explode("of").alias("query_id"))
        hit = near.join(b.drop("key"), "query_id").where(F.contains("body", "passage")).select("query_id", "doc_id")
        short = b.where("key is null and passage is not null").select("query_id", "passage").collect()  # of the stated queries
        for at in range(0, len(short), 1000):
            items = F.array(*(F.struct(F.lit(r.query_id).alias("query_id"), F.lit(r.passage).alias("passage")) for r in short[at : at + 1000]))
            found = d.select("doc_id", F.explode(F.filter(items, lambda x: F.contains(F.col("body"), x["passage"]))).alias("x"))
            hit = hit.unionByName(found.select("x.query_id", "doc_id"))
        hit = hit.join(self.labels.select("doc_id", "quality"), "doc_id", "left")
        return hit.select("query_id", "doc_id", (F.coalesce("quality", F.lit(0)) + 1).cast("long").alias("relevance"))

    # vectors: every vector is a query too
    def vector_postings(self) -> DataFrame:
        return array_postings(self.embeddings, "vec_id", "embedding")

    def vector_queries(self) -> DataFrame:
        return self.vector_postings().withColumnRenamed("doc_id", "query_id")

    def class_judged(self, run: DataFrame) -> DataFrame:
        """Of all pairs of a class, those that are ranked, with their ranks: no class is joined
        with itself, and the ranking is made once."""
        label = lambda k: self.embeddings.select(F.col("vec_id").alias(k), F.col("label").alias(f"{k}_label")).distinct()
        pairs = run.select("query_id", "doc_id", "rank").where("query_id <> doc_id").join(label("query_id"), "query_id").join(label("doc_id"), "doc_id")
        return pairs.where("query_id_label = doc_id_label").select("query_id", "doc_id", "rank", F.lit(1).cast("long").alias("relevance")).distinct()

    def class_counts(self) -> DataFrame:
        """query_id, relevance, n: the others of each vector's class."""
        e = self.embeddings.select(F.col("vec_id").alias("query_id"), "label")
        n = e.groupBy("label").agg((F.count("*") - 1).alias("n")).where("n > 0")
        return e.join(n, "label").select("query_id", F.lit(1).cast("long").alias("relevance"), "n")

    def class_qrels(self) -> DataFrame:
        a = self.embeddings.select(F.col("vec_id").alias("query_id"), "label")
        b = self.embeddings.select(F.col("vec_id").alias("doc_id"), "label")
        return a.join(b, "label").where("query_id <> doc_id").select("query_id", "doc_id", F.lit(1).cast("long").alias("relevance"))

    # purchases: orders are documents, parts terms; an order may list a part twice
    def purchases(self, key: str = "doc_id") -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias(key), F.col("l_partkey").alias("term"), F.col("l_quantity").cast("float").alias("weight"))

    # users by their events: few terms, long lists
    def user_events(self, key: str = "doc_id") -> DataFrame:
        return self.events.groupBy(F.col("user_id").alias(key), F.col("event_type").alias("term")).agg(F.count("*").cast("float").alias("weight"))
