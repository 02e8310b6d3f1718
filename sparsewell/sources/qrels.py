"""Relevance judgements as tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_qrels(spark: SparkSession, path: str, positive_only: bool = True) -> DataFrame:
    lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())
    return parse_qrels(lines.withColumnRenamed("value", "line"), positive_only)


def parse_qrels(lines: DataFrame, positive_only: bool = True) -> DataFrame:
    """query_id, doc_id (strings), relevance from (line, ordinal): four columns or more are
    (query, unused, document, grade), three are (query, document, grade), others are
    skipped, as are grades that are no number; of a pair the last line counts."""
    c = F.split(F.trim("line"), "\t")
    four, three = F.size(c) >= 4, F.size(c) == 3
    x = lines.select(
        F.get(c, F.lit(0)).alias("query_id"),
        F.when(four, F.get(c, F.lit(2))).when(three, F.get(c, F.lit(1))).alias("doc_id"),
        F.when(four, F.get(c, F.lit(3))).when(three, F.get(c, F.lit(2))).try_cast("long").alias("relevance"),
        "ordinal",
    ).where("relevance is not null")
    last = W.partitionBy("query_id", "doc_id").orderBy(F.col("ordinal").desc())
    x = x.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    if positive_only:
        x = x.where("relevance > 0")
    return x.select("query_id", "doc_id", "relevance")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A run file (query, Q0, document, rank, score, tag) as a ranking with string ids."""
    c = F.split("value", r"\s+")
    at = lambda i: F.get(c, F.lit(i))
    lines = spark.read.text(path).where(F.size(c) >= 6)
    return lines.select(at(0).alias("query_id"), at(2).alias("doc_id"), at(4).cast("double").alias("score"), at(3).cast("long").alias("rank"))
