"""Per-query top-k: score descending, then id ascending, always."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(scores: DataFrame, by: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    order = W.partitionBy(by).orderBy(F.col(score).desc(), item)
    return scores.withColumn("rank", F.row_number().over(order))


def top_k(scores: DataFrame, k: int, by: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best per query with their rank.  The limit on the rank lets Spark keep k rows
    per query in each task before the exchange, if k is not above the session's
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 unless set); results are the same
    either way, and the setting is left to the session's owner."""
    out = ranked(scores, by, item, score).where(F.col("rank") <= k)
    return out.withColumn("rank", F.col("rank").cast("long"))


def merge(runs: list[DataFrame], k: int) -> DataFrame:
    """The k best of several rankings of disjoint documents."""
    every = runs[0].drop("rank")
    for run in runs[1:]:
        every = every.unionByName(run.drop("rank"))
    return top_k(every, k)
