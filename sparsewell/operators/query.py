"""Query preparation: truncation and pruning of query terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .index import running
from .score import not_negative


def truncated(queries: DataFrame, max_terms: int | None, term: str = "term") -> DataFrame:
    """The ``max_terms`` heaviest terms of each query (ties: smallest term); None keeps all,
    which is the exact mode."""
    if max_terms is None:
        return queries
    order = W.partitionBy("query_id").orderBy(F.col("weight").desc(), term)
    return queries.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_terms).drop("_n")


def known_terms(queries: DataFrame, vocab_size: int, term: str = "term") -> DataFrame:
    """Terms with a number inside the vocabulary; the same as what a join would keep."""
    return queries.where((F.col(term) >= 0) & (F.col(term) < vocab_size))


def width_stats(queries: DataFrame, max_terms: int) -> DataFrame:
    """One row: queries, mean and largest number of terms, width used, queries cut."""
    n = queries.groupBy("query_id").agg(F.count("*").alias("n"))
    return n.agg(
        F.count("*").alias("n_queries"), F.round(F.avg("n"), 6).alias("mean_terms"), F.max("n").alias("max_terms"),
        F.least(F.max("n"), F.lit(max_terms).cast("long")).alias("width"), F.count_if(F.col("n") > max_terms).alias("n_cut"),
    )


def uncut(queries: DataFrame, max_terms: int) -> DataFrame:
    """queries, but reading them fails if one has more than ``max_terms`` terms, which would
    be cut elsewhere without notice."""
    n = F.count("*").over(W.partitionBy("query_id"))
    ok = F.assert_true(F.col("_n") <= max_terms, F.lit(f"a query has more than {max_terms} terms")).isNull()
    return queries.withColumn("_n", n).where(ok).drop("_n")


def upper_bounds(queries: DataFrame, stats: DataFrame, term: str = "term") -> DataFrame:
    """queries with ub, the most a term can add to a score; 0 for terms without postings.
    Negative weights, which would make it no bound, are refused."""
    s = stats.select(F.col(term).alias("_t"), "max_weight")
    q = queries.join(s, F.col(term) == F.col("_t"), "left").drop("_t")
    most = F.coalesce("max_weight", F.lit(0.0).cast("float"))
    return q.withColumn("ub", (not_negative(F.col("weight")) * not_negative(most)).cast("double")).drop("max_weight")


def _strongest(bounded: DataFrame, keep, term: str) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("ub").desc(), term)
    q = bounded.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(W.partitionBy("query_id")))
    return q.where(F.col("_r") <= keep).drop("_r", "_n", "ub")


def prune_by_terms(queries: DataFrame, stats: DataFrame, ratio: float = 0.5, term: str = "term") -> DataFrame:
    """Keep max(1, floor(n (1 - ratio))) terms of the highest upper bounds, n being the
    query's terms, those without postings included."""
    keep = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(1.0 - ratio)))
    return _strongest(upper_bounds(queries, stats, term), keep, term)


def prune_by_width(queries: DataFrame, stats: DataFrame, width: int, ratio: float = 0.5, term: str = "term") -> DataFrame:
    """The same with the padded width of the batch for n: short queries lose nothing."""
    return _strongest(upper_bounds(queries, stats, term), F.lit(max(1, int(width * (1.0 - ratio)))), term)


def prune_by_bound(queries: DataFrame, stats: DataFrame, threshold: float, share: float = 0.1, term: str = "term") -> DataFrame:
    """Drop terms whose upper bound is below ``share`` of ``threshold`` (0 drops none of
    non-negative weight)."""
    return upper_bounds(queries, stats, term).where(F.col("ub") >= share * threshold).drop("ub")


def batches(queries: DataFrame, size: int) -> DataFrame:
    """queries with batch, numbering runs of ``size`` queries by query_id (a number); no task
    sees all of them."""
    ids = running(queries.select("query_id").distinct(), "query_id", F.lit(1), "place")
    return queries.join(ids.select("query_id", F.floor(F.col("place") / size).cast("long").alias("batch")), "query_id")
