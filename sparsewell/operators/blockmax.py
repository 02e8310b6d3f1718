"""Block-max pruning: blocks of documents are skipped by bounds on their scores.

A query's bound on a block is the sum of its weights times the largest weights of its terms
in the block.  The block of the highest bound is scored first and gives tau, its k-th best
score.  Other blocks are scored only if ``alpha`` times their bound reaches tau: with alpha
1 the ranking is exact, below it more is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .score import not_negative, products, small, thresholds, with_chunk
from .topk import top_k


def block_bounds(queries: DataFrame, postings: DataFrame, block: int, term: str = "term") -> DataFrame:
    """query_id, chunk, bound."""
    most = with_chunk(postings, block).groupBy("chunk", term).agg(F.max(not_negative(F.col("weight"))).alias("weight"))
    q = small(queries.select(F.col(term).alias("_t"), "query_id", not_negative(F.col("weight")).alias("_w")))
    part = (F.col("_w") * F.col("weight")).cast("double")
    return most.join(q, F.col(term) == F.col("_t")).groupBy("query_id", "chunk").agg(F.sum(part).alias("bound"))


def blockmax(queries: DataFrame, postings: DataFrame, k: int, block: int, alpha: float = 1.0, term: str = "term") -> DataFrame:
    bounds = block_bounds(queries, postings, block, term)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("bound").desc(), "chunk"))
    bounds = bounds.withColumn("place", place)

    def scored(blocks: DataFrame) -> DataFrame:
        pairs = products(queries, with_chunk(postings, block), term).join(blocks.select("query_id", "chunk"), ["query_id", "chunk"], "left_semi")
        return pairs.groupBy("query_id", "doc_id").agg(F.round(F.sum("part").cast("double"), 6).alias("score")).where("score <> 0")

    head = scored(bounds.where("place = 1"))
    # scores are rounded, so the bound is given half a unit of the last place
    reach = F.col("bound") * F.lit(float(alpha)) + F.lit(1e-6) >= F.col("tau")
    rest = bounds.where("place > 1").join(thresholds(head, k), "query_id", "left").where(F.col("tau").isNull() | reach)
    return top_k(head.unionByName(scored(rest)), k)
