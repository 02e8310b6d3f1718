"""Exact scoring: the inner product of every query with every document that shares a term.

All strategies return the same rows.  They differ in layout:

* ``scatter``: postings in any layout; pairs are summed in two steps and meet by
  (query, document), then by query.
* ``docparallel``: postings clustered by document, so a task owns its documents and
  sums their scores alone; only each task's k best per query are exchanged.
* ``queryparallel``: products meet by query at once, one exchange; for many more queries
  than tasks.
* ``chunked`` and ``sharded``: postings dealt by ranges of documents; a task sums and ranks
  its ranges alone, and only the k best of each are exchanged.
* ``compacted``: the k-th best score of the first range bounds what other ranges send on
  (negative weights are refused).
* ``dense``: products of dense vectors, the oracle of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import nearest
from .topk import top_k

#: Up to this many bytes (measured, not guessed) the query side is sent to all tasks.
BROADCAST_BYTES, BYTES_PER_TERM = 64 << 20, 48


#: Pairs of a query and a document that a task may hold: some 650 bytes each, sorts included.
TASK_PAIRS = 1 << 18


def partitions(spark: SparkSession, n_docs: int, n_queries: int) -> int:
    """Into how many partitions documents are dealt, such that a task holds no more than
    TASK_PAIRS of them and queries, however many there are; two a core at least, or one for
    each thousand of few documents."""
    least = min(2 * spark.sparkContext.defaultParallelism, -(-n_docs // 1000))
    return max(1, least, -(-n_docs * n_queries // TASK_PAIRS))


def fits(queries: DataFrame) -> bool:
    """Whether the query side is small enough to be sent to all tasks."""
    return queries.count() * BYTES_PER_TERM <= BROADCAST_BYTES


def small(queries: DataFrame, n_terms: int | None = None) -> DataFrame:
    """``queries`` marked for broadcast if they are small; else left to the planner, which
    joins by shuffle and splits skewed terms."""
    n = queries.count() if n_terms is None else n_terms
    return F.broadcast(queries) if n * BYTES_PER_TERM <= BROADCAST_BYTES else queries


def not_negative(weight):
    """The weight; reading a negative one fails, as bounds would not hold."""
    return F.when(weight < 0, F.raise_error(F.lit("weights must not be negative")).cast("float")).otherwise(weight)


def products(queries: DataFrame, postings: DataFrame, term: str = "term") -> DataFrame:
    """query_id, doc_id, part: a row per shared term.  Unknown terms join nothing; equal
    (document, term) rows add up later."""
    q = queries.select(F.col(term).alias("_t"), "query_id", F.col("weight").alias("_w"))
    return postings.join(small(q), F.col(term) == F.col("_t")).withColumn("part", F.col("_w") * F.col("weight"))


def scores(queries: DataFrame, postings: DataFrame, term: str = "term", digits: int | None = 6) -> DataFrame:
    """query_id, doc_id, score: the score matrix without its empty cells."""
    total = F.sum("part").cast("double")
    s = products(queries, postings, term).groupBy("query_id", "doc_id").agg((F.round(total, digits) if digits is not None else total).alias("score"))
    return s


def scatter(queries: DataFrame, postings: DataFrame, k: int, term: str = "term") -> DataFrame:
    return top_k(scores(queries, postings, term).where("score <> 0"), k)


def by_document(postings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Postings clustered by document: done once, when an index is written or cached.
    Postings made from texts are so already.  The number of partitions is stated, because
    postings are few bytes for the work they make, and would be merged into few tasks."""
    return postings.repartition(partitions or int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def docparallel(queries: DataFrame, clustered: DataFrame, k: int, term: str = "term") -> DataFrame:
    """``clustered`` must be :func:`by_document`; the sums then need no exchange."""
    return scatter(queries, clustered, k, term)


def queryparallel(queries: DataFrame, postings: DataFrame, k: int, term: str = "term") -> DataFrame:
    """One exchange, of all products: worth it if the queries far outnumber the tasks."""
    dealt = products(queries, postings, term).select("query_id", "doc_id", "part").repartition("query_id")
    s = dealt.groupBy("query_id", "doc_id").agg(F.round(F.sum("part").cast("double"), 6).alias("score"))
    return top_k(s.where("score <> 0"), k)


def with_chunk(df: DataFrame, chunk: int, doc: str = "doc_id") -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(doc) / chunk).cast("long"))


def _by_chunk(queries: DataFrame, postings: DataFrame, k: int, chunk: int, term: str) -> DataFrame:
    """query_id, doc_id, score, chunk: the k best of every range of documents."""
    laid = with_chunk(postings, chunk)
    laid = laid.repartition(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk")
    total = F.round(F.sum("part").cast("double"), 6).alias("score")
    s = products(queries, laid, term).groupBy("chunk", "query_id", "doc_id").agg(total).where("score <> 0")
    order = W.partitionBy("chunk", "query_id").orderBy(F.col("score").desc(), "doc_id")
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def chunked(queries: DataFrame, postings: DataFrame, k: int, chunk: int, term: str = "term") -> DataFrame:
    """A task holds the scores of its ranges of documents, whatever the corpus: postings are
    dealt by range before anything is summed, and sums and rankings then need no exchange."""
    return top_k(_by_chunk(queries, postings, k, chunk, term).drop("chunk"), k)


def sharded(queries: DataFrame, postings: DataFrame, k: int, n_docs: int, shards: int = 2, term: str = "term") -> DataFrame:
    """Equal ranges of documents; ids are unique over shards, so merging is a top-k.  Shards
    are few and large, so their documents stay dealt over tasks as they are (by document, sums
    need no exchange): only the k best of each task and shard meet."""
    s = with_chunk(scores(queries, postings, term).where("score <> 0"), max(1, -(-n_docs // shards)))
    order = W.partitionBy("chunk", "query_id").orderBy(F.col("score").desc(), "doc_id")
    best = s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top_k(best.drop("chunk", "rank"), k)


def compacted(queries: DataFrame, postings: DataFrame, k: int, chunk: int, term: str = "term") -> DataFrame:
    """The first range of documents is scored alone.  Rows of others stay only if they reach
    tau, the k-th best score there (``>=``, so ties stay).  Weights must not be negative."""
    q = queries.withColumn("weight", not_negative(F.col("weight")))
    p = with_chunk(postings.withColumn("weight", not_negative(F.col("weight"))), chunk)
    p = p.crossJoin(F.broadcast(p.agg(F.min("chunk").alias("least"))))  # one row
    head = scores(q, p.where("chunk = least"), term).where("score <> 0")
    rest = scores(q, p.where("chunk > least"), term).where("score <> 0")
    kept = rest.join(thresholds(head, k), "query_id", "left").where("tau is null or score >= tau").drop("tau")
    return top_k(head.unionByName(kept), k)


def thresholds(s: DataFrame, k: int) -> DataFrame:
    """query_id, tau: the k-th best score, for queries that have k."""
    return top_k(s, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("tau"))


def candidate_decay(queries: DataFrame, postings: DataFrame, k: int, chunk: int, term: str = "term") -> DataFrame:
    """Per chunk, scored pairs and those that reach the k-th best score of all chunks up to
    and including their own.  The running threshold comes from one walk over a query's
    chunks, which carries the k best scores so far: of a chunk only its own k best matter."""
    s = with_chunk(scores(queries, postings, term).where("score <> 0"), chunk)
    order = W.partitionBy("query_id", "chunk").orderBy(F.col("score").desc(), "doc_id")
    best = s.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).groupBy("query_id", "chunk").agg(F.collect_list("score").alias("best"))
    walks = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "best"))).alias("chunks"))
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("best"), F.array().cast("array<struct<chunk:bigint,tau:double>>").alias("taus"))

    def step(a, x):
        held = F.slice(F.sort_array(F.concat(a["best"], x["best"]), asc=False), 1, k)
        tau = F.struct(x["chunk"].alias("chunk"), F.get(held, F.lit(k - 1)).alias("tau"))
        return F.struct(held.alias("best"), F.concat(a["taus"], F.array(tau)).alias("taus"))

    tau = walks.select("query_id", F.explode(F.aggregate("chunks", start, step)["taus"]).alias("t")).select("query_id", "t.chunk", "t.tau")
    kept = s.join(tau, ["query_id", "chunk"], "left")
    reach = F.count_if(F.col("tau").isNull() | (F.col("score") >= F.col("tau")))
    return kept.groupBy("chunk").agg(F.count("*").alias("scored"), reach.alias("candidates"))


def padded(run: DataFrame, queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """A ranking filled up to k rows a query with the least untouched doc_ids at score 0.
    Of all documents only the k least ids can be needed, so no cross product is made."""
    ids = queries.select("query_id").distinct()
    least = documents.select("doc_id").orderBy("doc_id").limit(k)
    fill = ids.crossJoin(F.broadcast(least)).join(run.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    fill = fill.select("query_id", "doc_id", F.lit(0.0).cast("double").alias("score"))
    return top_k(run.select("query_id", "doc_id", "score").unionByName(fill), k)


def dense(queries: DataFrame, docs: DataFrame, k: int, max_pairs: int | None = None) -> DataFrame:
    """(query_id, dense) against (doc_id, dense): every pair, block by block, so that no more
    than lists are kept; raises if there are more than ``max_pairs``."""
    if max_pairs is not None and (n := queries.count()) * (m := docs.count()) > max_pairs:
        raise ValueError(f"{n} x {m} pairs are too many for the dense product; use sparse vectors")
    best = nearest.dense(queries, docs, k)
    return top_k(best.drop("rank"), k)  # a query_id may stand in several rows
