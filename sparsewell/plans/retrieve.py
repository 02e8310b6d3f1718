"""Retrieval: one entry point over the scoring strategies."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import query, score
from ..operators.blockmax import blockmax
from ..operators.index import SparseIndex
from ..operators.query import prune_by_bound, prune_by_terms, prune_by_width, truncated

STRATEGIES = ("auto", "scatter", "docparallel", "queryparallel", "chunked", "sharded", "compacted", "blockmax")
#: Ranges of this many documents bound a task's part of the score matrix.
CHUNK = 131_072


def retrieve(
    queries: DataFrame,
    index: SparseIndex,
    k: int = 1000,
    strategy: str = "auto",
    chunk: int = CHUNK,
    shards: int = 2,
    max_terms: int | None = None,
    prune: str | None = None,
    prune_ratio: float = 0.5,
    threshold: float = 0.0,
    pad_zero: bool = False,
    alpha: float = 1.0,
    term: str = "term",
) -> DataFrame:
    """query_id, doc_id, score, rank of the k best documents of each query.

    Exact unless ``max_terms`` or ``prune`` (``terms``, ``width``, ``bound``) cuts queries, or
    ``blockmax`` has an ``alpha`` below 1.
    Documents that share no term, or score 0, are left out; with ``pad_zero`` the least of
    them fill each list up.  ``auto`` is ``docparallel``: an index is clustered by document,
    and its cost per task does not depend on the number of documents."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    q = truncated(queries, max_terms, term)
    if prune == "terms":
        q = prune_by_terms(q, index.stats, prune_ratio, term)
    elif prune == "width":
        width = q.groupBy("query_id").count().agg({"count": "max"}).first()[0] or 0
        q = prune_by_width(q, index.stats, width, prune_ratio, term)
    elif prune == "bound":
        q = prune_by_bound(q, index.stats, threshold, term=term)
    elif prune is not None:
        raise ValueError("prune is terms, width or bound")
    if strategy in ("auto", "docparallel", "scatter"):
        run = score.scatter(q, index.postings, k, term)
    elif strategy == "queryparallel":
        run = score.queryparallel(q, index.postings, k, term)
    elif strategy == "chunked":
        run = score.chunked(q, index.postings, k, chunk, term)
    elif strategy == "sharded":
        run = score.sharded(q, index.postings, k, index.n_docs, shards, term)
    elif strategy == "blockmax":
        run = blockmax(q, index.postings, k, chunk, alpha, term)
    else:
        run = score.compacted(q, index.postings, k, chunk, term)
    run = run.select("query_id", "doc_id", "score", "rank")
    return score.padded(run, queries, index.documents, k).select("query_id", "doc_id", "score", "rank") if pad_zero else run


def retrieve_in_batches(queries: DataFrame, index: SparseIndex, k: int, size: int, out: str, **options) -> DataFrame:
    """The ranking of :func:`retrieve`, computed for ``size`` queries at a time and written to
    ``out``: what is exchanged at once is bounded by a batch, however many queries there are.
    Batches that are there already, as after a failure, are not computed again."""
    spark = queries.sparkSession
    numbered = query.batches(queries, size)
    n = numbered.agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
    for b in range(n):
        path = f"{out}/batch={b}"
        try:
            spark.read.parquet(path)
        except AnalysisException:
            retrieve(numbered.where(F.col("batch") == b).drop("batch"), index, k, **options).write.parquet(path)
    return spark.read.parquet(*(f"{out}/batch={b}" for b in range(n))) if n else retrieve(queries, index, k, **options)
