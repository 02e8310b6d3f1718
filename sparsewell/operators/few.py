"""Few queries against many documents, in one pass over the postings for several rankings.

Postings are joined with the queries' vocabulary and gathered by document, which takes no
exchange if they are clustered so.  A task then sums all its documents' scores in arrays, a
fixed number of cells at a time, and keeps the k best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .nearest import Lists, half_up

#: Scores that a task sums at once.
CELLS = 1 << 20


class Queries:
    """Postings of queries by term; ``place`` is the place of a term in its query."""

    def __init__(self, rows: list, terms: dict):
        self.ids = np.array(sorted({r.query_id for r in rows}), "i8")
        rows = sorted(rows, key=lambda r: terms[r.term])
        number = np.array([terms[r.term] for r in rows], "i8")
        self.start = np.searchsorted(number, np.arange(len(terms) + 1))
        self.query = np.searchsorted(self.ids, np.array([r.query_id for r in rows], "i8"))
        self.weight = np.array([r.weight for r in rows], "f4" if isinstance(rows[0].weight, float) else "f8")
        self.place = np.array([r.place for r in rows], "i8")

    def __len__(self):
        return len(self.ids)


def _sums(q: Queries, lengths, terms, weights, widths) -> Iterator[np.ndarray]:
    """Of each width the scores (query, document), not rounded: DOUBLE sums of products."""
    n = len(lengths)
    doc = np.repeat(np.arange(n), lengths)
    times = q.start[terms + 1] - q.start[terms]
    at = np.repeat(np.arange(len(terms)), times)
    of = q.start[terms][at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    part = (q.weight[of] * weights[at]).astype("f8")
    cell = q.query[of] * n + doc[at]
    for w in widths:
        some = slice(None) if w is None else q.place[of] <= w
        yield np.bincount(cell[some], part[some], len(q) * n).reshape(len(q), n)


def _rank(batches: Iterator[pa.RecordBatch], q: Queries, k: int, widths: list) -> Iterator[pa.RecordBatch]:
    lists = [Lists(q, k) for _ in widths]
    step = max(1, CELLS // len(q))
    for b in batches:
        for s in range(0, b.num_rows, step):
            ids, p = b.column(0)[s : s + step].to_numpy(), b.column(1)[s : s + step]
            flat = p.flatten()
            terms, weights = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for best, x in zip(lists, _sums(q, p.value_lengths().to_numpy(), terms, weights, widths), strict=True):
                low = best.kth
                fresh = np.isneginf(low)
                if fresh.any() and len(ids) > k:
                    least = np.partition(x[fresh], -k, axis=1)[:, -k]
                    low[fresh] = np.where(least > 1e-5, least, -np.inf)
                hit = (x >= (low - 2e-6)[:, None]) & (x != 0)
                if not np.isfinite(x).all():
                    hit |= ~np.isfinite(x)
                rows, cols = np.divmod(np.flatnonzero(hit), len(ids))
                best.put(rows, ids[cols], half_up(x[rows, cols]))
    for w, best in zip(widths, lists, strict=True):
        for r in best.rows():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(r.num_rows, -1 if w is None else w, "i8")), *r.columns[:3]], ["width", "query_id", "doc_id", "score"])


def top_k(queries: DataFrame, clustered: DataFrame, k: int, widths: tuple[int | None, ...] = (None,)) -> DataFrame:
    """width, query_id, doc_id, score, rank: the k best documents of each query, cut to its
    ``width`` heaviest terms as by :func:`query.truncated` (None, given as -1: whole).  Ids
    are whole numbers, and terms not repeated within a query; the queries are sent to all
    tasks, so they must be few (:func:`score.fits`)."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("weight").desc(), "term"))
    rows = queries.withColumn("place", place).select("query_id", "term", "weight", "place").collect()
    schema = "width long, query_id long, doc_id long, score double"
    spark = queries.sparkSession
    if not rows:
        return spark.createDataFrame([], schema + ", rank long")
    terms = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    vocabulary = spark.createDataFrame(list(terms.items()), "_t string, _id long")
    known = clustered.join(F.broadcast(vocabulary), F.col("term") == F.col("_t"))
    docs = known.groupBy("doc_id").agg(F.collect_list(F.struct("_id", "weight")).alias("p"))
    best = docs.mapInArrow(partial(_rank, q=Queries(rows, terms), k=k, widths=list(widths)), schema)
    order = W.partitionBy("width", "query_id").orderBy(F.col("score").desc(), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))
