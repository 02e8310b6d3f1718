"""Queries as a stream against a stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import SparseIndex
from ..plans.retrieve import retrieve


def answer_stream(query_terms: DataFrame, index: SparseIndex, sink: Callable[[DataFrame, int], None], k: int = 10, checkpoint: str | None = None, **kw) -> StreamingQuery:
    """Rank every micro-batch of (query_id, term, weight) and pass the ranking to ``sink``
    (frame, batch number).  A query's terms must arrive in one batch.  The index is static,
    so a batch is an ordinary plan and repeats exactly after a failure."""

    def batch(terms: DataFrame, number: int) -> None:
        if not terms.isEmpty():
            sink(retrieve(terms, index, k, **kw), number)

    writer = query_terms.writeStream.foreachBatch(batch).outputMode("append").trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
