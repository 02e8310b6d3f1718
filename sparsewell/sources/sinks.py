"""Writers of rankings, collections and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_lines(run: DataFrame, tag: str = "sparsewell") -> DataFrame:
    """query_id, rank, line: `query Q0 document rank score tag`, scores with 6 decimals; only
    scores above 0."""
    line = F.format_string("%s Q0 %s %d %.6f %s", F.col("query_id").cast("string"), F.col("doc_id").cast("string"), "rank", "score", F.lit(tag))
    return run.where("score > 0").select("query_id", "rank", line.alias("line"))


def write_run(run: DataFrame, path: str, tag: str = "sparsewell") -> None:
    """A gzipped run file per range of queries, in order."""
    lines = run_lines(run, tag).repartitionByRange("query_id").sortWithinPartitions("query_id", "rank")
    lines.select("line").write.text(path, compression="gzip")


def write_collection(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """JSON lines {id, contents} for external text indexers."""
    docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("contents")).write.json(path)


def write_rankings(run: DataFrame, path: str) -> None:
    """JSON lines {query_id, docs}: the documents of each query in order."""
    order = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    run.groupBy("query_id").agg(order.alias("d")).select("query_id", F.col("d.doc_id").alias("docs")).write.json(path)


def write_results(rows: DataFrame, path: str) -> None:
    """Measured results as JSON lines in one file; they are few."""
    rows.coalesce(1).write.mode("overwrite").json(path)
