"""Experiments over synthetic collections: one parameter varies, the others stay.

Each value gives a row: times of repeated runs, what Spark counted in one of them, and the
ranking's overlap with the exact one.  A value that fails gives its error and ends nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from .operators import metrics, profile
from .operators.index import build_index
from .plans.retrieve import retrieve
from .sources import synthetic


@dataclass(frozen=True)
class Setting:
    """docs and queries, terms of a document, vocabulary, k, and how queries are answered."""

    docs: int = 10_000
    terms: int = 100
    vocab: int = 30_000
    queries: int = 50
    k: int = 100
    strategy: str = "auto"
    max_terms: int | None = None
    chunk: int = 4096
    alpha: float = 1.0
    partitions: int | None = None

    def run(self, spark: SparkSession, postings: DataFrame, queries: DataFrame) -> DataFrame:
        index = build_index(postings, postings.select("doc_id").distinct())
        return retrieve(queries, index, self.k, self.strategy, self.chunk, max_terms=self.max_terms, alpha=self.alpha)


def collection(spark: SparkSession, s: Setting) -> tuple[DataFrame, DataFrame]:
    """Stored postings and queries of the setting."""
    postings = synthetic.documents(spark, s.docs, s.terms, s.vocab, duplicates=False)
    return postings, synthetic.queries(spark, s.queries, s.vocab)


def measure(spark: SparkSession, s: Setting, repeats: int) -> dict:
    postings, queries = (x.cache() for x in collection(spark, s))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        if s.partitions:
            spark.conf.set("spark.sql.shuffle.partitions", str(s.partitions))
        row = profile.timed(lambda: s.run(spark, postings, queries), repeats)
        row |= profile.work(spark, lambda: s.run(spark, postings, queries))
        exact = replace(s, strategy="auto", max_terms=None, alpha=1.0).run(spark, postings, queries)
        return row | {"overlap": metrics.overlap(exact, s.run(spark, postings, queries), s.k).first()[0], "queries_per_s": s.queries / row["median"]}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        postings.unpersist()
        queries.unpersist()


def sweep(spark: SparkSession, name: str, values: list, base: Setting = Setting(), repeats: int = 3) -> Iterator[dict]:
    """A row for each value of the setting's field ``name``."""
    for value in values:
        setting = replace(base, **{name: value})
        try:
            found = measure(spark, setting, repeats)
        except Exception as error:  # an experiment of a sweep may fail without ending it
            found = {"error": str(error)[:200]}
        yield asdict(setting) | {"varied": name} | found


def lines(rows: Iterator[dict]) -> Iterator[str]:
    """JSON lines, numbers rounded."""
    for row in rows:
        yield json.dumps({k: round(v, 6) if isinstance(v, float) else v for k, v in row.items()})
