"""Connected components of a graph of long integers, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved


def components(edges: DataFrame) -> DataFrame:
    """id, root (the same for all of a component) for every id in ``edges`` (a, b), a stored
    table.

    In each round every node takes the least id among itself and its neighbours, and the
    graph of these labels, which has the same components, is next; the labels are then
    composed.  Ids must be spread at random, as hashes are, for few rounds to suffice.
    A node's neighbours are only ever aggregated, never gathered."""
    edges = edges.select("a", "b").where("a <> b")
    labels: list[DataFrame] = []
    while n := edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lab = saved(both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("label")), "labels", 2 * n)
        labels.append(lab)
        to = lambda side: lab.select(F.col("id").alias(side), F.col("label").alias(f"{side}2"))  # noqa: B023, E731
        edges = edges.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2")
        edges = saved(edges.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges", n)
    if not labels:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    root = labels[-1].withColumnRenamed("label", "root")
    for lab in reversed(labels[:-1]):
        up = root.withColumnRenamed("id", "label")
        root = lab.join(up, "label", "left").select("id", F.coalesce("root", "label").alias("root"))
    return saved(root, "roots", labels[0].count())
