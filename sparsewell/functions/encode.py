"""Encoders: from text or activations to weighted terms.

Weights are FLOAT; a score is the DOUBLE sum of FLOAT products, which is the same in
any order for all but adversarial inputs.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens


def log_tf(tf: Column) -> Column:
    return F.log((tf + 1).cast("double")).cast("float")


def activation(x: Column) -> Column:
    """log(1 + relu(x))."""
    return F.log(F.lit(1.0).cast("double") + F.greatest(x.cast("double"), F.lit(0.0).cast("double"))).cast("float")


def term_counts(docs: DataFrame, key: str, text: str = "text", max_tokens: int | None = None, lengths: bool = False, partitions: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """key, term, tf (and doc_len, the document's tokens), of all terms or those of a small table.  The documents are clustered by key
    first; their terms are then counted, and later scores summed, without another exchange.
    A text is smaller than its postings, so that is the cheapest place for the one shuffle; a
    table bucketed by the key needs none.  Without ``partitions`` (:func:`score.partitions`) the
    planner makes as many as suit the texts, whose scores may be far larger."""
    split = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+")
    d = docs.select(key, text)
    d = d.repartition(key) if partitions is None else d.repartition(partitions, key)
    if max_tokens is not None or lengths:
        words = tokens(text) if max_tokens is None else F.slice(tokens(text), 1, max_tokens)
        d = d.select(key, words.alias("w"))
        d = d.select(key, F.size("w").cast("long").alias("doc_len"), F.explode("w").alias("term"))
    else:
        d = d.select(key, F.explode(split).alias("term")).where("term <> ''")
    if only is not None:
        d = d.join(F.broadcast(only.select("term").distinct()), "term", "left_semi")
    by = [key, "doc_len"] if lengths else [key]
    return d.groupBy(*by, "term").agg(F.count("*").alias("tf"))


def text_postings(docs: DataFrame, key: str = "doc_id", text: str = "text", as_key: str = "doc_id", max_tokens: int | None = None, partitions: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Postings of texts with weights log(1 + tf)."""
    c = term_counts(docs, key, text, max_tokens, partitions=partitions, only=only)
    return c.select(F.col(key).alias(as_key), "term", log_tf(F.col("tf")).alias("weight"))


def array_postings(vectors: DataFrame, key: str, values: str, as_key: str = "doc_id") -> DataFrame:
    """Postings of the positive components of dense vectors, terms being positions."""
    x = vectors.select(F.col(key).alias(as_key), F.posexplode(values).alias("term", "x")).where("x > 0")
    return x.select(as_key, "term", activation(F.col("x")).alias("weight"))


def max_pool(logits: DataFrame, key: str, term: str, logit: str, mask: str | None = None) -> DataFrame:
    """Per (key, term) the largest activation over positions; masked positions count as 0.
    Terms whose pooled weight is 0 are left out."""
    x = activation(F.col(logit))
    if mask is not None:
        x = F.when(F.col(mask), x).otherwise(F.lit(0.0).cast("float"))
    return logits.groupBy(key, term).agg(F.max(x).alias("weight")).where("weight > 0")


def bm25_postings(docs: DataFrame, k1: float = 0.9, b: float = 0.4, terms: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """doc_id, term and the BM25 weight of the term in the document (a DOUBLE).  Statistics
    are over all documents, also those without a token.  terms: a small table of the terms
    that are asked for; postings of others are then not made, and those of a document stay
    together, while all postings would be exchanged to meet their document frequencies."""
    c = term_counts(docs, "doc_id", lengths=True, partitions=partitions, only=terms)
    lens = docs.agg(F.sum(F.size(tokens("text")).cast("long")).alias("total"))
    n = docs.agg(F.count("*").alias("n_docs"))
    df = c.groupBy("term").agg(F.count("*").alias("df"))
    x = c.join(df if terms is None else F.broadcast(df), "term").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(lens))  # one row each
    d = lambda v: F.lit(v).cast("double")
    idf = F.log(d(1) + (F.col("n_docs") - F.col("df") + d(0.5)) / (F.col("df") + d(0.5)))
    avg = F.col("total").cast("double") / F.col("n_docs")
    w = idf * F.col("tf") * d(k1 + 1) / (F.col("tf") + d(k1) * (d(1 - b) + d(b) * F.col("doc_len") / avg))
    return x.select("doc_id", "term", w.alias("weight"))


def model_postings(docs: DataFrame, key: str, text: str, encode: Callable) -> DataFrame:
    """Postings from a neural encoder.  ``encode`` takes a pandas Series of texts and gives a
    Series of {term: weight} dictionaries; it runs on Arrow batches."""
    @F.pandas_udf("map<string,float>")
    def run(texts: pd.Series) -> pd.Series:
        return encode(texts)

    return docs.select(key, F.explode(run(F.col(text))).alias("term", "weight")).where("weight > 0")


def to_dense(postings: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """key and an array of ``size`` weights; equal (key, term) rows add up."""
    m = postings.groupBy(key, "term").agg(F.sum("weight").cast("float").alias("w"))
    m = m.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("term").cast("int"), "w"))).alias("m"))
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0).cast("float"))).alias("dense"))
