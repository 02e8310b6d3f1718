"""Synthetic collections from integer hashes: the same rows on any engine and layout.

``draw`` turns (seed, i, j) into a number in [0, 1) by multiplication and remainder, so
that plain SQL gives the same values; distributions follow by inversion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import capitalized

PRIME = 2147483647
TOPICS = ("machine learning", "information retrieval", "data systems", "climate science", "public health", "network security")
VERBS = ("improves", "explains", "measures", "predicts", "simplifies")
ADJECTIVES = ("robust", "scalable", "efficient", "novel", "practical", "exact", "modern")
SENTENCES = ("{topic} {verb} {adjective} results.", "a {adjective} method {verb} {topic}.", "research on {topic} {verb} {adjective} models.", "{adjective} {topic} {verb} many tasks.", "in practice {topic} {verb} {adjective} systems.")
QUESTIONS = ("where {topic} {verb} anything", "which {topic} is {adjective}", "why {topic} {verb} results", "cases of {adjective} {topic}")


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1)."""
    x = F.lit(seed).cast("long")
    for p in parts:
        x = (x * 48271 + p.cast("long") * 69621 + 11) % PRIME
    for _ in range(3):
        x = (x * 48271 + 12345) % PRIME
    return x.cast("double") / F.lit(float(PRIME)).cast("double")


def zipf_rank(u: Column, vocab: int, a: float = 1.5) -> Column:
    """Inversion of a power law of exponent a, cut at the vocabulary: ranks 0 .. vocab - 1."""
    top = 1.0 - float(vocab) ** (1.0 - a)
    r = F.pow(F.lit(1.0) - u * F.lit(top), F.lit(1.0 / (1.0 - a)))
    return F.least(F.floor(r) - 1, F.lit(vocab - 1)).cast("long")


def weight_of(u: Column, exponential: float | None) -> Column:
    """Uniform in 0.1 to 3, or log(1 + x) of an exponential x of that mean."""
    if exponential is None:
        return (F.lit(0.1) + u * F.lit(2.9)).cast("float")
    return F.log(F.lit(1.0) - F.lit(exponential) * F.log(F.lit(1.0) - u)).cast("float")


def largest_prime(n: int) -> int:
    """The largest prime up to n (2 at least)."""
    return next((p for p in range(n, 2, -1) if all(p % d for d in range(2, int(p**0.5) + 1))), 2)


def exact_documents(spark: SparkSession, n_docs: int, terms: int, vocab: int, seed: int = 42) -> DataFrame:
    """doc_id, term, weight: exactly ``terms`` different terms a document, drawn without
    replacement: steps of one length around the largest prime up to the vocabulary meet no
    term twice."""
    p = largest_prime(vocab)
    if terms > p:
        raise ValueError(f"{terms} different terms need a larger vocabulary than {vocab}")
    d = spark.range(n_docs).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(terms))).alias("j"))
    first = F.floor(draw(seed, F.col("doc_id")) * p)
    step = F.floor(draw(seed + 1, F.col("doc_id")) * (p - 1)) + 1
    weight = weight_of(draw(seed + 3, F.col("doc_id"), F.col("j")), None)
    return d.select("doc_id", ((first + F.col("j") * step) % p).cast("long").alias("term"), weight.alias("weight"))


def documents(
    spark: SparkSession, n_docs: int, mean_terms: int, vocab: int, seed: int = 42, minimum: int = 10, duplicates: bool = True, zipf: float | None = 1.5, exponential: float | None = None
) -> DataFrame:
    """doc_id, term, weight.  Lengths spread around ``mean_terms``, ``minimum`` at least;
    for weights see :func:`weight_of`.  Without ``duplicates``, equal terms of a document are
    one; with zipf None terms are uniform."""
    d = spark.range(n_docs).select(F.col("id").alias("doc_id"))
    spread = F.floor((draw(seed, F.col("doc_id")) + draw(seed + 1, F.col("doc_id"))) * mean_terms)
    d = d.withColumn("n", F.greatest(F.lit(minimum), spread.cast("int")))
    x = d.select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("j"))
    u = draw(seed + 2, F.col("doc_id"), F.col("j"))
    term = zipf_rank(u, vocab, zipf) if zipf else F.floor(u * vocab).cast("long")
    weight = weight_of(draw(seed + 3, F.col("doc_id"), F.col("j")), exponential)
    x = x.select("doc_id", term.alias("term"), weight.alias("weight"))
    return x if duplicates else x.groupBy("doc_id", "term").agg(F.max("weight").alias("weight"))


def queries(spark: SparkSession, n: int, vocab: int, seed: int = 99, mean_terms: int = 30, low: int = 5, high: int = 64, exponential: float | None = None) -> DataFrame:
    """query_id, term, weight with ``low`` to ``high`` draws of Zipf terms, each term once."""
    q = spark.range(n).select(F.col("id").alias("query_id"))
    size = F.least(F.lit(high), F.greatest(F.lit(low), F.floor(draw(seed, F.col("query_id")) * 2 * mean_terms).cast("int")))
    x = q.select("query_id", F.explode(F.sequence(F.lit(1), size)).alias("j"))
    term = zipf_rank(draw(seed + 2, F.col("query_id"), F.col("j")), vocab)
    weight = weight_of(draw(seed + 3, F.col("query_id"), F.col("j")), exponential)
    return x.select("query_id", term.alias("term"), weight.alias("weight")).groupBy("query_id", "term").agg(F.max("weight").alias("weight"))


def _filled(patterns: tuple[str, ...], seed: int, key: Column) -> Column:
    pick = lambda items, s: F.element_at(F.array(*(F.lit(x) for x in items)), (F.floor(draw(s, key) * len(items)) + 1).cast("int"))
    out = pick(patterns, seed)
    for k, (name, items) in enumerate((("{topic}", TOPICS), ("{verb}", VERBS), ("{adjective}", ADJECTIVES))):
        out = F.replace(out, F.lit(name), pick(items, seed + 1 + k))
    return out


def passages(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """doc_id, text: template sentences, first letter in upper case."""
    return spark.range(n).select(F.col("id").alias("doc_id"), capitalized(_filled(SENTENCES, seed, F.col("id"))).alias("text"))


def questions(spark: SparkSession, n: int, seed: int = 17) -> DataFrame:
    """query_id, text."""
    return spark.range(n).select(F.col("id").alias("query_id"), _filled(QUESTIONS, seed, F.col("id")).alias("text"))
