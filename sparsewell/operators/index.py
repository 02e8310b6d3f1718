"""Inverted index: postings, statistics, layouts and checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .score import by_document

#: Posting lists are padded to a multiple of this in size statistics.
PAD = 32


@dataclass
class SparseIndex:
    """postings(doc_id, term, weight), statistics per term, and the documents (which may
    have no postings)."""

    postings: DataFrame
    documents: DataFrame
    stats: DataFrame

    @property
    def n_docs(self) -> int:
        return self.documents.count()


def build_index(postings: DataFrame, documents: DataFrame, layout: str = "document") -> SparseIndex:
    """layout ``document``: clustered by document, sums need no exchange.  layout ``term``:
    clustered and sorted by (term, doc_id), so a scan for few terms reads little."""
    if layout == "document":
        laid = by_document(postings)
    elif layout == "term":
        laid = postings.repartition("term").sortWithinPartitions("term", "doc_id")
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return SparseIndex(laid, documents, term_stats(postings))


def save_index(index: SparseIndex, name: str, buckets: int, by: str = "doc_id") -> None:
    """Tables name_postings (bucketed and sorted, so later joins and sums on the key need no
    exchange), name_documents and name_stats."""
    rest = [c for c in ("term", "doc_id") if c != by]
    index.postings.write.bucketBy(buckets, by).sortBy(by, *rest).mode("overwrite").saveAsTable(f"{name}_postings")
    index.documents.write.mode("overwrite").saveAsTable(f"{name}_documents")
    index.stats.write.mode("overwrite").saveAsTable(f"{name}_stats")


def load_index(spark: SparkSession, name: str) -> SparseIndex:
    return SparseIndex(*(spark.table(f"{name}_{part}") for part in ("postings", "documents", "stats")))


def term_stats(postings: DataFrame, term: str = "term") -> DataFrame:
    """term, length, padded, max_weight; negative padding never occurs, so absent terms have
    no row."""
    n = F.count("*")
    return postings.groupBy(term).agg(
        n.alias("length"), (F.ceil(n / PAD) * PAD).cast("long").alias("padded"), F.max("weight").alias("max_weight")
    )


def running(stats: DataFrame, term: str, value, name: str) -> DataFrame:
    """stats with the sum of ``value`` over all terms before.  In two levels, so that no task
    sees the whole vocabulary: over ranges of terms, then within each."""
    kind = stats.schema[term].dataType.typeName()
    part = F.left(F.col(term), F.lit(3)) if kind == "string" else F.floor(F.col(term) / 65536)
    x = stats.withColumn("_part", part).withColumn("_v", value)
    sums = x.groupBy("_part").agg(F.sum("_v").alias("_n"))
    ahead = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("_part", F.coalesce(ahead, F.lit(0)).alias("_base"))
    within = F.sum("_v").over(W.partitionBy("_part").orderBy(term).rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("_at", F.coalesce(within, F.lit(0))).join(sums, "_part")
    return x.withColumn(name, (F.col("_base") + F.col("_at")).cast("long")).drop("_part", "_v", "_base", "_at")


def term_ids(stats: DataFrame, term: str = "term") -> DataFrame:
    """stats with term_id, the place of the term in order."""
    return running(stats, term, F.lit(1), "term_id")


def offsets(stats: DataFrame, term: str = "term") -> DataFrame:
    """stats with offset, where the padded list of the term begins."""
    return running(stats, term, F.col("padded"), "offset")


def memory(stats: DataFrame) -> DataFrame:
    """One row: postings, padded, megabytes (of 1,000,000 bytes) of 4-byte ids and weights, of
    the per-term table (8 + 4 + 4 + 4 bytes) and of all, and the share of padding."""
    mb = lambda x: F.round(x.cast("double") / F.lit(1e6).cast("double"), 6)
    s = stats.agg(F.sum("length").alias("postings"), F.sum("padded").alias("padded"), F.count("*").alias("terms"))
    total, kept = F.col("padded").cast("double"), F.col("postings").cast("double")
    return s.select(
        "postings", "padded", "terms",
        mb(F.col("padded") * 4).alias("ids_mb"), mb(F.col("padded") * 4).alias("weights_mb"), mb(F.col("terms") * 20).alias("meta_mb"),
        mb(F.col("padded") * 8 + F.col("terms") * 20).alias("total_mb"),
        F.round(1 - kept / total, 6).alias("overhead"), F.round((total - kept) / kept, 6).alias("overhead_of_kept"),
        F.round(kept / F.col("terms"), 6).alias("avg_length"),
    )


def doc_vectors(postings: DataFrame, term: str = "term") -> DataFrame:
    """doc_id, terms, weights: parallel arrays in term order; equal terms add up."""
    m = postings.groupBy("doc_id", term).agg(F.sum("weight").cast("float").alias("w"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(term).alias("t"), "w")))
    v = m.groupBy("doc_id").agg(pairs.alias("p"))
    return v.select("doc_id", F.col("p.t").alias("terms"), F.col("p.w").alias("weights"))


def from_vectors(vectors: DataFrame, key: str = "doc_id", terms: str = "terms", weights: str = "weights") -> DataFrame:
    """Postings of parallel arrays; zero weights are left out."""
    x = vectors.select(key, F.explode(F.arrays_zip(F.col(terms).alias("t"), F.col(weights).alias("w"))).alias("x"))
    return x.select(key, F.col("x.t").alias("term"), F.col("x.w").alias("weight")).where("weight <> 0")


def dimension(*sides: DataFrame, term: str = "term") -> DataFrame:
    """One row: size of the vocabulary that holds all numeric terms, plus one for padding."""
    every = sides[0].select(term)
    for side in sides[1:]:
        every = every.unionByName(side.select(term))
    return every.agg((F.max(F.col(term).cast("long")) + 2).alias("dimension"))


def chunk_bounds(postings: DataFrame, chunk: int, term: str = "term") -> DataFrame:
    """term, chunk, lo, hi: the part of the term's list that lies in each range of ids."""
    c = postings.groupBy(term, F.floor(F.col("doc_id") / chunk).cast("long").alias("chunk")).agg(F.count("*").alias("n"))
    hi = F.sum("n").over(W.partitionBy(term).orderBy("chunk"))
    return c.select(term, "chunk", (hi - F.col("n")).cast("long").alias("lo"), hi.cast("long").alias("hi"))


def unsorted_lists(ordered: DataFrame, term: str = "term", position: str = "position") -> DataFrame:
    """One row: lists of two or more postings, those whose doc_ids do not ascend along
    ``position``, their percentage, and whether all ascend."""
    step = F.col("doc_id") - F.lag("doc_id").over(W.partitionBy(term).orderBy(position))
    per = ordered.withColumn("step", step).groupBy(term).agg(F.count("*").alias("n"), F.count_if(F.col("step") < 0).alias("down"))
    s = per.where("n >= 2").agg(F.count("*").alias("lists"), F.count_if(F.col("down") > 0).alias("bad"))
    return s.select("lists", "bad", F.round(100 * F.col("bad").cast("double") / F.col("lists"), 6).alias("bad_percent"), (F.col("bad") == 0).alias("ascending"))


def check_sorted(ordered: DataFrame, term: str = "term", position: str = "position") -> None:
    """Raise if any list does not ascend."""
    bad = unsorted_lists(ordered, term, position).first()["bad"]
    if bad:
        raise ValueError(f"{bad} posting lists do not ascend by doc_id")


def shard_ranges(documents: DataFrame, shards: int) -> DataFrame:
    """shard, first_doc, last_doc, n_docs: ranges of doc_id of nearly equal width."""
    span = documents.agg(F.min("doc_id").alias("lo"), (F.max("doc_id") + 1).alias("hi"))
    d = documents.crossJoin(F.broadcast(span))  # one row
    width = F.ceil((F.col("hi") - F.col("lo")) / shards)
    d = d.withColumn("shard", F.floor((F.col("doc_id") - F.col("lo")) / width).cast("long"))
    return d.groupBy("shard").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"))
