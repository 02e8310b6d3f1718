"""Evaluation of rankings.

``denominator``: ``judged`` divides by queries with a positive judgement, ``graded`` by those
with any judgement, ``all`` by the queries given.  Relevant means relevance > 0; negative grades gain nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _d(x):
    return F.lit(x).cast("double")


def positives(qrels: DataFrame) -> DataFrame:
    return qrels.where("relevance > 0").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))


def _queries(qrels: DataFrame, denominator: str, queries: DataFrame | None) -> DataFrame:
    if denominator == "judged":
        return positives(qrels).select("query_id").distinct()
    if denominator == "graded":
        return qrels.select("query_id").distinct()
    if denominator == "all" and queries is not None:
        return queries.select("query_id").distinct()
    raise ValueError("denominator is judged, graded, or all with the queries")


def _mean(per_query: DataFrame, value: str, qrels: DataFrame, denominator: str, queries: DataFrame | None) -> DataFrame:
    every = _queries(qrels, denominator, queries).join(per_query, "query_id", "left")
    return every.agg(F.round(F.avg(F.coalesce(value, _d(0))), 6).alias(value), F.count("*").alias("n_queries"))


def deduplicated(run: DataFrame) -> DataFrame:
    """Each document once per query, at its best place, ranks closed up."""
    best = run.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min("rank").alias("_at"))
    order = W.partitionBy("query_id").orderBy("_at", "doc_id")
    return best.select("query_id", "doc_id", "score", F.row_number().over(order).cast("long").alias("rank"))


def mrr(run: DataFrame, qrels: DataFrame, k: int = 10, denominator: str = "judged", queries: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """One row: mrr, n_queries.  strict: raise if no ranking has a judged document, as when
    ids of different types never match."""
    hits = run.where(F.col("rank") <= k).join(positives(qrels), ["query_id", "doc_id"])
    if strict and hits.isEmpty():
        raise ValueError("no ranked document is judged relevant; are the ids of one kind?")
    first = hits.groupBy("query_id").agg((_d(1) / F.min("rank")).alias("mrr"))
    return _mean(first, "mrr", qrels, denominator, queries)


def ndcg_per_query(run: DataFrame, qrels: DataFrame, k: int = 10, gain: str = "linear") -> DataFrame:
    """query_id, ndcg for queries with a positive judgement.  gain: ``linear`` (the grade) or
    ``exponential`` (2**grade - 1)."""
    worth = _worth(gain)
    rel = positives(qrels)
    term = lambda rank: worth(F.col("relevance")) / F.log2(F.col(rank).cast("double") + 1)
    dcg = run.where(F.col("rank") <= k).join(rel, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(term("rank")).alias("dcg"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("relevance").desc(), "doc_id"))
    ideal = rel.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.sum(term("place")).alias("ideal"))
    return ideal.join(dcg, "query_id", "left").select("query_id", (F.coalesce("dcg", _d(0)) / F.col("ideal")).alias("ndcg"))


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10, gain: str = "linear", denominator: str = "judged", queries: DataFrame | None = None) -> DataFrame:
    return _mean(ndcg_per_query(run, qrels, k, gain), "ndcg", qrels, denominator, queries)


def recall(run: DataFrame, qrels: DataFrame, k: int = 100, denominator: str = "judged", queries: DataFrame | None = None) -> DataFrame:
    rel = positives(qrels)
    n = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    got = run.where(F.col("rank") <= k).join(rel, ["query_id", "doc_id"]).select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("m"))
    per = n.join(got, "query_id", "left").select("query_id", (F.coalesce("m", F.lit(0)).cast("double") / F.col("n")).alias("recall"))
    return _mean(per, "recall", qrels, denominator, queries)


def without_repeats(run: DataFrame) -> DataFrame:
    """run, but reading it fails if a query ranks a document twice, as gains would count
    twice; :func:`deduplicated` mends such a run."""
    n = F.count("*").over(W.partitionBy("query_id", "doc_id"))
    ok = F.assert_true(F.col("_n") == 1, F.lit("a query ranks a document twice")).isNull()
    return run.withColumn("_n", n).where(ok).drop("_n")


def relevant_counts(qrels: DataFrame) -> DataFrame:
    """query_id, relevance, n: documents of each positive grade."""
    return positives(qrels).groupBy("query_id", "relevance").agg(F.count("*").alias("n"))


def _worth(gain: str):
    return (lambda c: c.cast("double")) if gain == "linear" else (lambda c: F.pow(_d(2), c.cast("double")) - 1)


def evaluate(
    run: DataFrame, qrels: DataFrame | None, ks: tuple[int, ...] = (10, 100), gain: str = "linear", denominator: str = "judged", queries: DataFrame | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """A row per cut-off: k, mrr, ndcg, recall, n_queries.  The ranking is joined with the
    judgements once, for all metrics and cut-offs.  counts: :func:`relevant_counts`, if known;
    qrels then need only hold pairs that may be ranked.  Without qrels, run holds the judged
    pairs alone and has their relevance."""
    worth, top = _worth(gain), max(ks)
    counts = relevant_counts(qrels) if counts is None else counts
    log = lambda c: F.log2(c.cast("double") + 1)
    hits = run.where(F.col("rank") <= top)
    hits = hits.where("relevance > 0") if qrels is None else hits.join(positives(qrels), ["query_id", "doc_id"])
    by_pair = [F.min("rank").alias("first"), *(F.sum(F.when(F.col("rank") <= k, worth(F.col("relevance")) / log(F.col("rank")))).alias(f"d{k}") for k in ks)]
    pairs = hits.groupBy("query_id", "doc_id").agg(*by_pair)
    per = pairs.groupBy("query_id").agg(
        F.min("first").alias("first"), *(F.sum(f"d{k}").alias(f"dcg{k}") for k in ks), *(F.count_if(F.col("first") <= k).alias(f"m{k}") for k in ks)
    )
    # the ideal ranking from numbers of documents by grade: no more than top places a query
    of = W.partitionBy("query_id").orderBy(F.col("relevance").desc())
    places = counts.withColumn("hi", F.sum("n").over(of)).withColumn("lo", F.col("hi") - F.col("n"))
    n = places.groupBy("query_id").agg(F.sum("n").alias("n"))
    places = places.where(F.col("lo") < top).select("query_id", "relevance", F.explode(F.sequence(F.col("lo") + 1, F.least("hi", F.lit(top).cast("long")))).alias("place"))
    ideal = places.groupBy("query_id").agg(*(F.sum(F.when(F.col("place") <= k, worth(F.col("relevance")) / log(F.col("place")))).alias(f"ideal{k}") for k in ks))
    known = n.join(ideal, "query_id").join(per, "query_id", "left")
    every = known if denominator == "judged" else _queries(qrels, denominator, queries).join(known, "query_id", "left")
    zero = lambda c: F.round(F.avg(F.coalesce(c, _d(0))), 6)
    rows = F.array(*(
        F.struct(
            F.lit(k).cast("long").alias("k"),
            zero(F.when(F.col("first") <= k, _d(1) / F.col("first"))).alias("mrr"),
            zero(F.col(f"dcg{k}") / F.col(f"ideal{k}")).alias("ndcg"),
            zero(F.col(f"m{k}").cast("double") / F.col("n")).alias("recall"),
            F.count("*").alias("n_queries"),
        )
        for k in ks
    ))
    return every.agg(rows.alias("rows")).select(F.inline("rows"))


def without_self(run: DataFrame) -> DataFrame:
    """Documents whose id is the query's go, and ranks close up; lists may get shorter."""
    kept = run.where(F.col("doc_id").cast("string") != F.col("query_id").cast("string"))
    order = W.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(order).cast("long"))


def _matches(exact: DataFrame, run: DataFrame, k: int) -> DataFrame:
    """query_id, n (documents of the exact list), m (of these in the other)."""
    truth = exact.where(F.col("rank") <= k).select("query_id", "doc_id")
    got = run.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit"))
    both = truth.join(got, ["query_id", "doc_id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("m"))


def recall_vs_exact(exact: DataFrame, run: DataFrame, k: int, average: str = "micro") -> DataFrame:
    """One row: of the exact lists' documents, the share found; micro over all together,
    macro as the mean over queries."""
    m = _matches(exact, run, k)
    value = F.sum("m").cast("double") / F.sum("n") if average == "micro" else F.avg(F.col("m").cast("double") / F.col("n"))
    return m.agg(F.round(value, 6).alias("recall"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """One row: mean of the common documents of both lists over k."""
    return _matches(a, b, k).agg(F.round(F.avg(F.col("m").cast("double") / F.lit(k)), 6).alias("overlap"))


def compared(exact: DataFrame, runs: dict[int, DataFrame] | None, k: int, name: str, value: str = "overlap", keys: tuple[int, ...] = ()) -> DataFrame:
    """A row for each of the runs, with its key as ``name``: overlap as of :func:`overlap`, or
    recall as of :func:`recall_vs_exact` (micro).  All are compared at once, so that exact is
    made once.  Without runs, exact holds those of ``keys`` too, by its column ``name``, -1
    being the exact one."""
    top = lambda df, key: df.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(key).cast("long").alias("_of"))
    if runs is None:
        every = exact.where(F.col("rank") <= k).select("query_id", "doc_id", F.nullif(F.col(name), F.lit(-1)).alias("_of"))
    else:
        every, keys = top(exact, None), tuple(runs)
        for key, run in runs.items():
            every = every.unionByName(top(run, key))
    hits = [F.count_if(F.col("_of") == key).alias(f"_{key}") for key in keys]
    pairs = every.groupBy("query_id", "doc_id").agg(F.count_if(F.col("_of").isNull()).alias("_n"), *hits).where("_n > 0")
    per = pairs.groupBy("query_id").agg(F.sum("_n").alias("_n"), *(F.sum(f"_{key}").alias(f"_{key}") for key in keys))
    share = (lambda m: F.avg(m.cast("double") / F.lit(k))) if value == "overlap" else (lambda m: F.sum(m).cast("double") / F.sum("_n"))
    rows = (F.struct(F.lit(key).cast("long").alias(name), F.round(share(F.col(f"_{key}")), 6).alias(value)) for key in keys)
    return per.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def score_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the largest difference of scores at equal rank, at all ranks and at 1."""
    x = a.select("query_id", "rank", F.col("score").alias("x")).join(b.select("query_id", "rank", F.col("score").alias("y")), ["query_id", "rank"])
    d = F.abs(F.col("x") - F.col("y"))
    return x.agg(F.round(F.max(d), 6).alias("max_difference"), F.round(F.max(F.when(F.col("rank") == 1, d)), 6).alias("top_difference"))


def identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of either ranking that the other lacks, and whether there are none."""
    cols = ["query_id", "doc_id", "score", "rank"]
    n = a.select(*cols).exceptAll(b.select(*cols)).unionByName(b.select(*cols).exceptAll(a.select(*cols)))
    return n.agg(F.count("*").alias("different_rows"), (F.count("*") == 0).alias("identical"))


def near_kth(scores: DataFrame, run: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """query_id and the number of scored documents within ``tolerance`` of the last score of
    the query's list."""
    last = run.groupBy("query_id").agg(F.min("score").alias("kth"))
    near = scores.join(last, "query_id").where(F.abs(F.col("score") - F.col("kth")) <= tolerance)
    return near.groupBy("query_id").agg(F.count("*").alias("n_near"))


def grading_profile(qrels: DataFrame) -> DataFrame:
    """relevance, n, and whether the judgements are all 0 or 1."""
    binary = qrels.agg(F.bool_and(F.col("relevance").isin(0, 1)).alias("is_binary"))
    return qrels.groupBy("relevance").agg(F.count("*").alias("n")).crossJoin(binary)  # one row
