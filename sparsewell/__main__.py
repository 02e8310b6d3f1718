"""Command line: build an index of a text table, search it, evaluate a run.

    python -m sparsewell index    --documents docs.parquet --out index_dir
    python -m sparsewell search   --index index_dir --queries queries.parquet --k 100 --out run_dir
    python -m sparsewell evaluate --run run_dir --qrels qrels.tsv --k 10 100
    python -m sparsewell collection --folder folder --name name --k 10 100
    python -m sparsewell sweep    --vary docs --values 1000 10000 --k 100 --out rows.jsonl
    python -m sparsewell verify   --tables folder --only scatter_topk
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .experiments import Setting, lines, sweep
from .functions.encode import bm25_postings, term_counts, text_postings
from .operators import metrics
from .operators.index import SparseIndex, build_index
from .plans.retrieve import STRATEGIES, retrieve, retrieve_in_batches
from .sources.collection import Collection, read_collection
from .sources.qrels import read_qrels, read_run
from .sources.sinks import write_run
from .verify import verify


def _index(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = spark.read.parquet(a.documents)
    index = build_index(text_postings(docs), docs.select("doc_id"))
    for part in ("postings", "documents", "stats"):
        getattr(index, part).write.mode("overwrite").parquet(f"{a.out}/{part}")


def _search(spark: SparkSession, a: argparse.Namespace) -> None:
    index = SparseIndex(*(spark.read.parquet(f"{a.index}/{part}") for part in ("postings", "documents", "stats")))
    terms = text_postings(spark.read.parquet(a.queries), "query_id", as_key="query_id")
    options = {"strategy": a.strategy, "max_terms": a.max_terms, "prune": a.prune, "alpha": a.alpha}
    run = retrieve_in_batches(terms, index, a.k, a.batch, f"{a.out}.batches", **options) if a.batch else retrieve(terms, index, a.k, **options)
    write_run(run, a.out, a.tag)


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    run, qrels = read_run(spark, a.run), read_qrels(spark, a.qrels, positive_only=False)
    if a.drop_self:
        run = metrics.without_self(run)
    metrics.evaluate(run, qrels, tuple(a.k), a.gain, a.denominator, run.select(F.col("query_id"))).show(truncate=False)


def _collection(spark: SparkSession, a: argparse.Namespace) -> None:
    """Index a collection's texts, answer its queries and print a row a cut-off."""
    c = read_collection(spark, a.folder, a.split, a.max_docs)
    postings = bm25_postings(c.documents) if a.weights == "bm25" else text_postings(c.documents)
    index = build_index(postings, c.documents.select("doc_id"))
    if a.weights == "bm25":
        terms = term_counts(c.queries, "query_id").select("query_id", "term", F.col("tf").cast("float").alias("weight"))
    else:
        terms = text_postings(c.queries, "query_id", as_key="query_id")
    if a.max_queries is not None:
        few = c.queries.orderBy("query_id").limit(a.max_queries)
        c = Collection(c.documents, few, c.qrels.join(few.select("query_id"), "query_id", "left_semi"))
        terms = terms.join(few.select("query_id"), "query_id", "left_semi")
    run = retrieve(terms, index, max(a.k), a.strategy, max_terms=a.max_terms)
    run = metrics.without_repeats(metrics.without_self(run) if a.drop_self else run)
    rows = metrics.evaluate(run, c.qrels, tuple(a.k), a.gain, a.denominator, c.queries.select("query_id"))
    rows.select(F.lit(a.name).alias("collection"), "*").show(truncate=False)


def _sweep(spark: SparkSession, a: argparse.Namespace) -> None:
    """Measure one varied setting; a JSON line a value."""
    kind = {f.name: f.type for f in fields(Setting)}
    read = lambda name, text: float(text) if "float" in kind[name] else int(text) if "int" in kind[name] else text
    given = {n: read(n, getattr(a, n)) for n in kind if getattr(a, n, None) is not None}
    out = open(a.out, "w") if a.out else sys.stdout
    for line in lines(sweep(spark, a.vary, [read(a.vary, v) for v in a.values], replace(Setting(), **given), a.repeats)):
        print(line, file=out, flush=True)
    if a.out:
        out.close()


def _verify(spark: SparkSession, a: argparse.Namespace) -> None:
    """Compare queries with their SQL; the exit code tells whether all are equal."""
    failed = 0
    for name, found in verify(spark, a.tables, a.only):
        failed += found != "equal"
        print(f"{name}: {found}", flush=True)
    print(f"{failed} failed")
    if failed:
        raise SystemExit(1)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sparsewell", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(required=True)
    c = sub.add_parser("index")
    c.add_argument("--documents", required=True)
    c.add_argument("--out", required=True)
    c.set_defaults(do=_index)
    c = sub.add_parser("search")
    c.add_argument("--index", required=True)
    c.add_argument("--queries", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--k", type=int, default=1000)
    c.add_argument("--strategy", choices=STRATEGIES, default="auto")
    c.add_argument("--max-terms", type=int)
    c.add_argument("--prune", choices=("terms", "width"))
    c.add_argument("--alpha", type=float, default=1.0, help="share of its bound at which blockmax skips a block")
    c.add_argument("--batch", type=int, help="queries answered at a time")
    c.add_argument("--tag", default="sparsewell")
    c.set_defaults(do=_search)
    c = sub.add_parser("evaluate")
    c.add_argument("--run", required=True)
    c.add_argument("--qrels", required=True)
    c.add_argument("--k", type=int, nargs="+", default=[10, 100, 1000])
    c.add_argument("--gain", choices=("linear", "exponential"), default="linear")
    c.add_argument("--denominator", choices=("judged", "graded", "all"), default="judged")
    c.add_argument("--drop-self", action="store_true")
    c.set_defaults(do=_evaluate)
    c = sub.add_parser("collection")
    c.add_argument("--folder", required=True)
    c.add_argument("--name", default="collection")
    c.add_argument("--split", default="test")
    c.add_argument("--max-docs", type=int)
    c.add_argument("--max-queries", type=int)
    c.add_argument("--weights", choices=("logtf", "bm25"), default="logtf")
    c.add_argument("--max-terms", type=int)
    c.add_argument("--strategy", choices=STRATEGIES, default="auto")
    c.add_argument("--k", type=int, nargs="+", default=[10, 100, 1000])
    c.add_argument("--gain", choices=("linear", "exponential"), default="linear")
    c.add_argument("--denominator", choices=("judged", "graded", "all"), default="graded")
    c.add_argument("--drop-self", action="store_true")
    c.set_defaults(do=_collection)
    c = sub.add_parser("sweep")
    c.add_argument("--vary", required=True, choices=[f.name for f in fields(Setting)])
    c.add_argument("--values", nargs="+", required=True)
    for f in fields(Setting):
        c.add_argument(f"--{f.name.replace('_', '-')}", dest=f.name)
    c.add_argument("--repeats", type=int, default=3)
    c.add_argument("--out")
    c.set_defaults(do=_sweep)
    c = sub.add_parser("verify")
    c.add_argument("--tables", required=True, help="folder of Parquet tables")
    c.add_argument("--only", nargs="+")
    c.set_defaults(do=_verify)
    a = p.parse_args(argv)
    a.do(SparkSession.builder.appName("sparsewell").config("spark.sql.optimizer.windowGroupLimitThreshold", "100000").getOrCreate(), a)


if __name__ == "__main__":
    main()
