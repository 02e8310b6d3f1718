"""Descriptive statistics, and measuring of plans."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens


def _r(c):
    return F.round(c.cast("double"), 6)


def width_profile(postings: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row over the vectors: n, mean, sample deviation, min, max, lower median of the
    number of terms."""
    n = postings.groupBy(key).agg(F.count("*").alias("n"))
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)")
    return n.agg(F.count("*").alias("n_vectors"), _r(F.avg("n")).alias("mean"), _r(F.stddev_samp("n")).alias("std"), F.min("n").alias("min"), F.max("n").alias("max"), median.cast("long").alias("median"))


def token_profile(docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """One row over all texts: n, mean, median, 90th percentile and maximum of their tokens,
    and the share above ``limit``."""
    n = docs.select(F.size(tokens(text)).cast("long").alias("n"))
    return n.agg(
        F.count("*").alias("n_docs"), _r(F.avg("n")).alias("mean"), _r(F.percentile("n", F.lit(0.5))).alias("median"),
        _r(F.percentile("n", F.lit(0.9))).alias("p90"), F.max("n").alias("max"), _r(F.avg((F.col("n") > limit).cast("double"))).alias("over_limit"),
    )


def document_frequency(postings: DataFrame, term: str = "term") -> DataFrame:
    return postings.groupBy(term).agg(F.count_distinct("doc_id").alias("df"))


def latency_profile(timings: DataFrame, value: str = "seconds") -> DataFrame:
    """One row: mean, median, 99th percentile and rate per second of measured times."""
    v = F.col(value)
    return timings.agg(F.count("*").alias("n"), _r(F.avg(v)).alias("mean"), _r(F.percentile(v, F.lit(0.5))).alias("median"), _r(F.percentile(v, F.lit(0.99))).alias("p99"), _r(F.count("*") / F.sum(v)).alias("per_second"))


def timed(build: Callable[[], DataFrame], repeats: int = 3, warm_up: int = 1) -> dict[str, float]:
    """Wall seconds of the whole result, the plan built anew each time (a plan that ran once
    would reuse its shuffles)."""
    took = []
    for i in range(warm_up + repeats):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        if i >= warm_up:
            took.append(time.perf_counter() - start)
    return {"mean": statistics.fmean(took), "median": statistics.median(took), "min": min(took), "max": max(took), "std": statistics.pstdev(took)}


def work(spark: SparkSession, build: Callable[[], DataFrame]) -> dict[str, float]:
    """What a query costs, by Spark's own counters: wall_s, cpu_s and run_s of all tasks,
    cpu_per_wall (cores kept busy), gc_s, and MB shuffled, spilled and read."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    every = lambda: store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())

    def each():
        stages = every()
        return [stages.apply(i) for i in range(stages.size())]

    known = {(s.stageId(), s.attemptId()) for s in each()}
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    wall = time.perf_counter() - start
    own = [s for s in each() if (s.stageId(), s.attemptId()) not in known]
    total = lambda name, unit: sum(getattr(s, name)() for s in own) / unit
    cpu = total("executorCpuTime", 1e9)
    return {
        "wall_s": wall, "cpu_s": cpu, "run_s": total("executorRunTime", 1e3), "cpu_per_wall": cpu / wall, "gc_s": total("jvmGcTime", 1e3),
        "shuffled_mb": total("shuffleWriteBytes", 1e6), "spilled_mb": total("diskBytesSpilled", 1e6), "read_mb": total("inputBytes", 1e6),
    }


def safely(build: Callable[[], DataFrame], **kw) -> dict:
    """:func:`timed`, or the error that ended it."""
    try:
        return timed(build, **kw)
    except Exception as error:  # an experiment of a sweep may fail without ending the sweep
        return {"error": str(error)[:200]}


def sweep(name: str, values, build: Callable) -> list[dict]:
    """A row of timings per parameter value."""
    return [{name: v} | safely(lambda v=v: build(v)) for v in values]


def spread_percent(rows: list[dict], key: str = "median") -> float:
    """How far the slowest is above the fastest, in percent."""
    times = [r[key] for r in rows if key in r]
    return 100 * (max(times) - min(times)) / min(times)
