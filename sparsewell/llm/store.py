"""Scratch tables in the folder that the cluster shares.

``spark.checkpoint.dir`` names it; it is set here only where a local session leaves it
unset (as in tests), as no other folder is known to be shared by a cluster.  Tables written
by a session stay readable until :func:`release` removes them, because lazy results may
still read them; :func:`scratch` removes those that were needed for one result only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparsewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sparsewell/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Rows of a small table that go to one file.
FILE_ROWS = 1 << 18


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts the
    lineage and survives lost executors.  rows: a bound of its rows, if known, so that a
    small table makes few files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Stored bytes a core below which a table is dealt over all cores.
CORE_BYTES = 4 << 20


def dealt(docs: DataFrame) -> DataFrame:
    """``docs``, dealt over all cores if it is so small that its files may make fewer tasks
    than there are cores.  What is shuffled is bounded by the cores; larger tables stay."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * CORE_BYTES else docs


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, size: str = "8m") -> AbstractContextManager[None]:
    """Within it, rows go to Python in batches of at most ``size`` bytes."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def shuffles_removed(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, shuffle files go when the table they were made for is written, not when
    the driver happens to collect its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hconf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this session; lazy results on them end here."""
    _delete(spark, _written.pop(spark.sparkContext.applicationId, []))


@contextmanager
def scratch(spark: SparkSession, keep: tuple[str, ...]) -> Iterator[None]:
    """Tables made within it go at its end, but for those whose names begin with one of
    ``keep``.  What is read later must have been saved under such a name."""
    own = _written.setdefault(spark.sparkContext.applicationId, [])
    before = len(own)
    yield
    done = [path for path in own[before:] if not path.rsplit("/", 1)[1].startswith(keep)]
    own[before:] = [path for path in own[before:] if path not in done]
    _delete(spark, done)
