"""Registered queries against their SQL in DuckDB, over whole tables."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.registry import ORACLE_SQL, QUERIES


def _rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).values.tolist()), key=repr)


def verify(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> Iterator[tuple[str, str]]:
    """(query, "equal" or what is wrong), query by query."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        inside = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{inside}'")
    for name in only or sorted(ORACLE_SQL):
        try:
            got, want = _rows(QUERIES[name](spark, sf_dir).toPandas()), _rows(con.sql(ORACLE_SQL[name]).df())
            yield name, "equal" if got == want else f"{len(set(got) ^ set(want))} of {len(want)} rows differ"
        except Exception as error:  # one query's fault is no reason not to look at the others
            yield name, str(error)[:200]
