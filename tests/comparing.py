"""Spark results against the same question in DuckDB."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN"}


def connect(sf_dir: str = SMALL):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).values.tolist()), key=repr)


def assert_same(spark_df, con, sql: str) -> None:
    want = con.sql(sql)
    kinds, found = dict(spark_df.dtypes), dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[k] for c, k in kinds.items()} == found
    columns = sorted(found)
    assert rows(spark_df.toPandas(), columns) == rows(want.df(), columns)
