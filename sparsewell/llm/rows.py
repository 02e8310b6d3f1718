"""Whole rows carried as one struct, so that no column of a table can clash with a helper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame) -> DataFrame:
    """The one column ``row``: each row as a struct of all its columns."""
    return docs.select(F.struct(*("`" + c.replace("`", "``") + "`" for c in docs.columns)).alias("row"))


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns of the structs ``row``; all other columns go."""
    return rows.select("row.*")
