"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text) -> Column:
    """Lower-cased runs of ASCII letters and digits (null: none)."""
    split = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+")
    return F.array_remove(split, "")  # compiled, as a filter by a lambda is not


def title_text(title, text) -> Column:
    """Title and text with a blank between, trimmed."""
    return F.trim(F.concat_ws(" ", F.col(title), F.col(text)))


def first_tokens(words: Column, n: int) -> Column:
    return F.slice(words, 1, n)


def capitalized(text) -> Column:
    """First letter in upper case, the rest in lower case."""
    c = F.col(text) if isinstance(text, str) else text
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def file_name(text) -> Column:
    """A dataset name as a file name."""
    return F.replace(F.col(text), F.lit("/"), F.lit("_"))
