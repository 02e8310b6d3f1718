"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

_f = T.StructField

#: Document side: one row per (document, term); duplicates are allowed and add up.
POSTINGS = T.StructType([_f("doc_id", T.LongType()), _f("term", T.StringType()), _f("weight", T.FloatType())])
#: Query side.
QUERY_TERMS = T.StructType([_f("query_id", T.LongType()), _f("term", T.StringType()), _f("weight", T.FloatType())])
#: A ranking; rank starts at 1.
RUN = T.StructType([_f("query_id", T.LongType()), _f("doc_id", T.LongType()), _f("score", T.DoubleType()), _f("rank", T.LongType())])
#: Judgements; grades may be zero or negative.
QRELS = T.StructType([_f("query_id", T.LongType()), _f("doc_id", T.LongType()), _f("relevance", T.LongType())])
#: A document vector as parallel arrays.
VECTORS = T.StructType([_f("doc_id", T.LongType()), _f("terms", T.ArrayType(T.IntegerType())), _f("weights", T.ArrayType(T.FloatType()))])
