"""Exact learned-sparse retrieval and corpus processing on Spark DataFrames."""
