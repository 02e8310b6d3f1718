"""From raw documents to token files: each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparsewell.llm import decontam, langid, mixing, ngramjoin, tokenfile
from sparsewell.llm.store import saved, scratch


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a reliable language go; ``lang`` is the language found."""
    return langid.identified_documents(docs, langid.learn(docs))


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return ngramjoin.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark passage go."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, those taken twice twice."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read again: doc_id, start, n_tokens, ids_crc32."""
    return tokenfile.read(tokenfile.write(docs))


STAGES = [
    ("language ID", identify),
    ("n-gram Jaccard join", join_similar),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: The learned and hashed stages have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Outputs of the stages and the token files stay; what a stage
    wrote on the way goes as soon as its output is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark, keep=("pipeline-", "tokens-", "token-segments-")):
            docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
