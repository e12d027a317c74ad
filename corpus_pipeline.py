"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination,
mixing to source weights, packed token ids.

Every stage works on all that its predecessor kept and returns the columns of
``documents`` (the last one the packed rows). ``run`` writes each stage's
result as Parquet below the shared checkpoint folder and reads it again as the
next stage's input, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.llm.common import ship, table
from verdant.llm.decontaminate import clean_documents
from verdant.llm.mixing import mixed_documents
from verdant.llm.near_duplicates import unique_documents
from verdant.llm.packing import pack_tokens
from verdant.llm.toxicity import fit, in_held_out, without_toxic
from verdant.session import checkpoint_root


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not mark; it is trained on the
    labels of the given corpus, as the registered query does."""
    ship(spark)
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=in_held_out)
    return without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id."""
    ship(spark)
    return unique_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    ship(spark)
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and selected to their sources' targets."""
    ship(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token rows."""
    ship(spark)
    return pack_tokens(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("packing", packing)]

#: The model, the MinHash join and the token packing can't be said in SQL; the
#: stages are held against brute-force versions in tests/llm instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(ship(spark), sf_dir, "documents")
    base = f"{checkpoint_root(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
