"""Cleaning and packing of a corpus: five stages over a table of documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. Stages before the last return the columns of their documents.

Nulls and empty texts: an empty text is scored for toxicity like others, survives the exact step as one row,
is linked with nothing in the near step, has nothing to take in the mix, and so ends there. Rows without a doc_id, or
that repeat one, are rows like others in the near step and in the mix. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapledger.llm.common import documents
from snapledger.llm.exact import drop_exact
from snapledger.llm.minhash import keep_near
from snapledger.llm.mixing import mixed_documents
from snapledger.llm.packing import pack
from snapledger.llm.toxicity import drop_toxic
from snapledger.session import delete_folder, new_folder, owning


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents predicted toxic."""
    return drop_toxic(docs, documents(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts that are equal apart from white space."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each component of near duplicates."""
    return keep_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop whole documents so that the sources meet their target weights."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: No SQL expresses the learned, hashed and scheduled stages; the tests compare them with plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`.

    Each stage's output is written; what it stored on the way, and the output before it, go when it is. Nothing but this run's own
    folders is deleted.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        folder = new_folder(spark, f"corpus-stage-{name}")
        with owning(spark, f"corpus-stores-{name}"):
            stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            delete_folder(spark, before)
        before = folder
    return docs
