"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.  In all stages null texts count as empty, null and
repeated doc_ids are rows like others, an empty table gives an empty table, and further columns, whatever their names, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runstore.llm import exact_dedup, langid, near_dedup, packing, secrets, shared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no letter, so no language, go, also null and empty ones.

    A missing lang becomes the predicted one, if there are labelled rows to learn from; all else stays as it is.
    """
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays; of repeated rows one, and a null doc_id loses to any other."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles the document with the smallest doc_id stays.

    Rows without doc_id, or with one that others have too, come after all others; of each group one row stays nevertheless.
    """
    return near_dedup.dedup(docs, size=5, percent=80)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text and n_chars follows; no document goes, null texts stay null."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document that is left lies in one window; a null or empty text is its end id alone."""
    return packing.packed(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", secret), ("packing", pack)]

#: SQL has no tokenizer, kernel model or MinHash forest; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left; no documents give none."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
