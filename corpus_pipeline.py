"""Cleans a corpus and packs it for training: five stages, each an operator of veilspark.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents, further ones included, whatever their names; text that a stage changes has its n_chars counted anew.

Every stage takes null and empty texts, null ids, repeated rows and empty tables: a null text counts as empty and comes
back null; rows of one doc_id, or of none, with different texts are different documents; rows that repeat a document share
its fate, and ties go to the least doc_id, then to the least hash of the text. Very long texts are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import cotrain, ngramjoin, packing, secrets, suffixes
from veilspark.llm.base import clear, documents, stash, written


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers reject go. A null or empty text is judged by its metadata and its lack of words;
    without labels all stay."""
    return cotrain.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id: 5-word n-grams, Jaccard 0.8 or more. Texts
    without words are nobody's copies."""
    return ngramjoin.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier go from the texts; every document stays, if with an empty text."""
    return _counted(suffixes.drop_repeats(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark: assignments, access keys and hex runs wherever they stand, bare tokens where few owners
    have them; every document stays."""
    return _counted(secrets.redact(docs))


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every row; an empty text has 0 tokens and a slot too."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secret_scan", secret_scan), ("length_buckets", length_buckets)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the rows and texts of each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = documents(spark, sf_dir), written()
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
        clear(spark, keep=docs, leave=others)  # what the stage wrote on its way is of no more use
    return STAGES[-1][1](spark, docs, sf_dir)
