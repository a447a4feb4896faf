"""The queries of this package: one for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import bpe, bytebpe, cotrain, imatch, isomedia, lengths, ngramjoin, packing, planes, runs, secrets, suffixes, trie
from veilspark.llm.base import documents


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op2_cotrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest_documents(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(documents(spark, sf_dir))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomedia.digest_documents(documents(spark, sf_dir))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.digest_documents(documents(spark, sf_dir))


def op7_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_histogram(documents(spark, sf_dir))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join_documents(documents(spark, sf_dir))


def op9_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.read_documents(planes.write_ids(documents(spark, sf_dir)))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digest_documents(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest_documents(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_cotrained, op3_suffix_family, op4_bpe, op5_media, op6_imatch, op7_token_histogram, op8_ngram_join, op9_id_planes, op10_length_buckets, op11_prefix_trie, op12_byte_bpe, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op1_secrets": secrets.ORACLE}
