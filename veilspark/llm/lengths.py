"""Operator 7, token counts: an exact length histogram and its suffix sums."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm import wordtok
from veilspark.llm.base import doc_id, keyed, record, stash

_COUNT = pa.schema([("k", pa.int64()), ("n_tokens", pa.int64())])
#: Lengths that share a block; sums over blocks are carried into each block, so no window holds the whole histogram.
BLOCK = 256


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(k, n_tokens) of whole texts in the given tokenizer, k as ``keyed`` makes it."""
    path = path or wordtok.default_path()

    def rows(batches):
        encoder = wordtok.shared_encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in wordtok.groups(texts):
                yield record(_COUNT, batch.column("k").slice(low, high - low), encoder.counts(texts[low:high]))

    return keyed(docs).mapInArrow(rows, "k long, n_tokens long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """(length, n_docs) for each distinct n_tokens."""
    return counts.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Answers for every context limit that is a length of some document: with ``length`` as the limit,

    docs_at_least and tokens_at_least count the documents of that length or more; truncated_tokens is the
    total if each document is cut at the limit, total_tokens the total uncut; quantile is the share of
    documents no longer than the limit. An empty table gives no rows."""
    h = histogram.withColumn("block", F.floor(F.col("length") / F.lit(BLOCK))).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    after, everything = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    carried = blocks.select("block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("b_docs", "b_tokens")), *(F.sum(c).over(everything).alias(f"{c}_all") for c in ("b_docs", "b_tokens")))
    inside = W.partitionBy("block").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)
    at_least = h.join(carried, "block").select("length", "n_docs", (F.sum("n_docs").over(inside) + F.col("b_docs_after")).alias("docs_at_least"), (F.sum("tokens").over(inside) + F.col("b_tokens_after")).alias("tokens_at_least"), "b_docs_all", "b_tokens_all")
    return at_least.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("b_tokens_all") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        F.col("b_tokens_all").alias("total_tokens"),
        ((F.col("b_docs_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("b_docs_all")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_over, truncated_tokens) for a list of limits, from suffix_sums: the next longer length has what is needed."""
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    total = sums.agg(F.max("total_tokens").alias("total"))
    rows = sums.select(F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))).alias("context"), "length", "docs_at_least", "tokens_at_least").where("length > context").groupBy("context").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "length").alias("s"))
    return wanted.join(rows, "context", "left").crossJoin(total).select("context", F.coalesce("s.docs_at_least", F.lit(0)).alias("docs_over"), F.coalesce(F.col("total") - F.col("s.tokens_at_least") + F.col("context") * F.col("s.docs_at_least"), F.col("total"), F.lit(0)).alias("truncated_tokens"))


def document_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens); a null or empty text has 0 tokens."""
    return token_counts(docs, path).select(doc_id(), "n_tokens")


def token_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """suffix_sums over whole texts of docs. The histogram is stored once, since two branches read it.

    Every row counts, those that repeat a document too; null and empty texts have length 0. Rows of one length are one row of
    the histogram, so ties do not arise. Very long texts are whole. No rows give no rows."""
    return suffix_sums(stash(length_histogram(token_counts(docs, path))))
