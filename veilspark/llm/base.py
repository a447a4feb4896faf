"""What the operators of this package share: inputs, the shared work folder, Arrow text buffers.

Conventions that every operator keeps:

* ``doc_id`` names a document. A null ``doc_id`` counts as the smallest id, and rows that repeat a
  ``doc_id`` with the same text are one document: each row gets that document's result. Rows of one
  ``doc_id``, or of none, with different texts are different documents. Joins go by k and ``text_hash``;
  k alone is for order and output.
* A null text counts as the empty text. Very long texts are whole, each alone in its piece of work.
* Only the columns an operator names are read. Operators that give back all columns of their input carry
  the others inside one struct, so no name of theirs, dotted ones included, clashes with an operator's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.stored import clear, work_folder, written  # noqa: F401
from veilspark.stored import stored as stash

#: Stands for a null doc_id inside the operators.
NO_ID = -(2**63)
#: Rows in an Arrow batch handed to Python; texts may be long, so fewer than Spark's default.
ARROW_ROWS = 2000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """(k, text, *columns) of documents: k is doc_id with null as the smallest id, a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *columns)


def doc_id() -> F.Column:
    """The id that ``keyed`` turned into k."""
    return F.when(F.col("k") != F.lit(NO_ID), F.col("k")).alias("doc_id")


def text_hash() -> F.Column:
    """h, which tells documents of one k apart; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h")


#: Shared doc_ids up to which they are broadcast; beyond, rows meet them by a join that spreads hot keys.
FEW = 1_000_000


def shared_ids(docs: DataFrame) -> DataFrame:
    """(k) of the doc_ids that several texts have, stored. Null ids are taken as shared and have no row here."""
    texts = keyed(docs, text_hash()).where(F.col("k") != NO_ID)
    return stash(texts.groupBy("k").agg((F.min("h") < F.max("h")).alias("several")).where("several").select("k"))


def told_apart(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows (k, h, ...) with h, the hash of the text, kept where k names several texts or none, and 0 elsewhere: k and h name a
    document, and order it by its doc_id, in every table alike."""
    marked = shared.withColumn("__several", F.lit(True))
    met = rows.join(F.broadcast(marked), "k", "left") if shared.count() <= FEW else spread_join(rows, marked, "k", "left")
    several = F.coalesce("__several", F.lit(False)) | (F.col("k") == NO_ID)
    return met.withColumn("h", F.when(several, F.col("h")).otherwise(F.lit(0).cast("long"))).select(rows.columns)


def quoted(name: str) -> F.Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, *columns) -> DataFrame:
    """(k, h, text, row, *columns) of documents: text as it is, null or not; all other columns inside row."""
    small_batches(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k")
    return docs.select(key, text_hash(), "text", F.struct(*(quoted(c) for c in docs.columns if c != "text")).alias("row"), *columns)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``packed`` undone: the columns of the table that it was made of, in order, with the text of now."""
    return rows.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns))


#: Rows of a key that count as many: over 1 / SHARE of all. So at most SHARE keys are such.
SHARE = 1000


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """(key, parts) of the keys that hold over 1 / SHARE of total rows, from counts (key, n): few rows at any size, so safe to
    broadcast."""
    return F.broadcast(counts.where(F.col("n") * SHARE > total).select(key, F.ceil(F.col("n") * SHARE / max(total, 1)).alias("parts")))


def spread_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """many.join(few, key) where few has a row for each key and some keys may hold a large part of many.

    The rows of ``hot_keys`` are dealt out over parts, and their row of few goes to each part. Nothing else is broadcast."""
    if hot is None:
        hot = hot_keys(many.groupBy(key).agg(F.count("*").alias("n")), key, many.count())
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = many.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(*(c for c in many.columns if c != key)), parts)).drop("parts")
    given = few.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return dealt.join(given, [key, "part"], how).drop("part")


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get(_ARROW)) > ARROW_ROWS:
        spark.conf.set(_ARROW, str(ARROW_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and its row offsets, without copying them; null is empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at is not None and at.size else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
