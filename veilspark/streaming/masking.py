"""The same expressions over streams: masking is stateless, the counter keeps a running sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.detect import detect
from veilspark.functions.masking import mask_text
from veilspark.functions.text import nfc


def mask_stream(texts: DataFrame, column: str = "text", default: str = "shape") -> DataFrame:
    """texts, batch or stream, with ``masked`` and ``n_spans``; texts are composed first."""
    found = texts.withColumn("__t", nfc(F.col(column))).withColumn("__s", detect(F.col("__t")))
    return found.withColumn("masked", mask_text(F.col("__t"), F.col("__s"), default=default)["text"]).withColumn("n_spans", F.size("__s")).drop("__t", "__s")


def running_stats(masked: DataFrame, at: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, confirms, spans_masked) of a stream from mask_stream; events later than ``late`` are left out."""
    return masked.withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count("*").alias("confirms"), F.sum("n_spans").alias("spans_masked"))
