"""Tables and documents as segments: header rows, marked cells, detection and masking of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.functions import detect as D
from veilspark.functions.headers import category_for_header, is_name_hint, label_spans
from veilspark.functions.masking import mask_text
from veilspark.functions.spans import none, span


def header_columns(cells: DataFrame, table: list[str], scan_limit: int = 5) -> DataFrame:
    """(*table, header_row, col, category, name_hint) for the columns that the header row of each table names.

    cells has the columns of ``table``, row, col and text. Of the first ``scan_limit`` rows that with the most header words
    is the header, the first of equals; a table without any has no rows here. A word of the category list is no name hint."""
    marked = cells.where(F.col("row") < scan_limit).withColumn("category", category_for_header(F.col("text"))).withColumn("name_hint", F.col("category").isNull() & is_name_hint(F.col("text")))
    named = marked.where(F.col("category").isNotNull() | F.col("name_hint")).select(*table, F.col("row").alias("header_row"), "col", "category", "name_hint")
    # rows before scan_limit alone, so a window holds a few rows of cells of each table
    scored = named.withColumn("score", F.count("*").over(W.partitionBy(*table, "header_row")))
    best = W.partitionBy(*table).orderBy(F.desc("score"), "header_row")
    return scored.withColumn("place", F.dense_rank().over(best)).where("place = 1").drop("score", "place")


def mark_cells(cells: DataFrame, table: list[str], scan_limit: int = 5) -> DataFrame:
    """cells with is_header, forced_category and name_hint_only, by their table's header row and column."""
    headers = header_columns(cells, table, scan_limit)
    rows = headers.select(*table, F.col("header_row")).distinct()
    columns = headers.select(*table, "col", "category", "name_hint")
    joined = cells.join(rows, table, "left").join(columns, [*table, "col"], "left")
    header = F.coalesce(F.col("row") == F.col("header_row"), F.lit(False))
    return joined.select(
        *(F.col(c) for c in cells.columns), header.alias("is_header"), F.when(~header, F.col("category")).alias("forced_category"),
        (~header & F.coalesce(F.col("name_hint"), F.lit(False))).alias("name_hint_only"),
    )


def _flag(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def detect_segments(segments: DataFrame) -> DataFrame:
    """segments with ``spans``. A header cell has none, a cell of a forced category is one whole span; other texts have the
    detected spans, then those of inline labels, then names where the column hints at them. These lists may overlap."""
    text = F.col("text")
    header, forced = F.coalesce(_flag(segments, "is_header", "boolean"), F.lit(False)), _flag(segments, "forced_category", "string")
    hint = F.coalesce(_flag(segments, "name_hint_only", "boolean"), F.lit(False))
    found = F.concat(D.detect(text), label_spans(text), F.when(hint, D.contextual_names(text)).otherwise(none()))
    whole = F.array(span(F.lit(0), F.length(text), text, forced, 1.0))
    return segments.withColumn("spans", F.when(header | text.isNull(), none()).when(forced.isNotNull(), whole).otherwise(found))


def mask_segments(segments: DataFrame, modes: Column | None = None, keys: Column | None = None) -> DataFrame:
    """segments with spans to the same with ``masked`` and ``n_applied``. Every category is masked, whether or not it is on for
    pasted text; a set of keys holds for each segment alike. Without modes all is masked by shape; a user's files take
    the modes of their settings (``settings.settings(...)["modeByCategory"]``, or ``settings.default_modes()``)."""
    result = mask_text(F.col("text"), F.col("spans"), modes=modes, keys=keys)
    header = F.coalesce(_flag(segments, "is_header", "boolean"), F.lit(False))
    done = segments.withColumn("__m", result)
    return done.withColumn("masked", F.when(header, F.col("text")).otherwise(F.col("__m.text"))).withColumn("n_applied", F.when(header, 0).otherwise(F.size("__m.applied"))).drop("__m")
