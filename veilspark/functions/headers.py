"""Header words of table columns, and labels before values in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.spans import built_once, matches, none, span, table

_WORDS = {w: c for c, words in fixed.HEADERS.items() for w in words}


def normalize_header(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), rf"(?:{fixed.SPACE}|[:：()\[\]/·,.\-_])", "")


def category_for_header(text: Column) -> Column:
    """The category that a column of this header holds, or null."""
    return F.element_at(table(_WORDS), normalize_header(text))


def is_name_hint(text: Column) -> Column:
    """Whether names may stand in a column of this header."""
    return F.coalesce(normalize_header(text).isin(fixed.NAME_HINTS), F.lit(False))


@built_once
def inline_labels(text: Column) -> Column:
    """array<struct<label,value_start,value_end,category>>: words of the header list before a colon or an equals sign. The value
    reaches to the next line end, tab or bar, over further labels too."""
    def one(m):
        label = F.trim(F.regexp_extract(m["text"], fixed.INLINE_LABEL, 1))
        value = F.regexp_extract(F.substring(text, (m["end"] + 1).cast("int"), F.length(text)), r"^[^\n\r\t|]*", 0)
        return F.struct(label.alias("label"), m["end"].alias("value_start"), (m["end"] + F.length(value)).alias("value_end"), category_for_header(label).alias("category"))

    found = F.transform(matches(text, fixed.INLINE_LABEL), one)
    return F.filter(found, lambda x: x["category"].isNotNull() & (x["value_end"] > x["value_start"]))


@built_once
def label_spans(text: Column) -> Column:
    cut = lambda x: F.substring(text, (x["value_start"] + 1).cast("int"), (x["value_end"] - x["value_start"]).cast("int"))
    return F.when(text.isNull(), none()).otherwise(F.transform(inline_labels(text), lambda x: span(x["value_start"], x["value_end"], cut(x), x["category"], 1.0)))
