"""Review of what was found in a file before it is masked: groups, counts, keys switched on and off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.spans import key
from veilspark.operators.control import segment_label


def keys_of(spans: Column, category: Column | str | None = None) -> Column:
    """The distinct keys of spans, of one category or of all."""
    chosen = spans if category is None else F.filter(spans, lambda s: s["category"] == category)
    return F.array_distinct(F.transform(chosen, key))


def toggle(keys: Column, spans: Column, on: Column | bool, category: Column | str | None = None) -> Column:
    """keys with those of a category, or of all spans, added or taken away; the order of what stays is kept."""
    on = on if isinstance(on, Column) else F.lit(on)
    return F.when(on, F.array_union(keys, keys_of(spans, category))).otherwise(F.array_except(keys, keys_of(spans, category)))


def switched_off(spans: Column, keys: Column) -> Column:
    """Keys of spans that are not on."""
    return F.array_except(keys_of(spans), keys)


def visible_categories(spans: Column) -> Column:
    """The categories that occur, in display order."""
    return F.array_intersect(F.array(*(F.lit(c[0]) for c in fixed.CATEGORIES)), F.transform(spans, lambda s: s["category"]))


def auto_apply(n_spans: Column, flag: Column) -> Column:
    """Whether a file goes on without review: nothing was found, or its user asked for that."""
    return (F.coalesce(n_spans, F.lit(0)) == 0) | F.coalesce(flag, F.lit(False))


def counts(found: DataFrame, file: list[str], keys: str = "keys") -> DataFrame:
    """(*file, category, total, on) of rows with spans and keys: spans of each category and how many of them are on. Null keys
    turn all on."""
    rows = found.select(*file, keys, F.explode("spans").alias("s"))
    on = F.col(keys).isNull() | F.coalesce(F.array_contains(keys, key(F.col("s"))), F.lit(False))
    return rows.groupBy(*file, F.col("s.category").alias("category")).agg(F.count("*").alias("total"), F.count_if(on).alias("on"))


def groups(found: DataFrame) -> DataFrame:
    """(path, seq, seg_id, label, spans, flat, large) of segments (path, ext, seq, seg_id, spans) that hold any span, in the order of
    path and seq. A file of few spans is flat: its spans are shown without segments; one of very many is large."""
    some = found.where(F.size("spans") > 0)
    total = some.groupBy("path").agg(F.sum(F.size("spans")).alias("total"))
    return some.join(total, "path").select("path", "seq", "seg_id", segment_label(F.col("seg_id"), F.col("ext")).alias("label"), "spans", (F.col("total") <= fixed.FLAT).alias("flat"), (F.col("total") > fixed.LARGE).alias("large"))
