"""Spans as columns: array<struct<start,end,text,category,confidence,source>>, 0-based code points, end exclusive."""

from __future__ import annotations

import functools
import re

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed

SPAN = "struct<start:int,end:int,text:string,category:string,confidence:double,source:string>"
SPANS = f"array<{SPAN}>"


def let(value: Column, use) -> Column:
    """use(value) with value computed once: inside an expression Spark would else compute it wherever it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def none() -> Column:
    return F.array().cast(SPANS)


def _quoted(value) -> str:
    return ("true" if value else "false") if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def table(values: dict) -> Column:
    """A map of constants, as one expression: a call for each entry takes the driver long."""
    return F.expr("map(" + ", ".join(_quoted(x) for kv in values.items() for x in kv) + ")")


def words(values) -> Column:
    """An array of constants."""
    return F.expr("array(" + ", ".join(map(_quoted, values)) + ")")


_BUILT: dict[tuple, Column] = {}


def built_once(make):
    """Long expressions over a plain column are made once for each session: that takes the driver longer than the work on a
    small table."""
    @functools.wraps(make)
    def built(*columns: Column, **options) -> Column:
        names = tuple(str(c) if isinstance(c, Column) else c for c in columns)
        if options or not all(re.fullmatch(r"Column<'[A-Za-z_][A-Za-z_0-9.]*'>", str(n)) for c, n in zip(columns, names, strict=True) if isinstance(c, Column)):
            return make(*columns, **options)
        context = SparkContext._active_spark_context
        mark = (make.__module__, make.__qualname__, names, id(context), getattr(context, "applicationId", None))
        if mark not in _BUILT:
            _BUILT[mark] = make(*columns)
        return _BUILT[mark]

    return built


def span(start: Column, end: Column, text: Column, category: Column | str, confidence: Column | float, source: str = "regex") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), lit(category).alias("category"), lit(confidence).cast("double").alias("confidence"), F.lit(source).alias("source"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of the matches of a pattern that never matches the empty string.

    What lies between matches and the matches themselves add up to the positions. The cheap test comes first, so that
    most rows pay one search."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(g.alias("gap"), m.alias("text")))
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def place(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["text"])
        more = F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text")))).alias("out"))
        return F.when(x["text"].isNull(), acc).otherwise(more)  # the gap after the last match has none

    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), place, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), placed).otherwise(empty)


def as_spans(found: Column, category: str, confidence: float) -> Column:
    return F.transform(found, lambda m: span(m["start"], m["end"], m["text"], category, confidence))


def before(text: Column, start: Column, n: int) -> Column:
    """The n characters before a position, or as many as there are."""
    low = F.greatest(F.lit(0), start - n)
    return F.substring(text, (low + 1).cast("int"), (start - low).cast("int"))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def rank(category: Column) -> Column:
    return F.coalesce(F.element_at(table({c[0]: c[4] for c in fixed.CATEGORIES}), category), F.lit(0))


#: Items that a running fold appends one by one; its blocks of so many are then joined at once.
BLOCK = 256


def folded(items: Column, state: Column, out: Column, step) -> Column:
    """What step(state, item), a struct<state,out> with an array of what the item gives, gives for all items in order, the state
    handed on. Appending copies an array, so blocks are folded by themselves: near-linear for long arrays."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))

    def inner(acc, x):
        return let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

    def outer(acc, block):
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), out.alias("out")), inner)
        return let(done, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.slice(F.array(out), F.lit(1), F.lit(0)).alias("out"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(blocks, start, outer, lambda acc: acc["out"]))).otherwise(out)


def islands(placed: Column) -> Column:
    """Spans by start as arrays of those that hang together by overlaps: one sweep with the furthest end so far."""
    empty = F.array().cast("array<int>")

    def step(state, s):
        first = F.when(s["s"]["start"] >= state["reach"], F.array(s["i"] + 1)).otherwise(empty)
        return F.struct(F.struct(F.greatest(state["reach"], s["s"]["end"]).alias("reach")).alias("state"), first.alias("out"))

    numbered = F.transform(placed, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    firsts = folded(numbered, F.struct(F.lit(-1).alias("reach")), empty, step)
    cut = lambda firsts: F.zip_with(firsts, F.concat(F.slice(firsts, F.lit(2), F.greatest(F.size(firsts) - 1, F.lit(0))), F.array(F.size(placed) + 1)), lambda a, b: F.slice(placed, a, b - a))
    return let(firsts, cut)


def dedupe(spans: Column) -> Column:
    """Greedy: longer first, then surer, then of the higher category, then as given; what overlaps a kept one goes.

    Where no span overlaps another, all are kept, which one look at neighbours by start tells. Else the choice is made inside
    each island of spans that hang together, since spans of different islands do not meet."""
    def chosen(spans):
        keyed = F.transform(spans, lambda x: F.struct((x["s"]["start"] - x["s"]["end"]).alias("a"), (-x["s"]["confidence"]).alias("b"), (-rank(x["s"]["category"])).alias("c"), x["i"].alias("d"), x["s"].alias("s")))
        ordered = F.transform(F.array_sort(keyed), lambda x: x["s"])
        return F.array_sort(F.aggregate(ordered, none(), lambda acc, s: F.when(F.exists(acc, lambda k: overlap(k, s)), acc).otherwise(F.concat(acc, F.array(s)))))

    def clash(placed):
        late = F.slice(placed, F.lit(2), F.greatest(F.size(placed) - 1, F.lit(0)))
        return F.exists(F.zip_with(placed, late, lambda a, b: F.coalesce(a["end"] > b["start"], F.lit(False))), lambda x: x)

    def by_island(spans):
        placed = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i"), s.alias("s"))))
        parts = let(placed, islands)
        return F.flatten(F.transform(parts, lambda x: F.when(F.size(x) > 1, chosen(x)).otherwise(F.transform(x, lambda y: y["s"]))))

    settled = lambda spans: let(F.array_sort(spans), lambda placed: F.when(clash(placed), by_island(spans)).otherwise(placed))
    return let(spans, lambda spans: F.when(F.size(spans) > 1, settled(spans)).otherwise(spans))


def key(s: Column) -> Column:
    return F.concat_ws(":", s["start"], s["end"], s["category"])


def iou(a: Column, b: Column) -> Column:
    shared = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    union = a["end"] - a["start"] + b["end"] - b["start"] - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def by_start(spans: Column) -> Column:
    """Stable: spans that start together stay as given."""
    return F.transform(F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), i.alias("b"), s.alias("s")))), lambda x: x["s"])


def merge(regex: Column, model: Column) -> Column:
    """All pattern spans, and of the model's, surest first, those that are no repeat and share less than half with any kept."""
    regex, model = F.coalesce(regex, none()), F.coalesce(model, none())
    ordered = F.transform(F.array_sort(F.transform(model, lambda s, i: F.struct((-s["confidence"]).alias("a"), i.alias("b"), s.alias("s")))), lambda x: x["s"])
    kept = F.aggregate(ordered, regex, lambda acc, s: F.when(F.exists(acc, lambda k: (key(k) == key(s)) | (iou(k, s) >= fixed.IOU)), acc).otherwise(F.concat(acc, F.array(s))))
    return by_start(kept)
