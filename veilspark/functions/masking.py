"""Masks: what stands in for a span, and whole texts with their spans masked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.spans import SPANS, by_start, folded, key, let, none, table


def _shaped(text: Column, pattern: str, to: str) -> Column:
    """The template of the groups where the whole text has the pattern; else every digit is an X."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_replace(text, pattern, to)).otherwise(F.regexp_replace(text, "[0-9]", "X"))


def _first_group(text: Column) -> Column:
    head = F.regexp_extract(text, "^[^0-9]*[0-9]*", 0)
    return F.concat(head, F.regexp_replace(F.substring(text, (F.length(head) + 1).cast("int"), F.length(text)), "[0-9]", "X"))


def _account(text: Column) -> Column:
    """Digits with three or more digits on either side."""
    n = F.length(F.regexp_replace(text, "[^0-9]", ""))
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def step(acc, c):
        digit = c.between("0", "9")
        hidden = digit & (acc["seen"] >= 3) & (n - acc["seen"] - 1 >= 3)
        return F.struct((acc["seen"] + digit.cast("int")).alias("seen"), F.concat(acc["out"], F.when(hidden, "X").otherwise(c)).alias("out"))

    return F.aggregate(letters, F.struct(F.lit(0).alias("seen"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def _email(text: Column) -> Column:
    parts = [F.regexp_extract(text, "^([^@])([^@]*)(@.+)$", i) for i in (1, 2, 3)]
    return F.when(F.regexp_like(text, F.lit("^[^@][^@]*@.+$")), F.concat(parts[0], F.repeat(F.lit("*"), F.greatest(F.lit(2), F.length(parts[1]))), parts[2])).otherwise(text)


def mask_shape(text: Column, category: Column) -> Column:
    """The form stays, the content goes. Categories without a form of their own become dots."""
    dots = lambda n: F.repeat(F.lit("●"), n.cast("int"))
    out = (
        F.when(category.isin("mobile", "landline"), _first_group(text)).when(category == "account", _account(text)).when(category == "email", _email(text))
        .when(category == "passport", F.concat(F.substring(text, 1, 1), F.repeat(F.lit("X"), F.greatest(F.lit(0), F.length(text) - 1))))
        .when(category == "postal_code", F.regexp_replace(text, "[0-9]", "X")).when(category == "credential", dots(F.least(F.length(text), F.lit(16))))
    )
    for kind, (pattern, to) in fixed.SHAPES.items():
        out = out.when(category == kind, _shaped(text, pattern, to))
    return out.otherwise(dots(F.greatest(F.lit(2), F.length(text))))


def mask_partial(text: Column, category: Column) -> Column:
    """A name keeps its first letter, from three letters on its last too; other categories their shape."""
    n = F.length(text)
    name = F.when(n <= 1, text).when(n == 2, F.concat(F.substring(text, 1, 1), F.lit("O"))).otherwise(F.concat(F.substring(text, 1, 1), F.repeat(F.lit("O"), F.greatest(n - 2, F.lit(0))), F.substring(text, -1, 1)))
    return F.when(category == "person_name", name).otherwise(mask_shape(text, category))


def apply_mask(text: Column, category: Column, mode: Column) -> Column:
    return (
        F.when(mode == "shape", mask_shape(text, category)).when(mode == "partial", mask_partial(text, category)).when(mode == "tag", F.element_at(table(fixed.TAGS), category))
        .when(mode == "fake", F.element_at(table(fixed.FAKES), category)).when(mode == "remove", F.lit(""))
    )


def disjoint(spans: Column) -> Column:
    """Spans by start without those that begin before the one kept last ends, whether or not that one is enabled."""
    def step(state, s):
        late = s["start"] < state["end"]
        return F.struct(F.struct(F.when(late, state["end"]).otherwise(s["end"]).alias("end")).alias("state"), F.when(late, none()).otherwise(F.array(s)).alias("out"))

    return let(by_start(spans), lambda ordered: folded(ordered, F.struct(F.lit(-1).alias("end")), none(), step))


def mask_text(text: Column, spans: Column, modes: Column | None = None, enabled: Column | None = None, keys: Column | None = None, default: str = "shape") -> Column:
    """struct<text,applied,skipped>: the text with its spans masked.

    modes and enabled are maps by category, keys an array of span keys; a null keys enables all spans, an empty one none.
    A disabled span still shadows later ones that it overlaps."""
    one = F.create_map(F.lit("_"), F.lit("shape"))
    modes = F.coalesce(modes, one) if modes is not None else one
    flags = F.create_map(F.lit("_"), F.lit(True))
    enabled = F.coalesce(enabled, flags) if enabled is not None else flags
    keys = keys if keys is not None else F.lit(None).cast("array<string>")

    def on(s):
        return F.coalesce(F.element_at(enabled, s["category"]), F.lit(True)) & (keys.isNull() | F.coalesce(F.array_contains(keys, key(s)), F.lit(False)))

    def masked(kept):
        """Each enabled span's mask after what lies between it and the one before; then the rest."""
        def piece(s, i):
            low = F.when(i > 0, F.element_at(kept, F.greatest(i, F.lit(1)))["end"]).otherwise(0)
            return F.concat(F.substring(text, (low + 1).cast("int"), (s["start"] - low).cast("int")), apply_mask(s["text"], s["category"], F.coalesce(F.element_at(modes, s["category"]), F.lit(default))))

        rest = F.substring(text, (F.coalesce(F.element_at(F.transform(kept, lambda s: s["end"]), -1), F.lit(0)) + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(kept, piece), ""), rest)

    def result(apart):
        return let(F.filter(apart, on), lambda kept: F.struct(F.when(F.size(kept) > 0, masked(kept)).otherwise(text).alias("text"), kept.alias("applied"), F.filter(apart, lambda s: ~on(s)).alias("skipped")))

    whole = F.struct(text.alias("text"), F.array().cast(SPANS).alias("applied"), F.array().cast(SPANS).alias("skipped"))
    return let(spans, lambda spans: F.when(F.size(spans) > 0, let(disjoint(spans), result)).otherwise(whole))


def parts(text: Column, spans: Column) -> Column:
    """array<struct<start,end,text,category>>: a text cut into marked and unmarked parts; unmarked have a null category."""
    kind = "array<struct<start:int,end:int,text:string,category:string>>"
    piece = lambda a, b, c: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.substring(text, (a + 1).cast("int"), (b - a).cast("int")).alias("text"), c.cast("string").alias("category"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece(acc["at"], s["start"], F.lit(None)), piece(s["start"], s["end"], s["category"]))).alias("out"))
    cut = F.aggregate(disjoint(spans), start, step, lambda acc: F.concat(acc["out"], F.array(piece(acc["at"], F.length(text), F.lit(None)))))
    return F.filter(cut, lambda p: p["end"] > p["start"])
