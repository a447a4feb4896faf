"""Detectors: a column of text to a column of spans. Null text has no spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import checksums as C
from veilspark.functions import fixed
from veilspark.functions.model import filter_false_names, model_spans
from veilspark.functions.spans import as_spans, before, built_once, dedupe, let, matches, merge, none, span, words

#: In the order in which spans of equal rank win.
ORDER = ("rrn", "foreign_registration", "passport", "driver_license", "corporate_registration", "business_number", "card", "account", "mobile", "landline", "email", "credential", "bank_account", "date", "postal_code", "address")
_CONFIDENCE = {"rrn": 0.99, "foreign_registration": 0.97, "passport": 0.85, "driver_license": 0.85, "corporate_registration": 0.8, "business_number": 0.95, "card": 0.95, "account": 0.7, "mobile": 0.95, "landline": 0.85, "email": 0.95, "credential": 0.95, "bank_account": 0.85, "address": 0.75}


def _same_digit(d: Column) -> Column:
    return F.regexp_like(d, F.lit(r"^(\d)\1+$"))


#: What a match's digits must be.
_TESTS = {
    "rrn": C.valid_rrn,
    "foreign_registration": C.valid_foreigner,
    "corporate_registration": lambda d: ~_same_digit(d) & ~F.regexp_like(d, F.lit("^.{6}[1-8]")),
    "business_number": C.valid_business,
    "card": lambda d: (F.length(d) == 16) & C.valid_luhn(d),
    "account": lambda d: ~((F.length(d) == 16) & C.valid_luhn(d)),
    "mobile": lambda d: F.length(d).between(10, 11),
    "bank_account": lambda d: F.length(d).between(8, 16) & ~_same_digit(d),
}


def _found(text: Column, kind: str) -> Column:
    parts = [matches(text, p) for p in fixed.PATTERNS[kind]]
    found = parts[0] if len(parts) == 1 else F.concat(*parts)
    if kind not in fixed.GUARDS:
        return found
    return F.when(F.regexp_like(text, F.lit(fixed.GUARDS[kind])), found).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def _by_pattern(text: Column, kind: str) -> Column:
    found = _found(text, kind)
    if kind in _TESTS:
        found = F.filter(found, lambda m: let(C.digits(m["text"]), _TESTS[kind]))
    return as_spans(found, "account" if kind == "bank_account" else kind, _CONFIDENCE[kind])


def _date(text: Column) -> Column:
    def plausible(m, pattern):
        part = lambda i: F.regexp_extract(m["text"], pattern, i).cast("int")
        return C.valid_month_day(part(1), part(2))

    numeric = F.filter(_found(text, "date_numeric"), lambda m: plausible(m, r"^\d{4}[-./](\d+)[-./](\d+)$") & ~F.regexp_like(before(text, m["start"], 20), F.lit(fixed.VERSION_BEFORE)))
    korean = F.filter(_found(text, "date_korean"), lambda m: plausible(m, r"^\d{4}\D+(\d+)\D+(\d+)\D+$"))
    return F.concat(as_spans(numeric, "date", 0.7), as_spans(korean, "date", 0.85))


def _postal(text: Column) -> Column:
    labelled = lambda m: F.regexp_like(before(text, m["start"], 20), F.lit(fixed.POSTAL_LABEL))
    counted = lambda m: F.regexp_like(before(text, m["start"], 20), F.lit(fixed.COUNT_BEFORE))
    around = lambda m: F.concat(before(text, m["start"], 30), F.substring(text, (m["end"] + 1).cast("int"), F.lit(30)))
    kept = F.filter(_found(text, "postal_code"), lambda m: ~counted(m) & (labelled(m) | F.regexp_like(around(m), F.lit(fixed.HANGUL))))
    return F.transform(kept, lambda m: span(m["start"], m["end"], m["text"], "postal_code", F.when(labelled(m), 0.9).otherwise(0.55)))


def _address(text: Column) -> Column:
    def trimmed(m):
        kept = F.regexp_replace(m["text"], rf"(?:{fixed.SPACE}|[,\-])+$", "")
        return span(m["start"], m["start"] + F.length(kept), kept, "address", _CONFIDENCE["address"])

    return F.transform(_found(text, "address"), trimmed)


def _of(text: Column, kind: str) -> Column:
    own = {"date": _date, "postal_code": _postal, "address": _address}
    return own[kind](text) if kind in own else _by_pattern(text, kind)


@built_once
def detect_kind(text: Column, kind: str) -> Column:
    """Spans of one of ORDER, before spans of different kinds are weighed against each other."""
    return F.when(text.isNull(), none()).otherwise(_of(text, kind))


def _last(m: Column) -> Column:
    return F.substring(m["text"], -1, 1)


def _listed(word: Column, listed) -> Column:
    return F.array_contains(words(listed), word)


def _name(text: Column, kind: str) -> Column:
    found = matches(text, fixed.NAME_PATTERNS[kind])
    particle = lambda m: F.instr(F.lit(fixed.PARTICLE_ENDS), _last(m)) > 0
    if kind == "two":
        found = F.filter(found, lambda m: ~_listed(m["text"], [*fixed.NOT_NAMES_2, *fixed.TITLES]) & ~particle(m))
    elif kind == "four":
        found = F.filter(found, lambda m: ~_listed(m["text"], [*fixed.NOT_NAMES_4, *fixed.TITLES]) & ~particle(m) & ~(F.instr(F.lit(fixed.SUFFIX_ENDS), _last(m)) > 0))
    elif kind == "bare":
        found = F.filter(found, lambda m: ~_listed(m["text"], [*fixed.NOT_NAMES_3, *fixed.STUDIES, *fixed.TITLES]) & ~particle(m))
    elif kind == "roman":
        found = F.filter(found, lambda m: ~_listed(m["text"], fixed.NOT_ROMAN_NAMES))
    return as_spans(found, "person_name", {"two": 0.5, "four": 0.4, "bare": 0.6, "title": 0.85, "file": 0.7, "roman": 0.5}[kind])


@built_once
def name_kind(text: Column, kind: str) -> Column:
    """Names of one of the keys of NAME_PATTERNS."""
    return F.when(text.isNull(), none()).otherwise(_name(text, kind))


def _names(text: Column, kinds) -> Column:
    hangul = [k for k in kinds if k != "roman"]
    korean = F.when(F.regexp_like(text, F.lit(fixed.HANGUL)), F.concat(*(_name(text, k) for k in hangul))).otherwise(none())
    return F.when(text.isNull(), none()).otherwise(dedupe(F.concat(korean, _name(text, "roman"))))


GENERAL = ("bare", "title", "file", "roman")


@built_once
def general_names(text: Column) -> Column:
    """Names that running text gives away: surname and two letters, before a title or a document noun, in Roman letters."""
    return _names(text, GENERAL)


@built_once
def contextual_names(text: Column) -> Column:
    """Names in cells whose column promises them, where two and four letters count too."""
    return _names(text, ("two", "four", "bare", "title", "file", "roman"))


@built_once
def detect(text: Column) -> Column:
    """All spans of a text, none of them overlapping, by position."""
    digits = [k for k in ORDER if k not in ("email", "credential", "address")]
    numbers = lambda t: F.when(F.regexp_like(t, F.lit("[0-9]")), F.concat(*(_of(t, k) for k in digits))).otherwise(none())
    others = lambda t: F.concat(*(_of(t, k) for k in ("email", "credential", "address")))
    # the order of kinds decides between equal spans only; ranks of the kinds here differ from those of numbers
    found = lambda t: dedupe(F.concat(numbers(t), others(t), _names(t, GENERAL)))
    return F.when(text.isNull(), none()).otherwise(let(text, found))


@built_once
def detect_with_model(text: Column, entities: Column) -> Column:
    """Spans of the patterns and of a model: its entities array<struct<label,word,start,end,score>>, without false names, go
    where they repeat no pattern's span and share less than half with any. Null entities, as where the model failed, leave
    the patterns alone; so does an empty array."""
    return merge(detect(text), F.coalesce(filter_false_names(model_spans(text, entities)), none()))
