"""What follows a named-entity model: labels, thresholds, joined names, trimmed particles, false hits; and the decoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.spans import by_start, none, span, table, words


def map_label(label: Column) -> Column:
    """The category of a label with or without its B-, I-, E- or S-; null for organisations and unknown labels."""
    return F.element_at(table(fixed.MODEL_LABELS), F.regexp_replace(label, "^[BIES]-", ""))


def entity_spans(text: Column, entities: Column) -> Column:
    """array<struct<label,word,start,end,score>> to spans. A missing position is that of the word after the one found last."""
    start = F.struct(F.lit(0).alias("at"), none().alias("out"))

    def place(acc, e):
        category = map_label(e["label"])
        word = F.trim(F.regexp_replace(F.regexp_replace(e["word"], "##", ""), rf"{fixed.SPACE}+", " "))
        known = e["start"].isNotNull() & e["end"].isNotNull() & (e["start"] >= 0) & (e["end"] >= 0)
        rest = F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))
        at = F.when(word != "", F.instr(rest, word)).otherwise(0)
        low = F.when(known, e["start"]).otherwise(acc["at"] + at - 1).cast("int")
        high = F.when(known, e["end"]).otherwise(low + F.length(word)).cast("int")
        keep = category.isNotNull() & (e["score"] >= fixed.MODEL_LEAST) & (known | (at > 0))
        made = span(low, high, F.substring(text, (low + 1).cast("int"), (high - low).cast("int")), category, e["score"], "model")
        return F.when(F.coalesce(keep, F.lit(False)), F.struct(F.when(known, acc["at"]).otherwise(high).cast("int").alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))).otherwise(acc)

    return F.when(entities.isNull(), none()).otherwise(F.aggregate(entities, start, place, lambda acc: acc["out"]))


def merge_adjacent_names(text: Column, spans: Column) -> Column:
    """Names at most one character apart are one; its end is the later one's and its confidence the mean of the two."""
    def step(acc, s):
        prev = F.element_at(acc, -1)
        joined = (F.size(acc) > 0) & (prev["category"] == "person_name") & (s["category"] == "person_name") & (s["start"] - prev["end"] <= 1)
        both = span(prev["start"], s["end"], F.substring(text, (prev["start"] + 1).cast("int"), (s["end"] - prev["start"]).cast("int")), "person_name", (prev["confidence"] + s["confidence"]) / 2, "model")
        return F.when(F.coalesce(joined, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(by_start(spans), none(), step)


def trim_particles(text: Column, spans: Column) -> Column:
    """Up to two particles go from the end of a name of four letters or more."""
    def trimmed(s):
        ends = lambda end: F.substring(text, end.cast("int"), F.lit(1)).isin(fixed.MODEL_PARTICLES) & (end - s["start"] >= 4)
        end = F.when(~ends(s["end"]), s["end"]).when(~ends(s["end"] - 1), s["end"] - 1).otherwise(s["end"] - 2)
        cut = F.struct(s["start"].alias("start"), end.cast("int").alias("end"), F.substring(text, (s["start"] + 1).cast("int"), (end - s["start"]).cast("int")).alias("text"), s["category"].alias("category"), s["confidence"].alias("confidence"), s["source"].alias("source"))
        return F.when((s["category"] == "person_name") & ends(s["end"]), cut).otherwise(s)

    return F.transform(spans, trimmed)


def model_spans(text: Column, entities: Column) -> Column:
    return trim_particles(text, merge_adjacent_names(text, entity_spans(text, entities)))


def filter_false_names(spans: Column) -> Column:
    """Names that are English stopwords, short unsure ASCII words or Korean nouns go."""
    def keep(s):
        word = F.regexp_replace(s["text"], f"^{fixed.SPACE}+|{fixed.SPACE}+$", "")
        short = (F.length(word) <= fixed.SHORT_ASCII) & F.regexp_like(word, F.lit("^[A-Za-z]+$")) & (s["confidence"] < fixed.SHORT_ASCII_CONFIDENCE)
        return (s["category"] != "person_name") | ~(F.array_contains(words(fixed.ENGLISH_STOPWORDS), F.lower(word)) | short | F.array_contains(words(fixed.NOT_MODEL_NAMES), word))

    return F.filter(spans, keep)


def korean_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^가-힯ᄀ-ᇿ㄰-㆏]", "")) / F.length(text)).otherwise(F.lit(0.0))


def pick_model(text: Column, mode: Column, available: Column) -> Column:
    """The tier that a mode asks for, if it is there."""
    has = lambda t: F.coalesce(F.array_contains(available, t), F.lit(False))
    return F.when((mode == "precision_high") & has("tier2-precision"), "tier2-precision").when((mode == "multilingual") & has("tier2-multilingual") & (korean_ratio(text) < fixed.KOREAN_SHARE), "tier2-multilingual").otherwise("tier1-default")
