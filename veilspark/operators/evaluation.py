"""Quality of detection: spans found against spans expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.spans import overlap


def expected_spans(text: Column, expected: Column) -> Column:
    """array<struct<text,category>> to spans at the first place of each text; one that is not there is an error."""
    def place(e):
        at = F.instr(text, e["text"])
        low = F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("expected text is not in the input: "), e["text"])).cast("int"))
        return F.struct(low.cast("int").alias("start"), (low + F.length(e["text"])).cast("int").alias("end"), e["text"].alias("text"), e["category"].alias("category"))

    return F.transform(expected, place)


def hull_ratio(a: Column, b: Column) -> Column:
    return F.when(overlap(a, b), (F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])) / (F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"]))).otherwise(0.0)


def match(predicted: Column, expected: Column, least: float = 0.5, same_category: bool = False) -> Column:
    """array<struct<e,p>>: pairs of positions, each expected span with the first free predicted one that it fits.

    Spans fit if they share at least ``least`` of their hull, or with same_category if they overlap and have one category."""
    def fits(e, p):
        return overlap(e, p) & (e["category"] == p["category"]) if same_category else hull_ratio(e, p) >= least

    def step(acc, e):
        free = F.filter(F.transform(predicted, lambda p, j: F.struct(j.alias("j"), p.alias("p"))), lambda x: fits(e["e"], x["p"]) & ~F.exists(acc, lambda t: t["p"] == x["j"]))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(F.struct(e["i"].alias("e"), free[0]["j"].alias("p"))))).otherwise(acc)

    pairs = F.array().cast("array<struct<e:int,p:int>>")
    return F.aggregate(F.transform(expected, lambda e, i: F.struct(i.alias("i"), e.alias("e"))), pairs, step)


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def scores(tp: Column, fp: Column, fn: Column, empty: float = 0.0) -> list[Column]:
    """precision, recall and f1 of counts; ``empty`` where there is nothing to count."""
    p, r = _ratio(tp, tp + fp, empty), _ratio(tp, tp + fn, empty)
    return [p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r, 0.0).alias("f1")]


def evaluate(cases: DataFrame) -> DataFrame:
    """(category, tp, fp, fn, precision, recall, f1) of cases with predicted and expected spans, by category and overlap."""
    paired = cases.select("predicted", "expected", match(F.col("predicted"), F.col("expected"), same_category=True).alias("pairs"))
    hit = lambda side: F.transform(side, lambda s, i: F.struct(s["category"].alias("category"), i.alias("i")))
    rows = paired.select(F.explode(F.concat(
        F.transform(hit(F.col("expected")), lambda x: F.struct(x["category"].alias("category"), F.exists("pairs", lambda t: t["e"] == x["i"]).cast("int").alias("tp"), F.lit(0).alias("fp"), (~F.exists("pairs", lambda t: t["e"] == x["i"])).cast("int").alias("fn"))),
        F.transform(F.filter(hit(F.col("predicted")), lambda x: ~F.exists("pairs", lambda t: t["p"] == x["i"])), lambda x: F.struct(x["category"].alias("category"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))),
    )).alias("x"))
    sums = rows.groupBy(F.col("x.category").alias("category")).agg(*(F.sum(f"x.{c}").alias(c) for c in ("tp", "fp", "fn")))
    return sums.select("category", "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn"), 1.0))


def gate(report: DataFrame, negative_hits: Column | int) -> DataFrame:
    """(name_f1, negative_hits, passed) of an evaluation: names' F1 and hits in texts that hold nothing."""
    hits = negative_hits if isinstance(negative_hits, Column) else F.lit(negative_hits)
    f1 = F.coalesce(F.max(F.when(F.col("category") == "person_name", F.col("f1"))), F.lit(0.0))
    return report.agg(f1.alias("name_f1")).select("name_f1", hits.alias("negative_hits"), ((F.col("name_f1") >= fixed.NAME_F1) & (hits <= fixed.NEGATIVE_HITS)).alias("passed"))


CASES = "array<struct<id:string,kind:string,text:string,expected:array<struct<text:string,category:string>>>>"


def read_cases(json: Column) -> Column:
    """CASES of a JSON object {"cases": [...]}; null where it is none."""
    return F.from_json(json, f"struct<cases:{CASES}>")["cases"]


def written_cases(cases: Column) -> Column:
    return F.to_json(F.struct(cases.alias("cases")))


def false_hits(cases: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """Of texts that hold nothing, the first ``most`` spans found, by the columns ``by`` and by start: a report's sample."""
    rows = cases.where(F.size("expected") == 0).select(*by, F.explode("predicted").alias("s"))
    return rows.orderBy(*by, "s.start").limit(most).select(*by, "s.text", "s.category")


def latency(cases: DataFrame, took: str, by: list[str] | None = None) -> DataFrame:
    """(n_cases, total, average) of a column of times; nulls count as cases without a time."""
    return cases.groupBy(*(by or [])).agg(F.count("*").alias("n_cases"), F.coalesce(F.sum(took), F.lit(0.0)).cast("double").alias("total"), F.avg(took).alias("average"))


def gates(report: DataFrame, least: dict[str, float]) -> DataFrame:
    """(category, precision, recall, least, passed) for each gated category of an evaluation."""
    table = F.create_map(*(F.lit(x) for kv in least.items() for x in kv))
    gated = report.select("category", "precision", "recall", F.element_at(table, F.col("category")).alias("least")).where("least IS NOT NULL")
    return gated.withColumn("passed", (F.col("precision") >= F.col("least")) & (F.col("recall") >= F.col("least")))
