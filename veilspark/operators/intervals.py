"""Span tables: a row for each span (keys, start, end, ...), joined where they overlap and matched one to one.

Arrays in a row hold the spans of one text from one source; tables hold expected and found spans from different places, any
number of them in one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.evaluation import hull_ratio, scores
from veilspark.stored import stored

#: Rounds of matching before what is left is settled island by island.
ROUNDS = 12


def _merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that is merged and never broadcast: Spark plans by the bytes of stored files, of which narrow
    columns of many rows have few, while the driver would hold each row."""
    return df.hint("merge")


def _level(start: Column, end: Column) -> Column:
    """The least power of two that is no less than the span is long."""
    return F.ceil(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))).cast("int")


def _binned(spans: DataFrame, keys: list[str], side: str, levels: list[int]) -> DataFrame:
    """A row for each bin that a span lies in, at its own level and at each higher one that is there: two at a level at most."""
    own, start, last = _level(F.col("start"), F.col("end")), F.col("start").cast("long"), F.greatest(F.col("end") - 1, F.col("start")).cast("long")

    def bins(n: int) -> Column:
        inside = F.transform(F.sequence(F.shiftright(start, n), F.shiftright(last, n)), lambda b: F.struct(F.lit(n).alias("level"), b.alias("bin")))
        return F.when(own <= n, inside).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))

    at = F.flatten(F.array(*map(bins, levels)))
    rest = [c for c in spans.columns if c not in keys]
    return spans.select(*keys, F.struct(*rest).alias(side), own.alias(f"__{side}"), F.explode(at).alias("__at"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, l, r): pairs of spans of the same keys that share a position, as structs of their other columns.

    An equi-join by keys and bins. Bins are as wide as the longer span of a pair, so a span lies in two of them at most
    however long it is, and a pair is reported in the first bin that both lie in. An empty span overlaps those that it lies inside of; null keys meet nothing."""
    both = left.select("start", "end").unionByName(right.select("start", "end"))
    levels = sorted(r[0] for r in both.select(_level(F.col("start"), F.col("end"))).distinct().collect())  # 32 at most
    if not levels:
        levels = [0]
    met = _binned(left, keys, "l", levels).join(_merged(_binned(right, keys, "r", levels)), [*keys, "__at"])
    first = F.expr("shiftright(cast(greatest(l.start, r.start) AS bigint), __at.level)")
    fits = (F.col("__at.level") == F.greatest("__l", "__r")) & (F.col("__at.bin") == first) & (F.col("l.start") < F.col("r.end")) & (F.col("r.start") < F.col("l.end"))
    return met.where(fits).select(*keys, "l", "r")


def _rounds(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, left): pairs (e, p) that one look settles, and those that wait for others. A pair is settled where p is the first
    that e may still have and no earlier e may have p."""
    first = pairs.groupBy("g", "e").agg(F.min("p").alias("p"))
    least = pairs.groupBy("g", "p").agg(F.min("e").alias("e"))
    done = stored(first.join(_merged(least), ["g", "e", "p"]))
    left = pairs.join(_merged(done.select("g", "e")), ["g", "e"], "left_anti").join(_merged(done.select("g", "p")), ["g", "p"], "left_anti")
    return done, stored(left)


def one_to_one(expected: DataFrame, predicted: DataFrame, keys: list[str], least: float = 0.5, same_category: bool = False) -> DataFrame:
    """(*keys, e, p): for each expected span, in order of its column i, the first predicted one, in order of its column i, that is
    free and fits as in ``evaluation.match``. Columns: keys, i, start, end, category.

    The earlier of two decides, but only where they want the same span: pairs that depend on none are settled at once, then
    those that depended on them. After ROUNDS rounds what is still left is settled text by text."""
    fits = F.col("l.category") == F.col("r.category") if same_category else hull_ratio(F.col("l"), F.col("r")) >= least
    near = overlapping(expected, predicted, keys).where(fits)
    pairs = stored(near.select(F.struct(*keys).alias("g"), F.col("l.i").alias("e"), F.col("r.i").alias("p")))
    found = None
    for _ in range(ROUNDS):
        done, pairs = _rounds(pairs)
        found = done if found is None else found.unionByName(done)
        if not pairs.limit(1).count():
            break
    else:
        wanted = pairs.groupBy("g", "e").agg(F.sort_array(F.collect_set("p")).alias("ps"))
        texts = wanted.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("e", "ps"))).alias("es"))
        empty = F.array().cast("array<struct<e:bigint,p:bigint>>")

        def step(acc, e):
            free = F.filter(e["ps"], lambda p: ~F.exists(acc, lambda t: t["p"] == p))
            return F.when(F.size(free) > 0, F.concat(acc, F.array(F.struct(e["e"].cast("long").alias("e"), free[0].cast("long").alias("p"))))).otherwise(acc)

        rest = texts.select("g", F.explode(F.aggregate("es", empty, step)).alias("t")).select("g", "t.e", "t.p")
        found = found.unionByName(rest.select("g", *(F.col(c).cast(found.schema[c].dataType).alias(c) for c in ("e", "p"))))
    return found.select(*(F.col("g").getField(k).alias(k) for k in keys), "e", "p")


def evaluate_tables(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """What ``evaluation.evaluate`` gives, for span tables (keys, i, start, end, category)."""
    pairs = stored(one_to_one(expected, predicted, keys, same_category=True))
    hit = pairs.select(*keys, F.col("e").alias("i"), F.lit(1).alias("tp"))
    told = expected.join(_merged(hit), [*keys, "i"], "left").select("category", F.coalesce("tp", F.lit(0)).alias("tp"), F.lit(0).alias("fp"), (1 - F.coalesce("tp", F.lit(0))).alias("fn"))
    false = predicted.join(_merged(pairs.select(*keys, F.col("p").alias("i"))), [*keys, "i"], "left_anti").select("category", F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))
    sums = told.unionByName(false).groupBy("category").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return sums.select("category", "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn"), 1.0))


def as_table(cases: DataFrame, keys: list[str], spans: str) -> DataFrame:
    """(keys, i, start, end, category) of a column of span arrays; i is the place in the array."""
    return cases.select(*keys, F.posexplode(spans).alias("i", "s")).select(*keys, "i", "s.start", "s.end", "s.category")

