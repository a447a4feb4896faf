"""Span tables against brute force, admission against a walk, and folds over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import control, evaluation, intervals
from veilspark.operators.scan import scan

COLUMNS = "doc long, i int, start long, end long, category string"


def spans(rng, docs, n, longest):
    out = []
    for d in range(docs):
        for i in range(rng.randint(0, n)):
            s = rng.randint(0, 60)
            out.append((d if d else None, i, s, s + rng.choice([0, 1, 2, 5, 9, longest]), rng.choice("ab")))
    return out


def test_overlaps_of_any_length(spark):
    rng = random.Random(3)
    left, right = spans(rng, 8, 12, 5000), spans(rng, 8, 12, 70)
    got = intervals.overlapping(spark.createDataFrame(left, COLUMNS), spark.createDataFrame(right, COLUMNS), ["doc"])
    found = sorted((r["doc"], r["l"]["i"], r["r"]["i"]) for r in got.collect())
    assert found == sorted((a[0], a[1], b[1]) for a in left for b in right if a[0] is not None and a[0] == b[0] and a[2] < b[3] and b[2] < a[3])
    assert len(found) > 50 and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert intervals.overlapping(spark.createDataFrame([], COLUMNS), spark.createDataFrame(right, COLUMNS), ["doc"]).count() == 0


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("rounds", [1, 12])
def test_one_to_one_is_the_greedy_choice(spark, monkeypatch, same, rounds):
    monkeypatch.setattr(intervals, "ROUNDS", rounds)
    rng = random.Random(rounds)
    left, right = spans(rng, 10, 14, 6), spans(rng, 10, 14, 6)
    ladder = [(99, i, 2 * i, 2 * i + 3, "a") for i in range(40)]  # each waits for the one before
    frames = [spark.createDataFrame([(99 if d is None else d, *rest) for d, *rest in x] + [(100 if d == 99 else d, i, s + o, e + o, c) for d, i, s, e, c in ladder], COLUMNS) for x, o in ((left, 0), (right, 1))]
    got = {tuple(r) for r in intervals.one_to_one(*frames, ["doc"], same_category=same).select("doc", "e", "p").collect()}
    packed = [f.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("i", "start", "end", "category"))).alias(n)) for f, n in zip(frames, ("expected", "predicted"), strict=True)]
    both = packed[0].join(packed[1], "doc").select("doc", "expected", "predicted", F.explode(evaluation.match(F.col("predicted"), F.col("expected"), same_category=same)).alias("t"))
    want = {(r["doc"], r["expected"][r["t"]["e"]]["i"], r["predicted"][r["t"]["p"]]["i"]) for r in both.collect()}
    assert got == want and len(want) > 30


def test_span_tables_are_never_broadcast(spark, monkeypatch):
    """Stored tables look small by their files: no join of span tables, of the rounds or of the counts is planned as a broadcast."""
    planned, keep = [], intervals.stored
    monkeypatch.setattr(intervals, "stored", lambda df: planned.append(df) or keep(df))
    table = lambda shift: keep(spark.range(3000).selectExpr("id AS doc", "0 AS i", f"id % 9 + {shift} AS start", f"id % 9 + {shift} + 3 AS end", "'a' AS category"))
    r = intervals.evaluate_tables(table(0), table("if(id % 4 = 0, 5, 1)"), ["doc"])
    assert [tuple(x)[:4] for x in r.collect()] == [("a", 2250, 750, 750)]
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in [*planned, r]]
    assert not any("Broadcast" in p for p in plans) and sum(p.count("SortMergeJoin") for p in plans) >= 6


def test_admission_of_one_long_queue(spark):
    rng = random.Random(8)
    rows = [("big", i, rng.choice([0, 1, 2, 3, 50, 90, 400, None])) for i in range(900)] + [(q, i, rng.randint(0, 80)) for q in ("a", "b", None) for i in range(30)]
    want, room = {}, {}
    for q, i, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        n, left = n or 0, room.setdefault(q, 300)
        want[q, i] = "file-too-large" if n > 100 else None if n <= left else "queue-total-exceeded"
        room[q] = left - n if want[q, i] is None else left
    df = spark.createDataFrame([(*r, "x") for r in rows], "queue string, i long, size long, `a.b` string").repartition(5)
    assert {(r["queue"], r["i"]): r["reason"] for r in control.admit(df, "queue", "i", max_file=100, max_queue=300).collect()} == want
    assert control.admit(df, "queue", "i").columns == ["queue", "i", "size", "a.b", "reason"] and control.admit(df.limit(0), "queue", "i").count() == 0


def test_odd_queues_are_walked_in_the_end(spark, monkeypatch):
    monkeypatch.setattr(control, "ROUNDS", 2)
    sizes = [x for k in range(12) for x in (1, 100 - k)]
    df = spark.createDataFrame([("q", i, n) for i, n in enumerate(sizes)], "queue string, i long, size long")
    room, want = 100, {}
    for i, n in enumerate(sizes):
        want[i] = None if n <= room else "queue-total-exceeded"
        room -= n if n <= room else 0
    assert {r["i"]: r["reason"] for r in control.admit(df, "queue", "i", max_file=200, max_queue=100).collect()} == want


def test_scan_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "x", "x", "y", "z"]), i, rng.randrange(9), rng.randrange(1 << 40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i long, a long, b long, c long").repartition(5)
    got = {r["i"]: (r["a"], r["b"], r["c"]) for r in scan(df, ["g"], ["i"], add=("a",), xor=("b",), last=("c",)).collect()}
    want, state = {}, {}
    for g, i, a, b, c in sorted(rows, key=lambda r: (r[0], r[1])):
        s, x, prev = state.get(g, (0, 0, None))
        want[i] = (s + a, x ^ b, prev)
        state[g] = (s + a, x ^ b, c)
    assert got == want


def test_islands_of_many_spans(spark):
    """Pairs that overlap, 20,000 of them in one text, take time in proportion."""
    import time

    from veilspark.functions import masking
    from veilspark.functions import spans as S

    took = []
    for n in (2_500, 20_000):
        pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array(*(S.span(i * 10 + a, i * 10 + b, F.lit("x"), c, 0.9) for a, b, c in ((0, 6, "mobile"), (4, 8, "card"))))))
        df = spark.range(1).select(F.shuffle(pairs, F.lit(1)).alias("s"))
        began = time.time()
        r = df.select(S.dedupe(F.col("s")).alias("s")).select(F.size("s"), F.size(masking.disjoint(F.col("s"))), F.col("s")[n - 1]["start"]).first()
        took.append(time.time() - began)
        assert tuple(r) == (n, n, (n - 1) * 10)
    assert took[1] < 8 * max(took[0], 1.5), took


def test_dedupe_and_disjoint_against_brute_force(spark):
    from veilspark.functions import fixed, masking
    from veilspark.functions import spans as S

    rng, rank = random.Random(12), {c[0]: c[4] for c in fixed.CATEGORIES}
    rows = []
    for i in range(120):
        got = []
        for _ in range(rng.choice([0, 1, 2, 3, 6, 30, 300])):
            s = rng.randint(0, rng.choice([10, 200, 3000]))
            got.append((s, s + rng.choice([0, 1, 3, 8]), "x", rng.choice(["mobile", "card", "odd"]), rng.choice([0.5, 0.9]), "regex"))
        rows.append((i, got))
    df = spark.createDataFrame(rows, f"i int, s {S.SPANS}").select("i", S.dedupe(F.col("s")).alias("d"), masking.disjoint(F.col("s")).alias("a"))
    for r in df.collect():
        kept = []
        for s in [x for _, x in sorted(enumerate(rows[r["i"]][1]), key=lambda t: (t[1][0] - t[1][1], -t[1][4], -rank.get(t[1][3], 0), t[0]))]:
            if not any(k[0] < s[1] and s[0] < k[1] for k in kept):
                kept.append(s)
        assert sorted(map(tuple, r["d"])) == sorted(kept) and [x["start"] for x in r["d"]] == sorted(x[0] for x in kept)
        apart = []
        for s in sorted(rows[r["i"]][1], key=lambda s: s[0]):
            if not apart or s[0] >= apart[-1][1]:
                apart.append(s)
        assert list(map(tuple, r["a"])) == apart


@pytest.mark.parametrize("scheme,tags", [("bio", ["O", "B-X", "I-X", "B-Y", "I-Y"]), ("bioes", ["O", "B-X", "I-X", "E-X", "S-X"])])
def test_rows_of_any_length_are_decoded_together(spark, monkeypatch, scheme, tags):
    import itertools

    from veilspark.operators import decoding

    monkeypatch.setattr(decoding, "CELLS", 60)
    rng, allowed = random.Random(9), decoding._allowed(tags, scheme)
    rows = [(i, None if i == 5 else [[-rng.random() for _ in tags] for _ in range(rng.choice([0, 1, 2, 5]))]) for i in range(40)]
    got = spark.createDataFrame(rows, "i int, s array<array<double>>").repartition(3).select("i", decoding.viterbi(F.col("s"), tags, scheme).alias("s")).collect()
    assert len(got) == 40
    for r in got:
        s = rows[r["i"]][1] or []
        paths = (p for p in itertools.product(range(len(tags)), repeat=len(s)) if not p or allowed[-1][p[0]] and all(allowed[a][b] for a, b in itertools.pairwise(p)))
        best = max(paths, key=lambda p: sum(s[t][k] for t, k in enumerate(p)))
        want, t = [], 0
        while t < len(best):
            kind, _, category = tags[best[t]].partition("-")
            end = t + 1
            while kind == "B" and end < len(best) and tags[best[end]][0] in "IE":
                end += 1
            if kind in "BS":
                want.append((t, end, category, pytest.approx(sum(s[u][best[u]] for u in range(t, end)) / (end - t))))
            t = end
        assert [tuple(x) for x in r["s"]] == want
