"""SQL functions against the same expressions of the DataFrame API, and guards against the patterns that they guard."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import detect as D
from veilspark.functions import fixed, masking, sql
from veilspark.functions.spans import matches

PIECES = ["010-1234-5678", "국민 12 34 56 78 90", "신한 12-34-56-78-90", "a.b@c.example", "SC 123-45-678901", "4111 1111 1111 1111", "900101-1234568", "02-123-4567", "sk-abcdefghijklmnop1", "2024-05-10", "2024년 5월 1일", "우편번호 06024", "서울특별시 강남구 테헤란로 1", "홍길동 부장", "M12345678", "11-25-123456-78", "110-234-567890", "'", "\\", '"', "$1", "\n", " ", "12", "3", "-", "x"]


def random_texts(n, seed=6):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " ", ",", "가"]) for _ in range(rng.randint(0, 8))) for _ in range(n)] + ["", None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(random_texts(300))], "id int, text string").repartition(3).cache()


def test_functions_are_the_expressions(spark, texts):
    sql.register(spark, "pii_detect", "pii_mask", "pii_spans", "pii_detect_bank_account", "pii_categories")
    texts.createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT id, pii_detect(text) AS spans, pii_mask(text) AS masked, pii_mask(text, map('mobile', 'tag', 'account', 'remove')) AS chosen, pii_detect_bank_account(text) AS bank FROM sql_texts")
    modes = F.create_map(F.lit("mobile"), F.lit("tag"), F.lit("account"), F.lit("remove"))
    spans = D.detect(F.col("text"))
    want = texts.select("id", spans.alias("spans"), masking.mask_text(F.col("text"), spans)["text"].alias("masked"), masking.mask_text(F.col("text"), spans, modes)["text"].alias("chosen"), D.detect_kind(F.col("text"), "bank_account").alias("bank"))
    assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(want.collect(), key=lambda r: r["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("InMemory")[0]
    rows = spark.sql("SELECT t.id, s.* FROM sql_texts AS t, LATERAL pii_spans(t.text) AS s ORDER BY id, start").collect()
    assert [tuple(r) for r in rows] == [(r["id"], *s) for r in sorted(want.collect(), key=lambda r: r["id"]) for s in r["spans"]]
    assert spark.sql("SELECT * FROM pii_categories()").count() == len(fixed.CATEGORIES)


def test_functions_by_name(spark):
    assert sql.register(spark, "pii_valid_luhn") == ["pii_valid_luhn"]
    assert spark.sql("SELECT pii_valid_luhn('4111111111111111') AS a, pii_valid_luhn('4111111111111112') AS b, pii_valid_luhn(NULL) AS c").first()[:] == (True, False, False)
    with pytest.raises(ValueError, match="pii_none"):
        sql.register(spark, "pii_none")


def test_guards_lose_nothing(texts):
    kinds = sorted(set(fixed.PATTERNS))
    plain = [F.concat(*(matches(F.col("text"), p) for p in fixed.PATTERNS[k])).alias(k) for k in kinds]
    guarded = [D._found(F.col("text"), k).alias(k) for k in kinds]
    rows = texts.where("text IS NOT NULL")
    assert sorted(rows.select("id", *guarded).collect()) == sorted(rows.select("id", *plain).collect())


def test_detect_finds_what_each_kind_finds(texts):
    """Every span of a kind is in the result or overlaps a kept one."""
    found = texts.where("text IS NOT NULL").select("text", D.detect(F.col("text")).alias("all"), F.concat(*(D.detect_kind(F.col("text"), k) for k in D.ORDER), D.general_names(F.col("text"))).alias("each")).collect()
    assert sum(len(r["each"]) for r in found) > 500
    for r in found:
        for s in r["each"]:
            assert any(k["start"] < s["end"] and s["start"] < k["end"] for k in r["all"]), (r["text"], s)


@pytest.mark.parametrize("text", ["국민 12 34 56 78 90", "신한 12-34-56-78-90", "농협1 2 3 4 5 6 7 8"])
def test_bank_accounts_of_any_groups(spark, text):
    spans = spark.createDataFrame([(text,)], "text string").select(D.detect(F.col("text"))).first()[0]
    assert [(s["text"], s["category"]) for s in spans] == [(text, "account")]
