"""The driver keeps every plan that it runs, so none may grow with the number of joins behind it."""

import re

from veilspark.llm import base, components, ngramjoin

MOST = 16


def test_plans_of_the_join_stay_small(spark, monkeypatch):
    seen, stash = [], base.stash

    def counted(df):
        seen.append(len(re.findall(r"Exchange ", df._jdf.queryExecution().executedPlan().toString())))
        return stash(df)

    for module in (base, components, ngramjoin):
        monkeypatch.setattr(module, "stash", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(9, 8)], "a long, b long")
    assert {r["k"]: r["root"] for r in components.connected(edges).collect()} == {**{i: 0 for i in range(6)}, 8: 8, 9: 8}
    assert max(seen) <= MOST
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words[::-1]), "two words", None]
    kept = counted(ngramjoin.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4] and max(seen) <= MOST
