"""Connected components of an edge table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.base import hot_keys, spread_join, stash


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One pass, stored: every node's larger (or smaller) neighbours are tied to the least node near it. total is the number of
    edges before the round, which bounds those of each pass. What a pass reads more than once is stored, so that plans stay
    small: the driver keeps each of them."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stash(near.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")))
    tied = spread_join(near, least.select("a", "m"), "a", hot=hot_keys(least, "a", total))
    tied = tied.where("b > a").select("b", "m") if large else tied.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m"))
    return stash(tied.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(k, root) for each node of ``edges`` (a, b): root is the least node that it reaches.

    Large-star and small-star passes alternate until the edges are stars, in about log(n) rounds. Only a count and a
    checksum of the edges come to the driver. Each pass is stored, which cuts its lineage."""
    edges = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen, total = None, edges.count()
    for _ in range(rounds):
        edges = _stars(_stars(edges, True, total), False, total)
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen, total = mark, mark[0]
    else:
        raise RuntimeError("components did not settle")
    # after the last pass each edge ties a node to its root
    return edges.select(F.col("a").alias("k"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("k"), F.col("b").alias("root")).distinct())
