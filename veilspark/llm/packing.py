"""Operator 10, packing: optimal length buckets.

Dynamic programming over the global histogram of encoded lengths chooses the bucket boundaries that
minimise padding; batches within a token budget form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm import lengths
from veilspark.llm.base import doc_id, stash

#: Buckets, padded tokens in a batch at most (a single longer document still gets its own), rows ranked by one task.
BUCKETS, TOKEN_BUDGET, RANK_ROWS = 16, 65_536, 50_000


def best_boundaries(length: np.ndarray, n_docs: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Top lengths of at most ``buckets`` buckets with the least padding in all; ``length`` ascends.

    cost(j) = min over i of cost(i) + length[j] * docs in (i, j]: for each number of buckets a lower
    envelope of lines, asked at ascending lengths."""
    if not len(length):
        return []
    docs = np.concatenate([[0], np.cumsum(n_docs)]).astype(object).tolist()
    size, n = [int(x) for x in length], len(length)
    cost: list = [0] + [None] * n
    back: list[list[int]] = []
    for _ in range(min(buckets, n)):
        lines: list[tuple[int, int, int]] = []  # slope, value at 0, i
        head, new, choice = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            if cost[j - 1] is not None:
                m, b = -docs[j - 1], cost[j - 1]
                while len(lines) - head >= 2:
                    (m1, b1, _), (m2, b2, _) = lines[-2], lines[-1]
                    if (b - b1) * (m1 - m2) <= (b2 - b1) * (m1 - m):
                        lines.pop()
                    else:
                        break
                if lines and len(lines) > head and lines[-1][0] == m:
                    if lines[-1][1] > b:
                        lines[-1] = (m, b, j - 1)
                else:
                    lines.append((m, b, j - 1))
            x = size[j - 1]
            while len(lines) - head >= 2 and lines[head + 1][0] * x + lines[head + 1][1] <= lines[head][0] * x + lines[head][1]:
                head += 1
            if len(lines) > head:
                m, b, i = lines[head]
                new[j], choice[j] = m * x + b + x * docs[j], i
        back.append(choice)
        cost = [None, *new[1:]]
        # the fewer buckets' solutions are dominated: splitting a bucket never adds padding
    tops, j = [], n
    for choice in reversed(back):
        if j == 0:
            break
        tops.append(size[j - 1])
        j = choice[j]
    return tops[::-1]


def plan(counts: DataFrame, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Boundaries and the number of documents, from the exact histogram. D distinct lengths need D * (D - 1) / 2 tokens or
    more in all, so even 10^10 tokens bring fewer than 150,000 rows to the driver."""
    rows = lengths.length_histogram(counts).toArrow().sort_by("length")
    return best_boundaries(rows["length"].to_numpy(), rows["n_docs"].to_numpy(), buckets), int(sum(rows["n_docs"].to_pylist()))


def pack(docs: DataFrame, path: str | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, slot, padding): one row for each document.

    bucket_len is the padded length, the bucket's top; a batch has max(1, budget // bucket_len) slots, filled in an order
    of hashes of doc_id. Only a bucket's last batch may be short. Empty texts have 0 tokens and still get a slot."""
    counts = stash(lengths.token_counts(docs, path))
    tops, total = plan(counts, buckets)
    spread = max(1, -(-total // RANK_ROWS))
    bucket = F.lit(0)
    for top in tops[:-1]:
        bucket = bucket + (F.col("n_tokens") > top).cast("int")
    placed = counts.select("k", "n_tokens", bucket.cast("int").alias("bucket"), F.pmod(F.xxhash64("k", "n_tokens", F.lit(7)), F.lit(spread)).alias("part"))
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy("bucket", "part").orderBy("k", "n_tokens")) - 1)
    top = F.element_at(F.array(*(F.lit(x).cast("long") for x in tops)), F.col("bucket") + 1) if tops else F.lit(0).cast("long")
    slots = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return (
        ranked.join(first, ["bucket", "part"]).withColumn("bucket_len", top).withColumn("slots", slots).withColumn("rank", F.col("rank") + F.col("first"))
        .select(doc_id(), "n_tokens", "bucket", "bucket_len", F.floor(F.col("rank") / F.col("slots")).alias("batch"), F.pmod("rank", "slots").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
    )
