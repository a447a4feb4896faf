"""Operator 11, conversation prefix trie, by the Euler-tour technique.

Conversations that begin with the same turns share a path from the root. Nothing walks the trie:

1. ``scan`` gives prefix folds over sorted rows cut into ranges, so a conversation, a node's children or the whole tour may be of
   any length.
2. A node is known by 128 bits of the hashes of (depth, turn) along its path, folded by exclusive or, and from then on by
   its smallest member and its depth, which name it as well.
3. Each node has an enter and an exit arc. After an enter arc comes that of the first child, or the node's exit arc; after an
   exit arc comes the next sibling's enter arc, or the parent's exit arc.
4. The tour is list-ranked: partitions, cut by smallest member and depth, contract the stretches inside them, and the heads
   of stretches jump over their successors, doubling the distance each round; a round is one join of the heads.
5. Prefix sums at the arcs' positions give each subtree's leaves and savings as exit minus enter.

Members that end at a node are hashed in ascending order as a stream of blocks of ids, since SHA-256 takes one stream.

Defined results: a null role or text is empty; a null turn comes first; rows of one conversation and turn go by the hash of
(role, text); a repeated row is a turn of its own. Rows without a conv_id are one conversation, smallest of all, that
takes no turns from another, has a null conv_id in results and counts as the empty decimal. Very long texts are hashed
where they are read. A table without rows has no nodes. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.base import NO_ID, partitions, small_batches, spread_join, stash
from veilspark.operators.scan import scan

#: Words, as in the contract; ids in a block of a node's members; turns at most, and steps of conv_id, that a rebuilt conversation takes from another.
WORDS, BLOCK, HEADS, STEP = r"[^\x20\x09-\x0D]+", 8192, 3, 20


def _decimal(k) -> F.Column:
    return F.when(k == NO_ID, "").otherwise(k.cast("string"))


def own_turns(conversations: DataFrame) -> DataFrame:
    """(k, at, t1, t2, words): the turns of each conversation, numbered from 0; t1 and t2 stand for role and text."""
    small_batches(conversations.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("k"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("t1"),
        F.conv(F.substring(F.sha2(F.concat_ws("\x00", role, text), 256), 1, 15), 16, 10).cast("long").alias("t2"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"), F.lit(1).cast("long").alias("at"),
    )
    return scan(turns, ["k"], ["turn", "t1", "t2"], add=("at",)).select("k", (F.col("at") - 1).alias("at"), "t1", "t2", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (k), and their turns (k, part, at, t1, t2, words) by part and at after each has its first turns
    taken from the conversation at the last multiple of STEP: as many as crc32 of its decimal, modulo 4, says."""
    h = F.when(F.col("k") == NO_ID, 0).otherwise(F.crc32(_decimal(F.col("k")).cast("binary")) % (HEADS + 1))
    whole = turns.where("at = 0").select("k")
    base = (F.col("k") - F.pmod("k", F.lit(STEP))).alias("base")
    lent = turns.where((F.col("at") < HEADS) & (F.pmod("k", F.lit(STEP)) == 0)).select(F.col("k").alias("base"), "at", "t1", "t2", "words")
    heads = whole.where(F.col("k") != NO_ID).select("k", base, h.alias("h")).join(lent, "base").where("at < h")
    own = turns.where(F.col("at") >= h)
    return whole, heads.select("k", F.lit(0).cast("long").alias("part"), "at", "t1", "t2", "words").unionByName(own.select("k", F.lit(1).cast("long").alias("part"), "at", "t1", "t2", "words"))


def _paths(turns: DataFrame) -> DataFrame:
    """(k, d, h1, h2, p1, p2, words): each turn as the node that it ends, and that node's parent."""
    deep = scan(turns.withColumn("d", F.lit(1).cast("long")), ["k"], ["part", "at"], add=("d",))
    marked = deep.select("k", "d", F.xxhash64("d", "t1", "t2").alias("f1"), F.xxhash64("t2", F.lit(7), "d", "t1").alias("f2"), "words").withColumns({"h1": F.col("f1"), "h2": F.col("f2")})
    return scan(marked, ["k"], ["d"], xor=("h1", "h2")).select("k", "d", "h1", "h2", F.col("h1").bitwiseXOR(F.col("f1")).alias("p1"), F.col("h2").bitwiseXOR(F.col("f2")).alias("p2"), "words")


def _nodes(paths: DataFrame, whole: DataFrame) -> DataFrame:
    """(key, k, d, pk, n_convs, words): nodes by their smallest member and depth; pk is the parent's smallest member."""
    inner = paths.groupBy("h1", "h2", "d").agg(F.min("k").alias("k"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = whole.agg(F.min("k").alias("k"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("h1"), zero.alias("h2"), zero.alias("d"), "k", "n_convs", zero.alias("words"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    found = stash(inner.select(root.columns).unionByName(root).select(F.struct("h1", "h2").alias("key"), "k", "d", "n_convs", "words", F.struct("p1", "p2").alias("parent")))
    above = found.select(F.col("key").alias("parent"), F.col("k").alias("pk"))
    below = spread_join(found.where("d > 0"), above, "parent")
    top = found.where("d = 0").withColumn("pk", F.lit(None).cast("long"))
    columns = ["key", "k", "d", "pk", "n_convs", "words"]
    return stash(below.select(columns).unionByName(top.select(columns)))


def _arcs(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """(k, d, x, to_k, to_d, to_x, leaves, saved): enter arcs (x = 0) and exit arcs (x = 1) of all nodes with the arc that follows,
    null at the end of the tour."""
    siblings = scan(nodes.where("d > 0").select("pk", "d", F.col("k").alias("k"), F.col("k").alias("next")), ["pk", "d"], [F.desc("k")], last=("next",)).select("k", "d", "next")
    known = nodes.join(children, ["k", "d"], "left").join(siblings, ["k", "d"], "left")
    child, sibling, zero, one = F.col("first").isNotNull(), F.col("next").isNotNull(), F.lit(0).cast("long"), F.lit(1).cast("long")
    enter = F.struct(zero.alias("x"), F.when(child, F.col("first")).otherwise(F.col("k")).alias("to_k"), F.when(child, F.col("d") + 1).otherwise(F.col("d")).alias("to_d"), F.when(child, zero).otherwise(one).alias("to_x"),
                     F.when(child, zero).otherwise(one).alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    leave = F.struct(one.alias("x"), F.when(sibling, F.col("next")).otherwise(F.col("pk")).alias("to_k"), F.when(sibling, F.col("d")).when(F.col("d") > 0, F.col("d") - 1).alias("to_d"), F.when(sibling, zero).when(F.col("d") > 0, one).alias("to_x"),
                     zero.alias("leaves"), zero.alias("saved"))
    return known.select("k", "d", F.explode(F.array(enter, leave)).alias("arc")).select("k", "d", "arc.*")


_LIST = ["k", "d", "x"]
_TO = [f"to_{c}" for c in _LIST]


def _contracted(arcs: DataFrame) -> DataFrame:
    """arcs with what follows their stretch inside the partition instead of what follows themselves, the distance to it (dist),
    and whether no arc of the partition leads to them (head)."""
    columns = [*_LIST, *_TO, "leaves", "saved"]
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in (*columns, "dist")), T.StructField("head", T.BooleanType())])
    of = pa.schema([*((c, pa.int64()) for c in (*columns, "dist")), ("head", pa.bool_())])

    def paths(batches):
        full = [b for b in batches if b.num_rows]
        if not full:
            return
        table = pa.Table.from_batches(full)
        end = table.column("to_k").is_null().to_numpy(zero_copy_only=False)
        a = {c: (table.column(c).fill_null(-1) if c in _TO else table.column(c)).to_numpy().astype(np.int64) for c in columns}
        ids = np.unique(a["k"])
        width = 2 * (int(max(a["d"].max(), a["to_d"].max())) + 1)
        place = np.minimum(np.searchsorted(ids, a["to_k"]), len(ids) - 1)
        key, to = np.searchsorted(ids, a["k"]) * width + 2 * a["d"] + a["x"], place * width + 2 * a["to_d"] + a["to_x"]
        order = np.argsort(key)
        at = order[np.minimum(np.searchsorted(key[order], to), len(key) - 1)]
        here = ~end & (ids[place] == a["to_k"]) & (key[at] == to)
        head = np.ones(len(key), bool)
        head[at[here]] = False
        jump, dist = np.where(here, at, np.arange(len(key))), here.astype(np.int64)
        while (jump[jump] != jump).any():
            dist, jump = dist + dist[jump], jump[jump]
        out = [a[c] for c in _LIST] + [pa.array(a[c][jump], pa.int64(), mask=end[jump]) for c in _TO] + [a["leaves"], a["saved"], dist + 1, head]
        for batch in pa.Table.from_arrays([pa.array(x) for x in out], schema=of).to_batches(max_chunksize=50_000):
            yield batch

    return stash(arcs.select(columns).repartitionByRange(partitions(arcs.sparkSession), *_LIST).mapInArrow(paths, schema))


def ranked(arcs: DataFrame) -> DataFrame:
    """(k, d, x, leaves, saved, rank): the number of arcs from each to the end of the tour, itself included."""
    stretches = _contracted(arcs)
    heads = stretches.where("head").select(*_LIST, *_TO, "dist")
    count = heads.count()
    heads = stash(heads.repartition(count // 50_000 + 1, *_LIST))
    beyond = [F.col(c).alias(f"to_{c}") for c in _LIST]
    while heads.where("to_k is not null").limit(1).count():
        over = heads.select(*beyond, *(F.col(c).alias(f"then_{c}") for c in _TO), F.col("dist").alias("more"))
        going = heads.where("to_k is not null").join(over, _TO).select(*_LIST, *(F.col(f"then_{c}").alias(c) for c in _TO), (F.col("dist") + F.col("more")).alias("dist"))
        heads = stash(going.unionByName(heads.where("to_k is null")).coalesce(count // 50_000 + 1))
    ends = heads.select(*beyond, F.col("dist").alias("more"))
    return stretches.join(ends, _TO, "left").select(*_LIST, "leaves", "saved", (F.col("dist") + F.coalesce("more", F.lit(0))).alias("rank"))


def _ends(paths: DataFrame, whole: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end."""
    last = paths.groupBy("k").agg(F.max("d").alias("d"))
    ended = paths.join(last, ["k", "d"]).select("h1", "h2", "k")
    turnless = whole.join(last, "k", "left_anti").select(F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "k")
    members = ended.unionByName(turnless)
    blocks_of = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("k", pa.int64()), ("ids", pa.string())])

    def blocks(batches):
        for batch in batches:
            h1, h2, k = (batch.column(c).to_numpy() for c in ("h1", "h2", "k"))
            new = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(k) else np.zeros(0, np.int64)
            cut = sorted({j for a, b in zip(new.tolist(), [*new[1:].tolist(), len(k)], strict=True) for j in range(a, b, BLOCK)})
            yield pa.RecordBatch.from_arrays([pa.array(h1[cut]), pa.array(h2[cut]), pa.array(k[cut]), pa.array([",".join("" if x == NO_ID else str(x) for x in k[a:b].tolist()) for a, b in zip(cut, [*cut[1:], len(k)], strict=True)], pa.string())], schema=blocks_of)

    done_of = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ends_sha256", pa.string())])

    def digests(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for h1, h2, ids in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "ids")), strict=True):
                if now == (h1, h2):
                    state.update(b"," + ids.encode())
                else:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (h1, h2), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(done_of)], schema=done_of)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, state.hexdigest()), done_of, strict=True)], schema=done_of)

    n = partitions(members.sparkSession)
    cut = members.repartitionByRange(n, "h1", "h2", "k").sortWithinPartitions("h1", "h2", "k").mapInArrow(blocks, "h1 long, h2 long, k long, ids string")
    return cut.repartition(n, "h1", "h2").sortWithinPartitions("h1", "h2", "k").mapInArrow(digests, "h1 long, h2 long, ends_sha256 string").select(F.struct("h1", "h2").alias("key"), "ends_sha256")


def build(whole: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie's nodes, one row each, of conversations (k) and their turns (k, part, at, t1, t2, words)."""
    paths = stash(_paths(turns))
    nodes = _nodes(paths, whole)
    children = nodes.where("d > 0").groupBy(F.col("pk").alias("k"), (F.col("d") - 1).alias("d")).agg(F.min("k").alias("first"), F.count("*").alias("n_children"))
    tour = ranked(_arcs(nodes, children)).select("k", "d", "x", F.lit(0).cast("long").alias("g"), (-F.col("rank")).alias("position"), "leaves", "saved", F.col("leaves").alias("leaf"), F.col("saved").alias("save"))
    sums = scan(tour, ["g"], ["position"], add=("leaves", "saved"))
    inside = [F.sum(F.when(F.col("x") == 1, F.col(all_)).otherwise(F.col(own) - F.col(all_))).alias(name) for all_, own, name in (("leaves", "leaf", "n_leaves"), ("saved", "save", "saved_tokens"))]
    subtree = sums.groupBy("k", "d").agg(*inside)
    no_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    whole_row = nodes.join(subtree, ["k", "d"]).join(children, ["k", "d"], "left").join(_ends(paths, whole), "key", "left")
    return whole_row.select(
        no_id("k").alias("conv_id"), F.col("d").alias("depth"), no_id("pk").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of conversations as they are."""
    turns = own_turns(conversations)
    return build(turns.where("at = 0").select("k"), turns.select("k", F.lit(1).cast("long").alias("part"), "at", "t1", "t2", "words"))


def digest_conversations(conversations: DataFrame) -> DataFrame:
    """As prefix_trie, of the conversations that ``rebuilt`` makes."""
    return build(*rebuilt(own_turns(conversations)))
