"""Operator 8, n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document's set are the hashes of its distinct word n-grams. In a band of sizes, sets of Jaccard t or more differ in
a bounded number d of elements. The band cuts the range of hashes into more than d parts, so such sets agree in whole
parts: in at least as many as there are parts beyond d. Sets that agree in a part and lie in the same or the next band
form a tile. Parts with one element or none are left out where a set has fewer of them than it must agree in.

1. Batches of documents give hashes of their parts, sorted and cut into buckets. Equal sets of one batch are linked
   at once.
2. Tiles suggest pairs: to the least document and to the next one by size. For the best few of each document,
   bitmaps bound the overlap from above by their differing bits; pairs that pass are intersected exactly, next to
   each other in one task, as sorted arrays.
3. Links become components. In tiles that hold several components, the bitmaps of all documents of different
   components are compared, in blocks of bounded size, and the few pairs that pass are intersected exactly. So no link
   between components is lost, while the pairs of one component are never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm import hashing
from veilspark.llm.base import doc_id, hot_keys, keyed, packed, partitions, record, shared_ids, spread_join, stash, text_hash, told_apart, unpacked, utf8
from veilspark.llm.components import connected

#: Words of an n-gram; least similarity as a ratio; of the contract and of near-duplicate stages.
CONTRACT, NEAR = (3, 90, 100), (5, 80, 100)
#: Ratio of the sizes at the ends of a band; parts beyond those that may differ, as a share of these.
BAND, SPARE = 1.5, 0.2
#: Bytes of text in a batch; bits of a signature for each element; suggested pairs tried for each document in the first pass;
#: documents of a tile in one block.
BATCH, BITS, TRIED, BLOCK = 48_000_000, 4, 3, 1024
_BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_ROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])
_ELEMENT, _SIZE, _EDGE, _PAIR, _MEMBER, _HINT = range(6)


_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+, A-Z in lower case, and where each document's words begin and end among them.
    Another table of the bytes that set words apart may be given."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1 if len(data) else start
    return hashing.span(hashing.prefix(data), start, end), np.searchsorted(start, bounds)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-grams of words of each document; of all its words where they are fewer than n."""
    word, at = word_hashes(data, bounds)
    place = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 2**64) | 1) for i in range(n)]
    whole = np.zeros(max(len(word) - n + 1, 0), np.uint64)
    for i, p in enumerate(place):
        whole += word[i : i + len(whole)] * p
    whole = hashing.mix(whole)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            few = (word[a:b] * np.array(place[: b - a], np.uint64)).sum(dtype=np.uint64, keepdims=True)
            sets.append(hashing.mix(few + np.uint64(b - a << 60)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


class Bands:
    """Bands of set sizes for a threshold, and the parts of a set in its own band and, if it is small there, in the one below."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.top, self.parts, self.spare, self.salt = [], [], [], []

    def of(self, size: int) -> int:
        while not self.top or self.top[-1] < size:
            low = self.top[-1] + 1 if self.top else 1
            high = max(low, int(low * max(BAND, 1.2 * self.den / self.num)))
            differ = high * (self.den - self.num) // self.num
            spare = int(np.ceil(SPARE * differ))
            self.salt.append(hashing.mix(np.arange(differ + 1 + spare, dtype=np.uint64) + np.uint64((len(self.top) + 1) << 40)))
            self.top.append(high)
            self.parts.append(differ + 1 + spare)
            self.spare.append(spare)
        return int(np.searchsorted(self.top, size))

    def keys(self, elements: np.ndarray) -> np.ndarray:
        """Hashes of the parts of a sorted set, for each of its bands."""
        n = len(elements)
        own = self.of(n)
        bands = [own, own - 1] if own and n * self.num <= self.top[own - 1] * self.den else [own]
        total = np.concatenate([[np.uint64(0)], np.cumsum(hashing.mix(elements + np.uint64(0x632BE59BD9B4E019)))])
        out = []
        for b in bands:
            cut = np.searchsorted(hashing.bucket(elements, self.parts[b]), np.arange(self.parts[b] + 1))
            count = np.diff(cut)
            key = hashing.mix(total[cut[1:]] - total[cut[:-1]] + self.salt[b])
            few = count < 2
            if few.sum() > self.spare[b]:
                few = count < 1
            out.append(key[~few] if few.sum() <= self.spare[b] else key)
        return np.concatenate(out)


def signature(elements: np.ndarray) -> np.ndarray:
    """Parities of the elements by hashed bit: sets differ in as many elements as their signatures in bits, or more.
    A signature has BITS bits for each element, rounded up to a power of two; folding its halves gives the next shorter one."""
    bits = 1 << max(6, int(len(elements) * BITS - 1).bit_length())
    count = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.int64)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * |x & y| >= num * |x | y| by intersecting sorted arrays."""
    if not len(x) or not len(y) or den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return den * both >= num * (len(x) + len(y) - both)


def runs_of_texts(batch):
    """(ids, data, bounds) of runs of documents of about half a megabyte."""
    data, offsets = utf8(batch.column("text"))
    ids, low = np.asarray(batch.column("k")), 0
    while low < len(ids):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + (1 << 19), side="right")) - 1)
        yield low, ids[low:high], data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _elements(n: int, num: int, den: int, buckets: int):
    """The index rows of batches of documents; a size comes with the order ``doc`` of its document."""
    bands = Bands(num, den)

    def send(kind, key, *columns):
        to = hashing.bucket(key, buckets)
        order = np.argsort(key, kind="stable")
        cut = np.searchsorted(to[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            part = order[cut[b] : cut[b + 1]]
            yield b, kind, hashing.pack(hashing.deltas(key[part]), *(c[part] for c in columns))

    def flush(seen):
        edges, of, elements, element_size = [], [], [], []
        ids, sizes, order = [k for k, _, _ in seen], [len(s) for _, s, _ in seen], [d for _, _, d in seen]
        first: dict[int, int] = {}
        for k, s, _ in seen:
            if not len(s):
                continue
            whole = hash((len(s), int(np.bitwise_xor.reduce(hashing.mix(s + np.uint64(1)))), int(s.sum(dtype=np.uint64))))
            if (rep := first.setdefault(whole, k)) != k:
                edges.append((rep, k))
            else:
                elements.append(bands.keys(s))
                of.append(k)
                element_size.append(len(s))
        out = []
        k = np.array(ids, np.int64)
        out += send(_SIZE, hashing.mix(k.astype(np.uint64)), k, np.array(sizes, np.int64), np.array(order, np.int64))
        if edges:
            e = np.array(edges, np.int64)
            out += send(_EDGE, hashing.mix(e[:, 1].astype(np.uint64)), e[:, 0].copy(), e[:, 1].copy())
        if elements:
            count = [len(x) for x in elements]
            out += send(_ELEMENT, np.concatenate(elements), np.repeat(np.array(of, np.int64), count), np.repeat(np.array(element_size, "<u4"), count))
        for low in range(0, len(out), 64):
            yield record(_BLOB, *zip(*out[low : low + 64], strict=True))

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for low, ids, data, bounds in runs_of_texts(batch):
                held += zip(ids.tolist(), shingle_sets(data, bounds, n), batch.column("doc").slice(low, len(ids)).to_pylist(), strict=True)
                size += len(data)
                if size >= BATCH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return rows


def _tiles(num: int, den: int):
    """Rows of one bucket: sizes and edges pass; elements that documents share give pairs and, of three documents on, members."""

    def rows(batches):
        keys, ks, sizes = [], [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                delta, *columns = hashing.unpack(blob)
                if kind == _ELEMENT:
                    keys.append(np.cumsum(delta, dtype=np.uint64))
                    ks.append(columns[0])
                    sizes.append(columns[1].astype(np.int64))
                else:
                    yield record(_ROW, np.full(len(delta), kind), columns[0], columns[1], columns[2] if kind == _SIZE else np.zeros(len(delta), np.int64))
        if not keys:
            return
        key, k, size = np.concatenate(keys), np.concatenate(ks), np.concatenate(sizes)
        keys.clear(), ks.clear(), sizes.clear()
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        keep = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(key) > 1 else order[:0]
        key, k, size = key[keep], k[keep], size[keep]
        order = np.lexsort((k, size, key))
        key, k, size = key[order], k[order], size[order]
        if not len(key):
            return
        # a tile ends where the key changes or the next document is too large for the one before
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (den * size[:-1] < num * size[1:])])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(key)))
        tile = np.repeat(np.arange(len(first)), count)
        least = np.minimum.reduceat(k, first)[tile]
        # pairs to the document before by size and to the least one of the tile; those of two documents are all that their tile has
        inner = np.flatnonzero(~new)
        a = np.concatenate([k[inner - 1], least])
        b = np.concatenate([k[inner], k])
        wide = count[tile] > 2
        of_wide = np.concatenate([wide[inner], wide])
        for kind, side in ((_PAIR, ~of_wide), (_HINT, of_wide)):
            pair = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[(a != b) & side]
            if len(pair):
                pair, hits = np.unique(pair, axis=0, return_counts=True)
                yield record(_ROW, np.full(len(pair), kind), pair[:, 0], pair[:, 1], hits)
        if wide.any():
            # tiles of the same documents are one: named by a hash of their members
            name = np.add.reduceat(hashing.mix(k.astype(np.uint64) + np.uint64(3)), first)
            name = hashing.mix(name + count.astype(np.uint64))[tile].view(np.int64)
            member = np.unique(np.stack([name[wide], k[wide], size[wide]], 1), axis=0)
            yield record(_ROW, np.full(len(member), _MEMBER), *member.T)

    return rows


_CAND = pa.schema([("k", pa.int64()), ("text", pa.string()), ("size", pa.int64()), ("bits", pa.list_(pa.int64()))])


def _signed(n: int):
    def rows(batches):
        for batch in batches:
            for low, ids, data, bounds in runs_of_texts(batch):
                sets = shingle_sets(data, bounds, n)
                yield record(_CAND, ids, batch.column("text").slice(low, len(ids)), [len(s) for s in sets], [signature(s) for s in sets])

    return rows


def _verified(n: int, num: int, den: int):
    """Of rows ordered by tile, its centre first: (a, b) of members linked with the centre."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches):
        tile, centre, its = None, None, None
        for batch in batches:
            tiles, roles = list(zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), strict=True)), batch.column("role").to_pylist()
            out = []
            for low, ids, data, bounds in runs_of_texts(batch):
                for i, (k, s) in enumerate(zip(ids.tolist(), shingle_sets(data, bounds, n), strict=True), low):
                    if roles[i] == 0:
                        tile, centre, its = tiles[i], k, s
                    elif tiles[i] == tile and linked(its, s, num, den):
                        out.append((centre, k))
            if out:
                yield record(schema, *zip(*out, strict=True))

    return rows


def _crossing(num: int, den: int):
    """Of rows ordered by tile and pair of blocks: pairs of different components whose bitmaps allow a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(rows):
        k, size, root, block = (np.concatenate([r[c] for r in rows]) for c in ("k", "size", "root", "block"))
        bits = [x for r in rows for x in r["bits"]]
        if len(k) < 2 or (root == root[0]).all():
            return None
        # signatures of one length: longer ones are folded
        width = min(map(len, bits))
        low = np.empty((len(bits), width), np.int64)
        for i, x in enumerate(bits):
            while len(x) > width:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            low[i] = x
        order = np.lexsort((k, size))
        k, size, root, block, low = k[order], size[order], root[order], block[order], low[order].view(np.uint64)
        high = np.searchsorted(size, size * den // num, side="right")
        apart = block.min() != block.max()
        found = []
        for i in range(len(k) - 1):
            j = np.arange(i + 1, high[i])
            j = j[(root[j] != root[i]) & ((block[j] != block[i]) | (not apart))]
            if len(j):
                both = size[i] + size[j]
                most = (both - np.bitwise_count(low[j] ^ low[i]).sum(1, dtype=np.int64)) // 2
                j = j[most * den >= (both - most) * num]
                found.append(np.stack([np.minimum(k[i], k[j]), np.maximum(k[i], k[j])]))
        return np.concatenate(found, 1) if found else None

    def rows(batches):
        held, at = [], None
        for batch in batches:
            tile, low, high = (np.asarray(batch.column(c)) for c in ("tile", "low", "high"))
            new = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(tile) else []
            column = {c: np.asarray(batch.column(c)) for c in ("k", "size", "root", "block")}
            bits = batch.column("bits")
            values, cut = np.asarray(bits.values), np.asarray(bits.offsets)
            column["bits"] = [values[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            for a, b in zip(new, [*new[1:], len(tile)], strict=True):
                if at is not None and at != (tile[a], low[a], high[a]):
                    if (found := pairs(held)) is not None:
                        yield record(schema, *found)
                    held = []
                at = (tile[a], low[a], high[a])
                held.append({c: x[a:b] for c, x in column.items()})
        if held and (found := pairs(held)) is not None:
            yield record(schema, *found)

    return rows


def _links(pairs: DataFrame, cand: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are links: bounded by bitmaps first, then exactly."""
    side = lambda c: cand.select(F.col("k").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}"))
    # sizes that may link differ by less than half, so at most one of the signatures is folded once
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2 + 1).cast("int"), (F.size(x) / 2).cast("int")), xor)
    own = lambda c, d: F.when(F.size(f"bits_{c}") > F.size(f"bits_{d}"), fold(F.col(f"bits_{c}"))).otherwise(F.col(f"bits_{c}"))
    differ = F.aggregate(F.zip_with(own("a", "b"), own("b", "a"), lambda x, y: F.bit_count(xor(x, y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    both = F.col("size_a") + F.col("size_b")
    most = F.floor((both - differ) / 2)  # elements in common at most
    # hot keys are stored, so that plans stay small; every document of pairs is in cand, so the first join keeps the counts of b
    total = pairs.count()
    hot = lambda rows, c, n: F.broadcast(stash(hot_keys(rows.groupBy(c).agg(F.count("*").alias("n")), c, n)))
    sided = spread_join(spread_join(pairs, side("a"), "a", hot=hot(pairs, "a", total)), side("b"), "b", hot=hot(pairs, "b", total))
    near = stash(sided.where(F.least("size_a", "size_b") * den >= F.greatest("size_a", "size_b") * num).where(most * den >= (both - most) * num).select("a", "b"))
    # members of one centre are dealt over parts, each of which gets the centre
    large = hot(near, "a", near.count())
    dealt = near.join(large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part"))
    roles = dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("k")).unionByName(dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("k")).distinct())
    together = roles.join(cand.select("k", "text"), "k").repartition(partitions(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "role", "k")
    return together.select("a", "part", "role", "k", "text").mapInArrow(_verified(n, num, den), "a long, b long")


def _named(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows (k, h, ...) with the id of their document as k and the id that ``keyed`` makes as doc: k is doc itself or, where
    doc names several texts or none, a hash of doc and text. Ids in the order of doc make the oldest document of a tile its
    centre, which is mostly what the others were copied from; hashes are positive, so they rarely come before."""
    hashed = F.xxhash64("k", "h").bitwiseAND(F.lit(2**63 - 1))
    return told_apart(rows, shared).withColumns({"doc": F.col("k"), "k": F.when(F.col("h") == 0, F.col("k")).otherwise(hashed)})


def components(docs: DataFrame, n: int, num: int, den: int, shared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes (k, n_shingles, doc) for each row, roots (k, root, first) for documents that have links). Here k and doc are those of
    ``_named``, which rows of one document share; root is the document of the least doc in its component and first that doc.
    Of several with that doc, the one of least k is root."""
    spark = docs.sparkSession
    p, texts = partitions(spark), _named(keyed(docs, text_hash()), shared_ids(docs) if shared is None else shared).select("k", "text", "doc")
    index = stash(texts.mapInArrow(_elements(n, num, den, p), "bucket int, kind int, blob binary").repartitionById(p, "bucket").mapInArrow(_tiles(num, den), "kind int, a long, b long, c long"))
    pairs = stash(index.where(F.col("kind").isin(_PAIR, _HINT)).groupBy("a", "b").agg(F.sum("c").alias("hits")))
    edges = index.where(F.col("kind") == _EDGE).select("a", "b")
    members = index.where(F.col("kind") == _MEMBER).select(F.col("a").alias("tile"), F.col("b").alias("k"), F.col("c").alias("size")).distinct()
    named = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    # dealt by k whatever its size, so that the plan of small tables is that of large ones
    cand = stash(texts.select("k", "text").repartition(p, "k").join(named, "k").dropDuplicates(["k"]).mapInArrow(_signed(n), "k long, text string, size long, bits array<long>"))
    best = W.partitionBy("b").orderBy(F.desc("hits"), "a")
    tried = stash(pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= TRIED).select("a", "b"))
    links = stash(_links(tried, cand, n, num, den).unionByName(edges))
    roots = stash(connected(links))
    # tiles in two components: those of two documents are pairs, all pairs of the others are compared by their bitmaps
    root = lambda c: F.coalesce(f"r_{c}", c)
    of = lambda c: roots.select(F.col("k").alias(c), F.col("root").alias(f"r_{c}"))
    apart = index.where(F.col("kind") == _PAIR).select("a", "b").distinct().join(of("a"), "a", "left").join(of("b"), "b", "left").where(root("a") != root("b")).select("a", "b")
    split = members.join(roots, "k", "left").select("tile", "k", F.coalesce("root", "k").alias("root"))
    torn = split.groupBy("tile").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("first <> last").select("tile", "blocks")
    # joins by tile and by root have one row for each key on their small side; adaptive execution splits hot keys of the other
    dealt = split.join(torn, "tile").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")))
    # a tile of one block is one pair of blocks; a larger one meets itself block by block
    met = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    sided = met.select("tile", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "k", "root").join(cand.select("k", "size", "bits"), "k")
    across = sided.repartition(p, "tile", "low", "high").sortWithinPartitions("tile", "low", "high").select("tile", "low", "high", "block", "k", "root", "size", "bits").mapInArrow(_crossing(num, den), "a long, b long")
    rest = stash(apart.unionByName(across).distinct().join(tried, ["a", "b"], "left_anti"))
    if rest.head(1):
        roots = connected(roots.where("k <> root").select(F.col("k").alias("a"), F.col("root").alias("b")).unionByName(_links(rest, cand, n, num, den)))
    sizes = index.where(F.col("kind") == _SIZE).select(F.col("a").alias("k"), F.col("b").alias("n_shingles"), F.col("c").alias("doc"))
    # a large component shrinks to a row for each task before it meets itself
    roots = stash(roots.join(sizes.select("k", "doc"), "k").distinct())
    heads = roots.groupBy("root").agg(F.min(F.struct("doc", "k")).alias("head"))
    return sizes, roots.join(heads, "root").select("k", F.col("head.k").alias("root"), F.col("head.doc").alias("first"))


def join_documents(docs: DataFrame, n: int = CONTRACT[0], num: int = CONTRACT[1], den: int = CONTRACT[2]) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: component_id is the least doc_id that links of Jaccard num / den or
    more reach, the row's own if none. A null, empty or blank text has no n-grams and no links; rows that repeat a document
    have its values. Words end at ASCII white space, and only A-Z change case."""
    sizes, roots = components(docs, n, num, den)
    found = sizes.join(roots, "k", "left").select(F.col("doc").alias("k"), "n_shingles", F.coalesce("first", "doc").alias("first"))
    return found.select(doc_id(), "n_shingles", F.when(F.col("first") != F.lit(-(2**63)), F.col("first")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = NEAR[0], num: int = NEAR[1], den: int = NEAR[2]) -> DataFrame:
    """docs without near copies: of each component the document of the least doc_id stays, with all its columns. Rows that
    repeat its doc_id and text stay with it."""
    shared = shared_ids(docs)
    _, roots = components(docs, n, num, den, shared)
    gone = roots.where("k <> root").select("k", F.lit(True).alias("gone"))
    # dealt by key whatever the size of either side, so that the plan of small tables is that of large ones
    rows = _named(packed(docs), shared).repartition(partitions(docs.sparkSession), "k")
    return unpacked(rows.join(gone, "k", "left").where("gone IS NULL"), docs.columns)
