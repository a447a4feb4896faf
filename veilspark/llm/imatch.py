"""Operator 6, document fingerprints: I-Match with randomised lexicons.

The lexicon are the terms whose document frequency lies in a band, that is, whose inverse document frequency is
neither low nor high. Each of several random subsets of it hashes the distinct terms of a document that it holds.
The subsets are drawn at several rates, so that of short and of long documents some subsets hold only a few terms
and survive an edit. The likeness of two fingerprints is the share of equal hashes among the subsets that hold
terms of either, from the densest rate on at which some subsets are empty.

Of a document with fewer than FEWEST terms of the lexicon (a short one, or one of a rare language) these say too little;
it is hashed by all its terms, in the same subsets.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import hashing
from veilspark.llm.base import doc_id, keyed, partitions, record
from veilspark.llm.ngramjoin import runs_of_texts, word_hashes

#: Shares of documents between which a term's document frequency must lie. At least 1/LEAST, so the lexicon has at most
#: LEAST times the mean number of distinct terms of a document, whatever the number of documents.
LEAST, MOST = 2_000, 5
#: Rates 2**-1 to 2**-RATES, subsets for each rate, bytes of a subset's hash.
RATES, EACH, WIDTH = 10, 12, 2
SUBSETS = RATES * EACH
#: A document with fewer terms of the lexicon than this is hashed by all its terms.
FEWEST = 8
BATCH = 48_000_000
_BLOB = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_TERM = pa.schema([("term", pa.int64()), ("df", pa.int64())])


def _frequencies(buckets: int):
    """Document frequencies of terms in batches of documents, as blobs for buckets of terms."""

    def flush(held):
        words = np.concatenate([w for w, _ in held])
        docs = np.concatenate([d for _, d in held])
        order = np.argsort(words, kind="stable")
        words, docs = words[order], docs[order]
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (docs[1:] != docs[:-1])  # stable: a document's repeats are neighbours
        term, df = np.unique(words[new], return_counts=True)
        cut = np.searchsorted(hashing.bucket(term, buckets), np.arange(buckets + 1))
        rows = [(b, hashing.pack(hashing.deltas(term[cut[b] : cut[b + 1]]), df[cut[b] : cut[b + 1]])) for b in np.flatnonzero(np.diff(cut)).tolist()]
        for low in range(0, len(rows), 64):
            yield record(_BLOB, *zip(*rows[low : low + 64], strict=True))

    def rows(batches):
        held, size, doc = [], 0, 0
        for batch in batches:
            for _, ids, data, bounds in runs_of_texts(batch):
                words, at = word_hashes(data, bounds)
                held.append((words, np.repeat(np.arange(doc, doc + len(ids)), np.diff(at))))
                size, doc = size + len(data), doc + len(ids)
                if size >= BATCH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return rows


def _in_band(low: float, high: float):
    def rows(batches):
        parts = [hashing.unpack(blob) for batch in batches for blob in batch.column("blob").to_pylist()]
        if parts:
            terms = np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _ in parts])
            term, place = np.unique(terms, return_inverse=True)
            df = np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
            keep = (df >= low) & (df <= high)
            yield record(_TERM, term[keep].view(np.int64), df[keep])

    return rows


def lexicon(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(term, df): hashes of the terms that at least 1 / least and at most 1 / most of all rows of ``docs`` hold."""
    p, texts = partitions(docs.sparkSession), keyed(docs)
    total = docs.count()
    counted = texts.mapInArrow(_frequencies(p), "bucket int, blob binary").repartitionById(p, "bucket")
    return counted.mapInArrow(_in_band(total / least, total / most), "term long, df long")


class Fingerprinter:
    """Fingerprints of runs of texts: a row of hashes for each text, a column for each subset, 0 where it holds no term."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms.astype(np.int64).view(np.uint64))
        self.value = self._value(self.terms)
        of = self._subsets(self.terms)
        self.count = of.sum(1)
        self.first = np.cumsum(self.count) - self.count
        self.subset = np.nonzero(of)[1].astype(np.int16)

    @staticmethod
    def _value(terms: np.ndarray) -> np.ndarray:
        return hashing.mix(terms + np.uint64(0xA24BAED4963EE407))

    @staticmethod
    def _subsets(terms: np.ndarray) -> np.ndarray:
        """Whether each subset holds each term."""
        out = np.zeros((len(terms), SUBSETS), bool)
        for j in range(SUBSETS):
            out[:, j] = hashing.mix(terms ^ np.uint64(0x9FB21C651E98DF25 * (j + 1) % 2**64)) >> np.uint64(64 - (1 + j // EACH)) == 0
        return out

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        words, at = word_hashes(data, bounds)
        doc = np.repeat(np.arange(n), np.diff(at))
        # distinct terms of each document, in order
        order = np.lexsort((words, doc))
        doc, words = doc[order], words[order]
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
        doc, words = doc[new], words[new]
        place = np.minimum(np.searchsorted(self.terms, words), max(len(self.terms) - 1, 0))
        hit = self.terms[place] == words if len(self.terms) else np.zeros(len(words), bool)
        few = np.bincount(doc[hit], minlength=n) < FEWEST
        use = hit & ~few[doc]
        own, term = doc[use], place[use]
        many = self.count[term]
        total = np.cumsum(many)
        flat = np.repeat(self.first[term] - total + many, many) + np.arange(total[-1] if len(total) else 0)
        cell, value = np.repeat(own, many) * SUBSETS + self.subset[flat], np.repeat(self.value[term], many)
        rest = few[doc]
        i, j = np.nonzero(self._subsets(words[rest]))
        cell, value = np.concatenate([cell, doc[rest][i] * SUBSETS + j]), np.concatenate([value, self._value(words[rest])[i]])
        sums = np.zeros(n * SUBSETS, np.uint64)
        np.add.at(sums, cell, value)
        held = np.bincount(cell, minlength=n * SUBSETS) > 0
        hashes = np.where(held, np.maximum(hashing.mix(sums) >> np.uint64(64 - 8 * WIDTH), np.uint64(1)), np.uint64(0)).astype(">u4")
        return hashes.reshape(n, SUBSETS)


def written(hashes: np.ndarray) -> list[str]:
    """Hex digits of the subsets' hashes; zeros where a subset holds no term."""
    cells = np.ascontiguousarray(hashes.view(np.uint8).reshape(*hashes.shape, 4)[:, :, 4 - WIDTH :]).reshape(len(hashes), -1)
    return [x.tobytes().hex() for x in cells]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal hashes among subsets that hold a term of either; 1 where both hold none.

    Subsets of a rate at which nearly all hold terms hold several each, and one edit changes them all; they are left out
    unless there is no sparser rate."""
    n = len(a)
    either = ((a > 0) | (b > 0)).reshape(n, RATES, EACH)
    equal = ((a > 0) & (a == b)).reshape(n, RATES, EACH).sum(2)
    held = either.sum(2)
    sparse = held <= EACH * 9 // 10
    first = np.where(sparse.any(1), sparse.argmax(1), RATES - 1)
    # where the sparser rates hold nothing at all, the last rate that holds terms counts
    last = np.where(held.any(1), RATES - 1 - (held[:, ::-1] > 0).argmax(1), 0)
    use = np.arange(RATES) >= np.minimum(first, last)[:, None]
    total = (held * use).sum(1)
    return np.where(total > 0, (equal * use).sum(1) / np.maximum(total, 1), 1.0)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_OUT = pa.schema([("k", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _described(make: Fingerprinter, texts: list[str]) -> list:
    """The columns after k for every text but the last, each followed by the next one."""
    own, following = texts[:-1], texts[1:]
    changed = [edited(t, f) for t, f in zip(own, following, strict=True)]
    n = len(own)
    hashes = make(*_joined([*texts, *changed]))
    mine, after, new = hashes[:n], hashes[1 : n + 1], hashes[n + 1 :]
    return [[len(t) for t in own], [hashlib.sha256(x.encode()).hexdigest() for x in changed], written(mine), written(new), likeness(mine, new), likeness(mine, after)]


def _runs(sizes: list[int], most: int = 1 << 19):
    low = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield low, i
            low, total = i, 0
        total += s
    if low < len(sizes):
        yield low, len(sizes)


def range_of(low_k: np.ndarray, low_t: np.ndarray, k: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The last range that begins at (k, t) or before; ranges ascend and the first begins with the least pair."""
    at, end = np.searchsorted(low_k, k), np.searchsorted(low_k, k, side="right")
    for first in np.unique(at[at < end]).tolist():  # ranges that begin inside a k
        inside = (at == first) & (at < end)
        stop = int(end[inside][0])
        end[inside] = first + np.searchsorted(low_t[first:stop], t[inside], side="right")
    return end - 1


#: Fingerprinters by lexicon, kept while a Python worker lives, so that its tasks share them.
_MADE: dict[str, Fingerprinter] = {}


def _maker(name: str, terms) -> Fingerprinter:
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Fingerprinter(terms)
    return _MADE[name]


def digest_documents(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The next document is the next one by doc_id (those of one doc_id, or of none, by a hash of the text), after the last
    the first; a sole document is its own next. Rows that repeat a document get that document's values. An empty or null
    text holds no terms; likeness is 1 if both sides hold none, 0 if one does. An empty table gives no rows. Very long
    texts are whole, each alone in its run.

    Texts are sorted by range in one shuffle. The ranges are cut on keys and hashes alone, so the first document of each
    is known beforehand and goes along with the range before it."""
    spark = docs.sparkSession
    p, texts = partitions(spark), keyed(docs).withColumn("t", F.xxhash64("text"))
    terms = lexicon(docs, least, most).select("term").toArrow()["term"].to_numpy()
    # one row of two numbers for each range
    lows = texts.select("k", "t").repartitionByRange(p, "k", "t").groupBy(F.spark_partition_id().alias("i")).agg(F.min(F.struct("k", "t")).alias("low")).select("low.k", "low.t").toArrow().sort_by([("k", "ascending"), ("t", "ascending")])
    low_k, low_t = (lows[c].to_numpy() for c in ("k", "t"))
    ranges, name = max(1, lows.num_rows), uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((terms, low_k, low_t))

    @F.pandas_udf("int")
    def part(k: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(range_of(*shared.value[1:], k.to_numpy(), t.to_numpy()).astype(np.int32))

    def rows(batches):
        kept = None  # key, text and number of rows of the last document seen
        for batch in batches:
            ids, hashes, last, found = (batch.column(c).to_pylist() for c in ("k", "t", "last", "text"))
            run = [kept] if kept else []
            for k, t, end, text in zip(ids, hashes, last, found, strict=True):
                if run and not end and run[-1][0] == (k, t):
                    run[-1][2] += 1
                else:
                    run.append([(k, t), text, 1])
            for low, high in _runs([len(x[1]) for x in run[:-1]]):
                columns = _described(_maker(name, shared.value[0]), [x[1] for x in run[low : high + 1]])
                again = np.repeat(np.arange(high - low), [x[2] for x in run[low:high]])
                made = record(_OUT, [x[0][0] for x in run[low:high]], *columns)
                for at in range(0, len(again), 2000):
                    yield made.take(pa.array(again[at : at + 2000]))
            kept = run[-1] if run else kept

    firsts = F.broadcast(spark.createDataFrame([(int(k), int(t), (i - 1) % ranges) for i, (k, t) in enumerate(zip(low_k, low_t, strict=True))], "k long, t long, part int"))
    heads = texts.join(firsts, ["k", "t"]).dropDuplicates(["k", "t"]).select("part", F.lit(True).alias("last"), "k", "t", "text")
    every = texts.select(part("k", "t").alias("part"), F.lit(False).alias("last"), "k", "t", "text").unionByName(heads)
    dealt = every.repartitionById(ranges, "part").sortWithinPartitions("part", "last", "k", "t")
    return dealt.select("k", "t", "last", "text").mapInArrow(rows, _DDL).select(doc_id(), *_OUT.names[1:])
