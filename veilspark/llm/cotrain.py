"""Operator 2, quality classifier: co-training of a text view and a page-metadata view.

The text view reads the text alone: its words, the patterns of characters between them, its layout. The metadata view reads
none of it: source, language and length as the table gives them, and how a page's length compares with that of its source,
from statistics over all documents. Each is a logistic regression. Over some rounds each view labels those documents of a
pool of which it is confident, and these join the training rows of the other; each round brings new rows into the pool. The
views are then calibrated on rows that neither trained on, and a last regression, fitted on rows apart from both, combines
the calibrated views. One such classifier is made for quality and one for toxicity; a document is kept if it is likely good
and not likely toxic.

Fitting uses a bounded sample: LABELLED rows for each pair of labels and POOL unlabelled ones, chosen by hash. The
weights of rows restore the shares that the labels have in the whole table. All documents are scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.base import NO_ID, doc_id, keyed, packed, record, stash, text_hash, unpacked
from veilspark.llm.ngramjoin import runs_of_texts, word_hashes

#: Rows for each pair (quality, toxic) and in the pool of all rounds at most; rounds; probability from which a view is confident,
#: and by how much in log odds it must have moved away from the share of the class; share of the pool that it labels in a round at
#: most; weight of such a row; features of the text view at most.
LABELLED, POOL, ROUNDS, SURE, MOVED, SHARE, TRUST, FEATURES = 2500, 4000, 3, 0.97, 2.0, 0.05, 0.5, 1000
#: Decision thresholds.
GOOD, TOXIC = 0.5, 0.5
_WORDS = 1 << 18
#: Kinds of bytes: lower, upper, digit, space, line end, . , ! * $ % & # | other marks, bytes of longer characters.
_KIND = np.full(256, 14, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 15
for _i, _c in enumerate(" \n.,!*$%&#|", 3):
    _KIND[ord(_c)] = _i
_APART = ~((_KIND == 0) | (_KIND == 1) | (_KIND == 2) | (_KIND == 15))
_STEPS = np.array([0.002, 0.01, 0.04, 0.15, 0.4])
_SHAPE, _BYTE = _WORDS, _WORDS + 4096 * len(_STEPS)
_LINE = _BYTE + 16 * len(_STEPS)
TEXT_SIZE = _LINE + 40
#: The metadata view: source, language, length, both of them, length against the source's mean, documents of the source.
SOURCES = 4096
_LANG, _LENGTH, _BOTH, _RATIO, _MANY = SOURCES, SOURCES + 64, SOURCES + 104, SOURCES + 104 + 64 * 40, SOURCES + 104 + 64 * 40 + 33
META_SIZE = _MANY + 64


def _shares(doc: np.ndarray, kind: np.ndarray, kinds: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, kind and step) for each kind and each step that its share of a document's bytes reaches."""
    cell, count = np.unique(doc * kinds + kind, return_counts=True)
    own, what = np.divmod(cell, kinds)
    i, step = np.nonzero((count / size[own])[:, None] >= _STEPS)
    return own[i], what[i] * len(_STEPS) + step


def text_features(data: np.ndarray, bounds: np.ndarray, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs of the text view; of features marked useful only."""
    words, at = word_hashes(data, bounds, _APART)
    n, length = len(bounds) - 1, np.diff(bounds)
    size = np.maximum(length, 1)
    doc, feature = np.repeat(np.arange(n), np.diff(at)), (words & np.uint64(_WORDS - 1)).astype(np.int64)
    kind, owner = _KIND[data], np.repeat(np.arange(n), length)
    inside = owner[2:] == owner[:-2]
    shape = (kind[:-2] * 256 + kind[1:-1] * 16 + kind[2:])[inside] if len(kind) > 2 else kind[:0]
    d, f = _shares(owner[2:][inside] if len(kind) > 2 else owner[:0], shape, 4096, size)
    d1, f1 = _shares(owner, kind, 16, size)
    lines = np.bincount(owner, weights=data == 10, minlength=n) + 1
    line = np.minimum(39, (2 * np.log2(length / lines + 1)).astype(np.int64))
    doc, feature = np.concatenate([doc, d, d1, np.arange(n)]), np.concatenate([feature, f + _SHAPE, f1 + _BYTE, line + _LINE])
    if useful is not None:
        doc, feature = doc[useful[feature]], feature[useful[feature]]
    return np.divmod(np.unique(doc * TEXT_SIZE + feature), TEXT_SIZE)


def meta_features(source: list, lang: list, n_chars: list, statistics: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs of the metadata view; a null is a value of its own."""
    n = len(source)
    place = np.array([zlib.crc32(("" if x is None else "=" + str(x)).encode()) % SOURCES for x in source], np.int64).reshape(n)
    tongue = np.array([zlib.crc32(str(x).encode()) % 64 for x in lang], np.int64).reshape(n)
    known = np.array([x is not None for x in n_chars], bool).reshape(n)
    size = np.array([max(x or 0, 0) for x in n_chars], np.float64).reshape(n)
    length = np.where(known, np.minimum(38, 2 * np.log2(size + 1)), 39).astype(np.int64)
    many, mean = statistics[place].T
    ratio = np.where(known & (mean > 0), np.clip(np.floor(4 * np.log2((size + 1) / (mean + 1))), -16, 15) + 16, 32).astype(np.int64)
    count = np.minimum(63, 2 * np.log2(many + 1)).astype(np.int64)
    columns = [place, _LANG + tongue, _LENGTH + length, _BOTH + tongue * 40 + length, _RATIO + ratio, _MANY + count]
    return np.tile(np.arange(n), len(columns)), np.concatenate(columns)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 250) -> np.ndarray:
    """Weights of columns, then the bias, by Adam on the whole batch."""
    w = np.zeros(x.shape[1] + 1, np.float64)
    m, v, weight = np.zeros_like(w), np.zeros_like(w), weight / max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        r = weight * (_sigmoid(x @ w[:-1].astype(x.dtype) + w[-1]) - y)
        g = np.append(r.astype(x.dtype) @ x + penalty * w[:-1], r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


@dataclass
class View:
    """A logistic regression over the features that tell its classes apart best."""

    size: int
    most: int
    weights: np.ndarray = field(default=None)
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        at, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        # bare counts choose the features, so that rare classes and weights do not drown them
        pos, neg = (np.bincount(flat[y[at] == c], minlength=self.size) for c in (1, 0))
        n1, n0 = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
        both = (pos + neg) / (n1 + n0)
        z = np.abs(pos / n1 - neg / n0) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n1 + 1 / n0))
        z[(pos + neg) < 4] = 0
        chosen = np.argsort(-z, kind="stable")[: self.most]
        chosen = chosen[z[chosen] > 3]
        column = np.full(self.size, -1)
        column[chosen] = np.arange(len(chosen))
        x = np.zeros((len(rows), len(chosen)), np.float32)
        use = column[flat] >= 0
        x[at[use], column[flat[use]]] = 1
        w = fit_logistic(x, y, weight, 1e-4)
        self.weights, self.bias = np.zeros(self.size, np.float32), float(w[-1])
        self.weights[chosen] = w[:-1]

    def raw(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, weights=self.weights[feature], minlength=n) + self.bias

    def raw_rows(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows], np.float64) + self.bias

    def calibrate(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Platt scaling."""
        w = fit_logistic(np.clip(raw, -35, 35)[:, None] / 10, y, weight, 1e-6, 400)
        self.scale, self.shift = float(w[0] / 10), float(w[1])

    def logit(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.clip(raw, -35, 35) * self.scale + self.shift, -8, 8)


@dataclass
class CoTrained:
    views: tuple[View, View]
    mix: np.ndarray

    def score(self, raws: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return _sigmoid(sum(w * v.logit(r) for w, v, r in zip(self.mix, self.views, raws, strict=False)) + self.mix[2])


def co_train(labelled: list[tuple], y: np.ndarray, weight: np.ndarray, pool: list[tuple], rounds: int = ROUNDS) -> CoTrained:
    """labelled and pool: the features of each row in either view. Of five labelled rows three train the views, one calibrates
    them and one fits their mix; of fewer than ten rows all do all."""
    views = (View(TEXT_SIZE, FEATURES), View(META_SIZE, META_SIZE))
    turn_of = np.arange(len(y)) % 5
    train, test, last = (np.flatnonzero(x) for x in (turn_of < 3, turn_of == 3, turn_of == 4)) if len(y) >= 10 else [np.arange(len(y))] * 3
    pick = lambda rows, i, v: [rows[j][v] for j in i]
    prior = np.average(y[train], weights=weight[train]) if len(train) else 0.5
    base = np.log(np.clip(prior, 1e-4, 1 - 1e-4) / np.clip(1 - prior, 1e-4, 1))
    given: list[dict[int, int]] = [{}, {}]  # pseudo-labels of pool rows that each view got from the other
    for turn in range(rounds + 1):
        for v, view in enumerate(views):
            extra = sorted(given[v])
            view.fit(pick(labelled, train, v) + pick(pool, extra, v), np.concatenate([y[train], [given[v][j] for j in extra]]), np.concatenate([weight[train], np.full(len(extra), TRUST * weight[train].mean() if len(train) else 1.0)]))
            view.calibrate(view.raw_rows(pick(labelled, test, v)), y[test], weight[test])
        if turn == rounds:
            break
        # the pool grows by as many rows each round
        now = pool[: len(pool) * (turn + 1) // rounds]
        for v, view in enumerate(views):
            logit = view.logit(view.raw_rows(pick(now, range(len(now)), v)))
            for label, sign in ((1, 1), (0, -1)):
                sure = (_sigmoid(sign * logit) >= SURE) & (sign * (logit - base) >= MOVED)
                best = np.argsort(-sign * logit, kind="stable")[: max(1, int(SHARE * len(pool)))]
                given[1 - v].update((int(j), label) for j in best if sure[j] and int(j) not in given[1 - v])
    x = np.stack([view.logit(view.raw_rows(pick(labelled, last, v))) for v, view in enumerate(views)], 1)
    return CoTrained(views, fit_logistic(x, y[last], weight[last], 1e-6, 400))


def constant(answer: bool) -> CoTrained:
    """The classifier for labels of one class, or for none."""
    views = tuple(View(n, 0, np.zeros(n, np.float32), 8.0 if answer else -8.0) for n in (TEXT_SIZE, META_SIZE))
    return CoTrained(views, np.array([0.0, 0.0, 8.0 if answer else -8.0]))


_SAMPLE = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32()), ("text", pa.list_(pa.int32())), ("meta", pa.list_(pa.int32()))])


def _lists(doc: np.ndarray, feature: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(doc, kind="stable")
    cut = np.searchsorted(doc[order], np.arange(n + 1))
    return [feature[order[a:b]].astype(np.int32) for a, b in zip(cut, cut[1:], strict=False)]


def _meta_columns(docs: DataFrame) -> list:
    """source, lang and n_chars, null where docs lack them."""
    return [F.col(c).cast(t).alias(f"m_{c}") if c in docs.columns else F.lit(None).cast(t).alias(f"m_{c}") for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]


def source_statistics(docs: DataFrame) -> np.ndarray:
    """Documents and mean length of each of SOURCES hashed sources, from all documents; a null length counts for neither."""
    source, _, size = _meta_columns(docs)
    place = F.crc32(F.encode(F.coalesce(F.concat(F.lit("="), F.col("m_source")), F.lit("")), "UTF-8")) % SOURCES
    found = docs.select(source, size).where("m_n_chars IS NOT NULL").groupBy(place.cast("int").alias("place")).agg(F.count("*").alias("n"), F.avg("m_n_chars").alias("mean")).toArrow()
    out = np.zeros((SOURCES, 2))
    out[found["place"].to_numpy()] = np.stack([found["n"].to_numpy(), found["mean"].to_numpy()], 1)
    return out


def _meta(batch, low: int, n: int) -> list[list]:
    return [batch.column(f"m_{c}").slice(low, n).to_pylist() for c in ("source", "lang", "n_chars")]


@dataclass
class Fitted:
    """The classifiers and what the metadata view knows of sources."""

    quality: CoTrained
    toxic: CoTrained
    statistics: np.ndarray


def lowest(rows: DataFrame, seed: int, most: int, n: int) -> DataFrame:
    """The ``most`` of n different rows (k, h, ...) that a hash puts first.

    Only hashes below a bound are sorted, one that 4 * most + 200 rows are expected under: fewer than ``most`` there are as good
    as impossible, and what meets in one task does not grow with the table or its partitions."""
    at = F.xxhash64("k", "h", F.lit(seed))
    bound = min(2**63 - 1, int((4 * most + 200) / max(n, 1) * 2**64) - 2**63)
    return rows.where(at <= bound).orderBy(at, "k", "h").limit(most)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS) -> Fitted:
    """The classifiers of quality and toxicity, fitted on ``labelled`` rows for each pair of labels and on ``pool`` unlabelled ones
    in all rounds together at most: co-training draws its pseudo-labels from these ``pool`` rows alone, whatever the size of the
    table. Both are chosen by hash from all rows. The driver holds these rows' features, at most TEXT_SIZE + 6 for each.

    Labels that are null, other than 0 or 1, or of unknown documents are left out; a null doc_id in labels names a document
    only if all rows without a doc_id have one text. A label counts for every text of its doc_id. Of several labels of one
    doc_id most decide; where they tie the document is bad, or toxic. Labels of one class only give a classifier that answers
    with that class; without labels every document is good and none toxic."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    marks = labels.select(key.alias("k"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("quality IN (0, 1) AND toxic IN (0, 1)")
    marks = marks.groupBy("k").agg((F.avg("quality") > 0.5).cast("int").alias("quality"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    # every document once, so that neither rows without a doc_id nor repeated rows crowd the sample
    named = stash(keyed(docs, text_hash()).select("k", "h").distinct())
    if len(named.where(F.col("k") == NO_ID).take(2)) > 1:
        marks = marks.where(F.col("k") != NO_ID)
    judged = stash(named.join(marks, "k", "left").select("k", "h", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic")))
    sizes = {(r["quality"], r["toxic"]): r["count"] for r in judged.groupBy("quality", "toxic").count().collect()}  # five rows at most
    drawn = lambda q, t, seed, most: lowest(judged.where(f"quality = {q} AND toxic = {t}"), seed, most, sizes.get((q, t), 0))
    chosen = drawn(-1, -1, 6, pool)
    for q, t in ((0, 0), (0, 1), (1, 0), (1, 1)):
        chosen = chosen.unionByName(drawn(q, t, 5, labelled))
    count = {(r["quality"], r["toxic"]): r["count"] for r in marks.groupBy("quality", "toxic").count().collect()}
    statistics = source_statistics(docs)

    def rows(batches):
        for batch in batches:
            for low, ids, data, bounds in runs_of_texts(batch):
                n = len(ids)
                yield record(_SAMPLE, ids, batch.column("h").slice(low, n), batch.column("quality").slice(low, n), batch.column("toxic").slice(low, n), _lists(*text_features(data, bounds), n), _lists(*meta_features(*_meta(batch, low, n), statistics), n))

    # 4 * labelled + pool rows of four numbers each: safe to broadcast
    texts = keyed(docs, text_hash(), *_meta_columns(docs)).join(F.broadcast(chosen), ["k", "h"])
    # a repeated document counts once; of rows that differ in metadata alone the least stands for it
    once = texts.groupBy("k", "h").agg(F.min(F.struct(*(F.col(c) for c in texts.columns if c not in ("k", "h", "text")))).alias("m"), F.first("text").alias("text")).select("k", "h", "text", "m.*")
    found = once.mapInArrow(rows, "k long, h long, quality int, toxic int, text array<int>, meta array<int>").toArrow().sort_by([("k", "ascending"), ("h", "ascending")])
    q, t = (found[c].to_numpy() for c in ("quality", "toxic"))
    features = list(zip((np.asarray(x.values, dtype=np.int64) for x in found["text"]), (np.asarray(x.values, dtype=np.int64) for x in found["meta"]), strict=True))
    order = np.argsort(np.random.default_rng(9).permutation(len(q)), kind="stable")
    seen, rest = [i for i in order if q[i] >= 0], [features[i] for i in order if q[i] < 0]
    strata = {c: int(((q == c[0]) & (t == c[1])).sum()) for c in count}
    weight = np.array([count[int(q[i]), int(t[i])] / max(strata[int(q[i]), int(t[i])], 1) for i in seen], np.float64)
    weight = weight / weight.mean() if len(weight) else weight
    made = {}
    for name, y in (("quality", q), ("toxic", t)):
        target = y[seen].astype(np.float64)
        if len(set(target)) < 2:
            made[name] = constant(bool(target[0]) if len(target) else name == "quality")
            continue
        # strata weigh as in the whole table for the bias and calibration, but no row weighs over ten times the mean
        made[name] = co_train([features[i] for i in seen], target, np.minimum(weight, 10), rest, rounds)
    return Fitted(**made, statistics=statistics)


_SCORES = ("quality_text", "quality_meta", "quality", "toxic")


def _scored(models: Fitted, batch, low: int, ids, data, bounds) -> list[np.ndarray]:
    n, useful = len(ids), (models.quality.views[0].weights != 0) | (models.toxic.views[0].weights != 0)
    sides = text_features(data, bounds, useful), meta_features(*_meta(batch, low, n), models.statistics)
    good, bad = (tuple(v.raw(*s, n) for v, s in zip(m.views, sides, strict=True)) for m in (models.quality, models.toxic))
    text, meta = (_sigmoid(v.logit(r)) for v, r in zip(models.quality.views, good, strict=True))
    return [text, meta, models.quality.score(good), models.toxic.score(bad)]


def classify(docs: DataFrame, labels: DataFrame, good: float = GOOD, toxic: float = TOXIC, **options) -> DataFrame:
    """(doc_id, quality_text, quality_meta, quality, toxic, keep) of every row of docs. The first two are the calibrated views,
    ``quality`` and ``toxic`` the combined probabilities; keep is quality >= good and toxic < toxic's threshold. Null or empty
    texts are scored from their metadata and the lack of words; without labels every document is kept."""
    spark = docs.sparkSession
    models = spark.sparkContext.broadcast(fit(docs, labels, **options))
    schema = pa.schema([("k", pa.int64()), *((c, pa.float64()) for c in _SCORES)])

    def rows(batches):
        for batch in batches:
            for low, ids, data, bounds in runs_of_texts(batch):
                yield record(schema, ids, *_scored(models.value, batch, low, ids, data, bounds))

    scored = keyed(docs, *_meta_columns(docs)).mapInArrow(rows, "k long, " + ", ".join(f"{c} double" for c in _SCORES))
    return scored.select(doc_id(), *_SCORES, ((F.col("quality") >= good) & (F.col("toxic") < toxic)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, good: float = GOOD, toxic: float = TOXIC, **options) -> DataFrame:
    """The rows of docs that ``classify`` keeps, with all their columns, in one pass without a shuffle. Rows that repeat a
    document share its fate; an empty table stays empty."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def rows(batches):
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for low, ids, data, bounds in runs_of_texts(batch):
                s = _scored(models.value, batch, low, ids, data, bounds)
                keep.append((s[2] >= good) & (s[3] < toxic))
            yield batch.select(["text", "row"]).filter(pa.array(np.concatenate(keep)))

    rows_of = packed(docs, *_meta_columns(docs))
    return unpacked(rows_of.mapInArrow(rows, T.StructType([rows_of.schema["text"], rows_of.schema["row"]])), docs.columns)
