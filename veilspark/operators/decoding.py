"""Constrained decoding of tag scores: the best path under the BIO or BIOES rules, as spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_NEVER = -1e9
_SPANS = "array<struct<start:int,end:int,category:string,score:double>>"


def _allowed(tags: list[str], scheme: str) -> np.ndarray:
    """[previous, next], the last row for the start of the text."""
    split = [(t, None) if t == "O" else tuple(t.split("-", 1)) for t in tags]
    open_end = scheme == "bio"
    out = np.zeros((len(tags) + 1, len(tags)), bool)
    for i, (p, pc) in enumerate([*split, ("O", None)]):
        for j, (n, nc) in enumerate(split):
            if p in ("B", "I"):
                out[i, j] = nc == pc if n in ("I", "E") else open_end
            else:
                out[i, j] = n in ("O", "B", "S")
    return out


def paths(scores: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The best allowed path of each row of scores [row, time, tag], of which the first sizes times count: one max-plus step for
    all rows at once. Ties go to the lower tag."""
    rows, times, tags = scores.shape
    best = np.where(allowed[-1], scores[:, 0], _NEVER)
    back = np.broadcast_to(np.arange(tags), (times, rows, tags)).copy()
    step = np.where(allowed[:-1], 0.0, -np.inf)
    for t in range(1, times):
        reach = np.where(best > _NEVER, best, -np.inf)[:, :, None] + scores[:, t][:, None, :] + step
        came, now = reach.argmax(1), reach.max(1)
        live = (sizes > t)[:, None]
        back[t] = np.where(live, came, back[t])
        best = np.where(live, np.where(np.isfinite(now), now, _NEVER), best)
    out = np.zeros((rows, times), np.int64)
    out[:, -1] = best.argmax(1)
    for t in range(times - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(rows), out[:, t]]
    return out


def decode_batch(scores: np.ndarray, sizes: np.ndarray, tags: list[str], scheme: str) -> tuple[np.ndarray, ...]:
    """(row, start, end, category number, score) of the spans on the best paths of rows of log-probabilities; a span's score is the
    mean over its times."""
    kind = np.array([t[0] for t in tags])
    path = paths(scores, sizes, _allowed(tags, scheme))
    inside = np.arange(path.shape[1]) < sizes[:, None]
    first = np.isin(kind, ("B", "S"))[path] & inside
    goes_on = np.isin(kind, ("I", "E"))[path] & inside
    # the first time at or after each that does not go on
    stop = np.where(goes_on, path.shape[1], np.arange(path.shape[1]))
    stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
    stop = np.concatenate([stop, np.full((len(path), 1), path.shape[1])], axis=1)
    row, start = np.nonzero(first)
    end = np.where(kind[path[row, start]] == "S", start + 1, np.minimum(stop[row, start + 1], sizes[row]))
    own = np.take_along_axis(scores, path[:, :, None], 2)[:, :, 0]
    total = np.concatenate([np.zeros((len(path), 1)), np.cumsum(np.where(inside, own, 0.0), axis=1)], axis=1)
    return row, start, end, path[row, start], (total[row, end] - total[row, start]) / (end - start)


def decode(scores: np.ndarray, tags: list[str], scheme: str) -> list[dict]:
    """The spans of one row [time, tag]."""
    if not len(scores):
        return []
    _, *found = decode_batch(np.asarray(scores, float)[None], np.array([len(scores)]), tags, scheme)
    return [{"start": s, "end": e, "category": tags[t].partition("-")[2], "score": x} for s, e, t, x in zip(*(f.tolist() for f in found), strict=True)]


#: Scores of rows that are decoded at once, padded to the longest of them.
CELLS = 4_000_000


def _spans_of(column: pa.Array, tags: list[str], scheme: str) -> pa.Array:
    """The spans of a column of array<array<double>>, rows of like length together; null gives none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(pc.list_flatten(column)).to_numpy(zero_copy_only=False).reshape(-1, len(tags))
    at = np.concatenate([[0], np.cumsum(sizes)])
    order, found, low = np.argsort(sizes, kind="stable"), [], int((sizes == 0).sum())
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * sizes[order[high]] * len(tags) <= CELLS:
            high += 1
        rows = order[low:high]
        n = sizes[rows]
        padded = np.zeros((len(rows), int(n[-1]), len(tags)))
        inner = np.arange(int(n[-1])) < n[:, None]
        padded[inner] = flat[np.concatenate([np.arange(at[r], at[r + 1]) for r in rows])]
        row, *rest = decode_batch(padded, n, tags, scheme)
        found.append((rows[row], *rest))
        low = high
    row, start, end, tag, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
    by = np.lexsort((start, row))
    categories = [t.partition("-")[2] for t in tags]
    spans = pa.StructArray.from_arrays([pa.array(start[by].astype(np.int32)), pa.array(end[by].astype(np.int32)), pa.array([categories[i] for i in tag[by].tolist()], pa.string()), pa.array(score[by].astype(float))], names=["start", "end", "category", "score"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[by], np.arange(len(sizes) + 1)).astype(np.int32)), spans)


def viterbi(scores: Column, tags: list[str], scheme: str) -> Column:
    """array<array<double>> to spans; null or empty scores have none. A choice among tags at each of many times is no fold that
    Spark's own functions express well, so Arrow batches go through numpy, all rows of a batch at once."""
    @F.arrow_udf(_SPANS)
    def run(rows: pa.Array) -> pa.Array:
        return _spans_of(rows, tags, scheme)

    return run(scores)
