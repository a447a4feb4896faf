"""Operator 4, BPE encoding and decoding, by batched numpy merge rounds.

The symbols of many pretokens lie in one flat array. A round looks all adjacent pairs up by binary search
over the sorted keys of the merge table, finds the lowest rank of each pretoken, and merges that pair
wherever it stands in the pretoken, from left to right. Pretokens without a mergeable pair leave the rounds.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm import wordtok
from veilspark.llm.base import doc_id, keyed, record

_NEVER = np.int64(2**62)


class NumpyBpe:
    """Merge rounds over numpy arrays, for vocabularies of byte letters with or without a word-end mark."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.width = np.int64(max(vocab.values(), default=0) + 1)
        left, right, made = (np.array([vocab[x] for x in part], np.int64) for part in (*(list(p) for p in zip(*merges, strict=True)), [a + b for a, b in merges])) if merges else (np.zeros(0, np.int64),) * 3
        keys = left * self.width + right
        first = np.arange(len(keys))
        order = np.lexsort((first, keys))
        keep = order[np.concatenate([[True], np.diff(keys[order]) > 0])] if len(keys) else order
        last = {}
        for rank, key in enumerate(keys.tolist()):
            last[key] = rank  # a pair listed twice has the later rank
        self.keys = keys[keep]
        self.rank = np.array([last[k] for k in self.keys.tolist()], np.int64)
        self.made = made[self.rank] if len(keys) else made
        # A symbol that is used by a merge of lower rank than one that makes it could jump the queue.
        used = np.full(int(self.width), _NEVER)
        np.minimum.at(used, left, first)
        np.minimum.at(used, right, first)
        self.whole_rounds = bool((used[made] > first).all())
        letters = wordtok.byte_letters()
        self.plain = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)

    @classmethod
    def from_file(cls, path: str) -> NumpyBpe:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return cls(model["vocab"], merges, model.get("end_of_word_suffix") or "")

    def _ranks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each adjacent pair in the sorted table and its rank, or no rank."""
        pair = symbols[:-1] * self.width + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, pair), max(len(self.keys) - 1, 0))
        return at, np.where(self.keys[at] == pair, self.rank[at], _NEVER) if len(self.keys) else np.full(len(pair), _NEVER)

    def __call__(self, pretokens: list[str]) -> list[list[int]]:
        raw = [x.encode("utf-8", "surrogatepass") for x in pretokens]
        size = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols, word = self.plain[data], np.repeat(np.arange(len(raw)), size)
        if len(data):
            ends = np.cumsum(size)[size > 0] - 1
            symbols[ends] = self.final[data[ends]]
        known = symbols >= 0  # a letter that the vocabulary lacks is dropped
        symbols, word = symbols[known], word[known]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            at, rank = self._ranks(symbols)
            rank[word[:-1] != word[1:]] = _NEVER
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(np.append(rank, _NEVER), starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            live = np.repeat(best < _NEVER, sizes)
            if not live.all():
                done.append((word[~live], symbols[~live]))
                if not live.any():
                    break
            hit = np.append(rank, _NEVER) == np.repeat(best, sizes)
            hit &= live
            places = np.flatnonzero(hit)
            if self.whole_rounds:  # of hits in a row, each shares a symbol with the next: take every other one
                run = np.concatenate([[True], np.diff(places) > 1])
                nth = np.arange(len(places)) - np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
                places = places[nth % 2 == 0]
            else:
                places = places[np.concatenate([[True], np.diff(word[places]) > 0])]
            symbols[places] = self.made[at[places]]
            live[places + 1] = False
            symbols, word = symbols[live], word[live]
        words = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        ids = ids[np.argsort(words, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(words, minlength=len(raw))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


_TOKENS: dict[str, list[str]] = {}


def token_strings(path: str) -> list[str]:
    if path not in _TOKENS:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocab = made["model"]["vocab"] | {t["content"]: t["id"] for t in made["added_tokens"]}
        _TOKENS[path] = [""] * (max(vocab.values()) + 1)
        for token, n in vocab.items():
            _TOKENS[path][n] = token
    return _TOKENS[path]


def decode(ids: list[int], path: str) -> str:
    """The text of ids for a tokenizer without a decoder: its tokens, joined by spaces."""
    return " ".join(map(token_strings(path).__getitem__, ids))


_CODED = pa.schema([("k", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_DIGEST = pa.schema([("k", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _coded(batches, path: str):
    encoder = wordtok.shared_encoder(path, "numpy")
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for low, high in wordtok.groups(texts):
            ids, ends = encoder.encode(texts[low:high])
            cut = [0, *ends.tolist()]
            yield batch.column("k").slice(low, high - low), [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of whole texts; a null or empty text has no ids and decodes to ''."""
    path = path or wordtok.default_path()

    def rows(batches):
        for k, coded in _coded(batches, path):
            yield record(_CODED, k, [x.astype(np.int32) for x in coded], [decode(x.tolist(), path) for x in coded])

    return keyed(docs).mapInArrow(rows, "k long, ids array<int>, decoded string").select(doc_id(), "ids", "decoded")


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As encode_documents, but the number of ids and the SHA-256 of ids and decoded text.

    Each row is encoded by its own text: rows that repeat a doc_id, or have none, each get theirs; ties do not arise. A very long
    text is whole, in a group of its own. No rows give no rows."""
    path = path or wordtok.default_path()

    def rows(batches):
        for k, coded in _coded(batches, path):
            yield record(_DIGEST, k, [len(x) for x in coded], [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded], [hashlib.sha256(decode(x.tolist(), path).encode()).hexdigest() for x in coded])

    return keyed(docs).mapInArrow(rows, "k long, n_tokens long, ids_sha256 string, decoded_sha256 string").select(doc_id(), "n_tokens", "ids_sha256", "decoded_sha256")
