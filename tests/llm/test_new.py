"""Operators 11 to 13 against brute-force versions and the library, on the awkward table of test_llm."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_llm import ORDER, ROWS, SCHEMA, TEXTS, by_id, docs, empty  # noqa: F401
from veilspark.llm import base, bytebpe, runs, suffixes, trie


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(bytebpe.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bytebpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def odd_texts(rng, n):
    pieces = ["the", "ing", "er", "qu", "xz", "aab", "ba", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", "\x1f", "'s", "'ve", "9", "½", "é", "각", "😀", "ß", ".", "!!"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["!" * 3001, "aaaa" * 501, " " * 77, " a", "a "]


def test_byte_bpe_is_the_librarys(spark, docs, empty):
    encoding = library()
    got = by_id(bytebpe.digest_documents(docs), "n_tokens", "ids_sha256", "decoded_sha256")
    want = {k: encoding.encode_ordinary(t) for k, t in TEXTS.items()}
    assert got == {k: (len(x), sha(" ".join(map(str, x))), sha(TEXTS[k])) for k, x in want.items()}
    coded = by_id(bytebpe.encode_documents(docs), "ids", "decoded")
    assert {k: (v[0], v[1]) for k, v in coded.items()} == {k: (x, TEXTS[k]) for k, x in want.items()}
    assert bytebpe.digest_documents(docs).count() == len(ROWS) and bytebpe.digest_documents(empty).count() == 0


def test_byte_bpe_on_odd_white_space_and_long_words():
    encoding, share = library(), bytebpe.Share(bytebpe.shared_ranks(bytebpe.default_path()), bytebpe.default_pattern())
    for t in odd_texts(random.Random(3), 1500):
        n = share.numbers(t)
        share.learn()
        assert [i for p in n.tolist() for i in share.flat[share.start[p] : share.start[p + 1]]] == encoding.encode_ordinary(t)
        assert b"".join(share.decoded[p] for p in n.tolist()) == t.encode()


def test_replay_goes_back_for_lower_ranks(tmp_path):
    tiktoken, rng = pytest.importorskip("tiktoken"), random.Random(5)
    for turn in range(30):  # vocabularies in which any token may have any rank
        tokens = {bytes([b]) for b in range(256)}
        more = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(25)}
        ranks = {t: i for i, t in enumerate([*sorted(tokens), *rng.sample(sorted(more), len(more))])}
        path = tmp_path / f"{turn}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        encoding = tiktoken.Encoding("own", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(60)]
        assert bytebpe.Ranks(str(path)).replay([w.encode() for w in words]) == [encoding.encode_ordinary(w) for w in words]


def test_lexicon_counts_all_words(docs):
    match, count = bytebpe.matcher(bytebpe.default_pattern()), {}
    for r in ROWS:
        for w in match.findall(r[1] or ""):
            count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    want = {w for w in count if len(w.encode()) <= bytebpe.LONGEST and count[w] * 200 > total}
    assert {r["word"] for r in bytebpe.lexicon(docs, most=200).collect()} == want and 5 < len(want) < 200


def brute_runs(x, least=24, times=3):
    found = {}
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic(rng):
    m, out = rng.choice([1, 2, 3, 5]), []
    for _ in range(rng.randint(0, 6)):
        part = [rng.randrange(m) for _ in range(rng.randint(1, rng.choice([3, 12, 40])))]
        part = [0] * rng.randint(0, 20) + part if rng.random() < 0.3 else part
        out += (part * rng.randint(1, 9))[: rng.randint(1, 200)]
    return out * 3 if rng.random() < 0.2 else out


def test_runs_of_random_words():
    rng, seen = random.Random(1), 0
    for _ in range(150):
        texts = [periodic(rng) for _ in range(rng.randint(0, 5))]
        for least, times in ((24, 3), (6, 3), (10, 4), (3, 3)):
            got = [list(map(tuple, r.tolist())) for r in runs.find([np.array(t, np.int64) for t in texts], least, times)]
            assert got == [brute_runs(t, least, times) for t in texts]
            seen += sum(map(len, got))
    assert seen > 1000
    with pytest.raises(ValueError, match="three periods"):
        runs.find([], times=2)


def brute_digest(k, text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    h, n = zlib.crc32(str(k).encode()), len(w)
    if k is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (len(found), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_documents(spark, docs, empty):
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    short = {k: t for k, t in TEXTS.items() if len(t) < 20_000}
    got = by_id(runs.digest_documents(docs), *columns)
    assert {k: got[k] for k in short} == {k: brute_digest(k, t) for k, t in short.items()}
    assert runs.digest_documents(docs).count() == len(ROWS) and runs.digest_documents(empty).count() == 0
    lines = spark.createDataFrame([(i, "head " + "a b c\n" * (3 + i) + "tail x " * (i % 3), None, None, None, *ROWS[0][5:]) for i in range(60)], SCHEMA)
    got = by_id(runs.digest_documents(lines), *columns)
    assert got == {r[0]: brute_digest(r[0], r[1]) for r in lines.select("doc_id", "text").collect()} and sum(v[0] > 0 for v in got.values()) > 40
    plain = by_id(runs.find_runs(lines), "n_words", "runs", "collapsed")
    assert plain[30][2].startswith("head a b c") and len(plain[30][2].split()) < 12 and plain[30][1][0]["period"] == 3


TURNS = "conv_id long, turn long, role string, text string, k long, h1 long, d int, key string, `a.b` int, __p int"


def brute_trie(rows, change=True):
    own = {}
    for c, turn, role, text, *_ in rows:
        own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if change and c is not None else 0
        made[c] = own.get(c - c % 20, [])[:h] + t[h:] if h else t
    members = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    least = lambda x: min(x, key=lambda c: -(2**63) if c is None else c)
    out = {}
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        ends = sorted((c for c in who if len(made[c]) == len(path)), key=lambda c: -(2**63) if c is None else c)
        saved = sum((len(members[p]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) for p in below if p)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        parent = least(members[path[:-1]]) if path else None
        out[least(who), len(path)] = (parent, len(who), len(children), leaves, saved, sha(",".join("" if c is None else str(c) for c in ends)) if ends else sha(""))
    return out


def talk(rng, n):
    lines = [" ".join(rng.choice(["ja", "no", "oh\t", "so\n", "é"]) for _ in range(rng.randint(0, 5))) for _ in range(4)] + ["", None]
    rows = []
    for _ in range(n):
        c = rng.choice([*range(70), 400, 403, 419])
        if not any(r[0] == c for r in rows):
            # One line for each role, so that the order of a turn's rows, which is that of their hashes, does not matter
            rows += [(c, None if i == 0 and rng.random() < 0.2 else i, rng.choice(["u", None]), rng.choice(lines)) for i in range(rng.choice([0, 1, 2, 3, 4, 5, 9]))]
    rows += [(500 + i, j, "u", "same start" if j < 3 else f"then {i % 2}") for i in range(30) for j in range(5)]
    rows += [(None, j, "u", x) for j, x in enumerate(["same start", "no id"])]
    rows += [(60 * 20, j, None, str(j % 7)) for j in range(300)]  # a long one
    rows += [(7777, 3, "u", "twice")] * 2
    return [(*r, 1, 2, 3, "x", 4, 5) for r in rows]


def found_trie(df):
    got = {}
    for r in df.collect():
        assert (r["conv_id"], r["depth"]) not in got
        got[r["conv_id"], r["depth"]] = tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    return got


def test_prefix_trie(spark):
    rows = talk(random.Random(2), 60)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert found_trie(trie.digest_conversations(df)) == brute_trie(rows)
    assert found_trie(trie.prefix_trie(df)) == brute_trie(rows, change=False)
    assert trie.digest_conversations(df.limit(0)).count() == 0
    some = brute_trie(rows)
    assert sum(v[1] > 1 for v in some.values()) > 10 and any(v[1] == 1 and v[2] == 0 for v in some.values())


def test_index_without_rows(spark):
    rng = random.Random(11)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    frame = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for first in (frame("short", None, ""), frame().limit(0)):
        found, index = suffixes.index_batch(first)
        assert {r["lo"] is None for r in found.collect()} <= {True} and index.count() == 0
        _, index = suffixes.index_batch(frame(long), index)
        found, index = suffixes.index_batch(frame().limit(0), index)
        assert found.count() == 0
        found, _ = suffixes.index_batch(frame("x " + long), index)
        assert found.first()["lo"] == [2] and found.first()["n"] == [len(long) - suffixes.LENGTH + 1]


def test_documents_are_told_apart_by_the_fewest_hashes(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "e"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = base.told_apart(base.keyed(df, base.text_hash()), base.shared_ids(df)).collect()
    assert {(r["k"], r["text"]): r["h"] != 0 for r in told} == {(1, "a"): False, (2, "b"): True, (2, "c"): True, (base.NO_ID, "d"): True, (base.NO_ID, "e"): True, (3, ""): False} and len(told) == len(rows)
    wide = base.FEW
    try:
        base.FEW = 0  # the way beyond the bound of the broadcast
        assert sorted(base.told_apart(base.keyed(df, base.text_hash()), base.shared_ids(df)).collect()) == sorted(told)
    finally:
        base.FEW = wide
