"""Each operator against a brute-force version, on a table with the awkward cases: null ids, texts and columns, empty and long
texts, repeated rows, ties, and extra columns whose names the operators use inside."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilspark.llm import base, bpe, components, cotrain, hashing, imatch, isomedia, lengths, ngramjoin, packing, planes, secrets, suffixes, wordtok

CLASHING = "k long, row string, lo int, n int, bits string, part int, start int, size int, h long, none string, last int, `a.b` int, `c``d` string, __k long, __null string, __gone int, __spans string, __h long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
EXTRA = (1, "r", 2, 3, "b", 4, 5, 6, 7, "n", 8, 9, "q", 10, "z", 11, "s", 12)
NO_ID = -(2**63)


def words(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "ti", "éa", "sch", "ñ"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def rows():
    rng = random.Random(7)
    base = [words(rng, 90) for _ in range(12)]
    passage = words(rng, 60)
    secret = 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"'
    texts = [*base]
    texts += [base[0], base[0], base[1].replace("the", "THE", 1), base[2] + " one more", base[3][: len(base[3]) // 2] + passage, "x " + passage + " y", passage]
    texts += [f"{base[4]} {secret} {base[5]}", f"{secret} {base[6]}", "AKIA" + "A" * 20 + " token=secret:abcdefgh password: 'hunter22'", "", None, " \n\t ", "a", "two words", "<|endoftext|> Straße 가각 😀 \x1c ΑΣ"]
    texts += [words(rng, 12_000), "!" * 3000, "ab" * 700, "z" * 250]
    out = [(i, t, rng.choice(["en", "de", None]), f"src{i % 3}" if i % 7 else None, len(t) if t is not None and i % 5 else None, *EXTRA) for i, t in enumerate(texts)]
    out.append(out[2])  # a repeated row
    out.append((None, base[7], None, None, None, *[None] * len(EXTRA)))
    return out


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    """Rows by doc_id; repeated rows must agree."""
    out = {}
    for r in df.select("doc_id", *columns).collect():
        value = tuple(r[1:])
        assert out.setdefault(r[0], value) == value
    return out


TEXTS = {r[0]: r[1] or "" for r in ROWS}
ORDER = sorted(TEXTS, key=lambda k: NO_ID if k is None else k)


def least(ids):
    return min(ids, key=lambda k: NO_ID if k is None else k)


def test_secrets(spark, docs, empty):
    patterns = [("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    want = {}
    for k, t in TEXTS.items():
        found = sorted((m.start(), i, m.end(), name) for i, (name, p, g, n) in enumerate(patterns) for m in p.finditer(t) if len(m[g]) >= n)
        count = collections.Counter(x[3] for x in found)
        want[k] = (count["assign"], count["access"], count["hex"], hashlib.sha256(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in found).encode()).hexdigest())
    got = secrets.digest(secrets.scan(docs))
    assert by_id(got, "n_assign", "n_access", "n_hex", "base_sha256") == want
    assert got.count() == len(ROWS) and secrets.digest(secrets.scan(empty)).count() == 0
    assert any(v[2] for v in want.values()) and all(s[0].count("hex") == want[k][2] for k, s in by_id(got, "spans").items())


def test_secrets_by_ownership(spark):
    bare = "Zx9Qw8Er7Ty6Ui5Op4As3"
    rows = [(i, f"see {bare}{'A' if i == 5 else ''} now", "en", f"s{i}") for i in range(6)] + [(9, f"token={bare}", "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = by_id(secrets.digest(secrets.scan(df)), "spans", "n_live", "n_copied")
    assert got[0] == ("", 0, 0) and got[5] == (f"bare:4:{5 + len(bare)}", 1, 0) and got[9] == (f"assign:0:{6 + len(bare)}", 0, 1)
    assert by_id(secrets.redact(df), "text")[9] == ("[SECRET]",) and by_id(secrets.redact(df), "text")[0][0] == rows[0][1]


def extras_stay(df):
    """The columns besides the text are what they were."""
    rest = [c for c in df.columns if c not in ("doc_id", "text", "n_chars")]
    want = {r[0]: (r[2], r[3], *r[5:]) for r in ROWS}
    return by_id(df, *(base.quoted(c) for c in rest)) == {k: want[k] for k in {r[0] for r in df.select("doc_id").collect()}}


def test_redact_keeps_rows_and_columns(docs):
    done = secrets.redact(docs)
    assert done.columns == docs.columns and done.count() == len(ROWS)
    assert extras_stay(done)
    got = by_id(done, "text")
    assert got[20][0] == f'[SECRET]" {TEXTS[6]}' and got[19][0] == f'{TEXTS[4]} [SECRET]" {TEXTS[5]}' and got[23] == (None,)


def brute_repeats(length):
    seen, out = set(), {}
    for k in ORDER:
        b = TEXTS[k].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out[k] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest())
    return out


@pytest.mark.parametrize("length,hot", [(100, suffixes.HOT), (41, suffixes.HOT), (100, 1), (41, 2)])
def test_suffixes(docs, empty, length, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BATCH", 3000)
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    got = suffixes.digest_documents(docs, length)
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(length) and got.count() == len(ROWS)
    assert suffixes.digest_documents(empty).count() == 0
    assert sum(v[1] for v in brute_repeats(length).values()) > 3000


def level(*texts, start=0, **options):
    """A level of the spans of documents, numbered from start on."""
    raw = [t if isinstance(t, bytes) else t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    doc, lo, n, before = suffixes.spans_of(data, bounds, 20, 8)
    return suffixes.Level(suffixes.byte_rows(data, bounds[doc] + lo, n, before, 20, 8), before, n, doc + start, doc * 0, lo, doc * 0, length=20, anchor=8)


def test_suffix_spans_and_rows():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    bounds = np.array([0, 1000, 1050, 3000])
    doc, lo, n, before = suffixes.spans_of(text, bounds, 100, 32)
    starts = sorted((int(d), int(a) + i) for d, a, m in zip(doc, lo, n, strict=True) for i in range(m))
    assert starts == [(0, i) for i in range(901)] + [(2, i) for i in range(1851)]  # every window in one span, none across documents
    rows = suffixes.byte_rows(text, bounds[doc] + lo, n, before, 100, 32)
    for i in range(0, len(lo), 7):
        span = text[bounds[doc[i]] + lo[i] :][: n[i] + 99].tobytes()
        right = span[before[i] :]
        assert rows[i].tobytes() == right.ljust(100, b"\0") + span[: before[i]][::-1].ljust(68, b"\0")


def test_suffix_arrays_are_in_byte_order_and_merge():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(300)) + "\0" * rng.randint(0, 40) for _ in range(12)]
    one = level(*texts)
    rows = [r.tobytes() for r in one.text]
    assert rows == sorted(rows) and len(one) > 100
    back = suffixes.Level.from_blob(one.blob())
    assert all((getattr(one, x) == getattr(back, x)).all() for x in one.NAMES)
    parts = [level(t, start=i) for i, t in enumerate(texts)]
    both = functools.reduce(lambda a, b: a.merged(b), parts)
    assert (both.text == one.text).all() and (both.k == one.k).all() and (both.lo == one.lo).all()


@pytest.mark.parametrize("hot", [None, 3])
def test_suffix_family_finds_every_repeated_window(hot):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abc") for _ in range(30)) for _ in range(4)]
    texts = ["".join(rng.choice(["a", "b", "c", rng.choice(pool)]) for _ in range(40)) for _ in range(15)]
    seen, want = set(), set()
    for d, t in enumerate(texts):
        for i in range(len(t) - 19):
            if t[i : i + 20] in seen:
                want.add((d, i))
            seen.add(t[i : i + 20])
    family, found = suffixes.Family(hot=hot), []
    for i, t in enumerate(texts):
        one = level(t, start=i)
        found.append(one.repeats())
        found += family.add(one)
        sizes = [len(x) for x in family.levels]
        assert all(a > 2 * b for a, b in itertools.pairwise(sizes))
    found += list(family.close())
    found.append(family.levels[0].long_matches())
    marked = {(int(k), int(lo) + j) for f in found for k, lo, n, _ in zip(*f, strict=True) for j in range(int(n))}
    if hot is None:
        assert marked == want and len(want) > 100
    else:  # windows of hot anchors are left to the second pass, each span of them whole
        away = {(int(k), int(lo) + j) for f in family.gone for k, lo, n, _ in zip(*f, strict=True) for j in range(int(n))}
        assert family.gone and marked <= want <= marked | away


def test_later_batches_meet_the_levels_of_an_index(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH", 2000)
    rng = random.Random(2)
    passage = [words(rng, 40) for _ in range(5)]
    batches = [[(10 * b + i, f"{words(rng, 20)} {rng.choice(passage)} {words(rng, 20)}") for i in range(8)] for b in (3, 1, 2)]
    seen, index, levels = set(), None, 0
    for rows in batches:
        want = {}
        for k, t in rows:
            b = t.encode()
            want[k] = {i for i in range(len(b) - 99) if b[i : i + 100] in seen}
            seen |= {b[i : i + 100] for i in range(len(b) - 99)}
        found, index = suffixes.index_batch(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), index)
        index = base.stash(index)
        got = {r["doc_id"]: {lo + j for lo, n in zip(r["lo"] or [], r["n"] or [], strict=True) for j in range(n)} for r in found.collect()}
        assert got == want
        assert index.count() >= levels
        levels = index.where("kind > 3").count()
    assert any(want.values())


def test_drop_repeats_keeps_characters(docs):
    done = suffixes.drop_repeats(docs)
    assert done.columns == docs.columns and done.count() == len(ROWS) and by_id(done, "text")[23] == (None,)
    assert extras_stay(done)
    got = by_id(done, "text")
    first, later = sorted(k for k in TEXTS if TEXTS[k] == TEXTS[0])[:2]
    assert got[first][0] == TEXTS[0] and got[later][0] == ""


def test_bpe_is_what_the_library_makes(docs, empty):
    from tokenizers import Tokenizer

    path = wordtok.default_path()
    library = Tokenizer.from_file(path)
    want = {k: library.encode(t, add_special_tokens=False).ids for k, t in TEXTS.items()}
    got = by_id(bpe.digest_documents(docs), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == {k: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for k, x in want.items()}
    assert {k: list(v[0]) for k, v in by_id(bpe.encode_documents(docs), "ids").items()} == want and bpe.encode_documents(empty).count() == 0
    assert by_id(lengths.document_lengths(docs), "n_tokens") == {k: (len(x),) for k, x in want.items()}


def test_bpe_merges_one_at_a_time_where_ranks_are_out_of_order():
    vocab = {c: i for i, c in enumerate(["a", "b", "c", "ab", "bc", "abc", "abca"])}
    merges = [("abc", "a"), ("a", "bc"), ("b", "c"), ("a", "b"), ("ab", "c")]
    model = bpe.NumpyBpe(vocab, merges)
    assert not model.whole_rounds
    rank = {m: i for i, m in enumerate(merges)}

    def slow(word):
        s = list(word)
        while True:
            pairs = [(rank[p], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in rank]
            if not pairs:
                return [vocab[x] for x in s]
            i = min(pairs)[1]
            s[i : i + 2] = [s[i] + s[i + 1]]

    tried = ["".join(p) for n in range(1, 7) for p in itertools.product("abc", repeat=n)]
    assert model(tried) == [slow(w) for w in tried]


def test_media(docs, empty):
    want = {}
    for k, t in TEXTS.items():
        b = t.encode()
        p = b + b"\0" * ((-len(b)) % 64 or (64 if not b else 0))
        want[k] = (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert by_id(isomedia.digest_documents(docs), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    assert isomedia.digest_documents(empty).count() == 0
    payload = bytes(range(256)) * 50
    media = isomedia.write_container(payload)
    (track,) = isomedia.read_container(media)
    assert isomedia.stored_bytes(media, track) == payload and track.codec == "raw " and len(track.keyframes) == 25
    assert b"".join(media[a:b] for a, b in track.ranges) == payload
    assert isomedia.read_container(b"") == [] and isomedia.read_container(b"\0\0\0\1abcd") == [] and isomedia.read_container(media[:40]) == []


def test_media_columns(spark):
    media = isomedia.write_container(b"x" * 640)
    df = spark.createDataFrame([(1, media, "own"), (2, None, "own"), (3, b"junk", "own")], "i int, media binary, codec string")
    got = {r["i"]: (r["codec"], r["duration_s"]) for r in isomedia.media_columns(df).collect()}
    assert got == {1: ("raw ", 0.01), 2: (None, None), 3: (None, None)}


def slow_mix(x):
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ x >> 33) * m) % 2**64
    return x ^ x >> 33


@functools.cache
def slow_word(word):
    return slow_mix(sum(int(hashing._TABLE[c]) * pow(hashing._BASE, i, 2**64) for i, c in enumerate(word)) % 2**64)


class SlowImatch:
    """Fingerprints of a table by sets, one subset and one term after another."""

    def __init__(self, texts, low, high):
        df = collections.Counter(w for t in texts for w in self.words(t))
        self.lexicon = {w for w, n in df.items() if low <= n <= high}

    @staticmethod
    def words(text):
        return {slow_word(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text).encode())}

    def __call__(self, text):
        terms = self.words(text)
        terms = terms & self.lexicon if len(terms & self.lexicon) >= imatch.FEWEST else terms
        out = []
        for j in range(imatch.SUBSETS):
            held = sorted(w for w in terms if slow_mix(w ^ 0x9FB21C651E98DF25 * (j + 1) % 2**64) >> 64 - (1 + j // imatch.EACH) == 0)
            total = sum(slow_mix((w + 0xA24BAED4963EE407) % 2**64) for w in held) % 2**64
            out.append(max(slow_mix(total) >> 48, 1) if held else 0)
        return out

    @staticmethod
    def likeness(a, b):
        rates = [list(zip(a, b, strict=True))[i : i + imatch.EACH] for i in range(0, imatch.SUBSETS, imatch.EACH)]
        held = [sum(x > 0 or y > 0 for x, y in r) for r in rates]
        if not any(held):
            return 1.0
        first = next((i for i, n in enumerate(held) if n <= imatch.EACH * 9 // 10), imatch.RATES - 1)
        first = min(first, max(i for i, n in enumerate(held) if n))
        return sum(x == y and x > 0 for r in rates[first:] for x, y in r) / sum(held[first:])


@pytest.mark.parametrize("least,most", [(imatch.LEAST, imatch.MOST), (50, 2)])
def test_imatch(docs, empty, least, most):
    slow = SlowImatch([r[1] or "" for r in ROWS], len(ROWS) / least, len(ROWS) / most)
    digits = lambda h: "".join(f"{x:04x}" for x in h)
    want = {}
    for k, following in zip(ORDER, [*ORDER[1:], ORDER[0]], strict=True):
        t = TEXTS[k]
        changed = imatch.edited(t, TEXTS[following])
        assert changed == t[: len(t) - len(t) // 4] + TEXTS[following][: len(t) // 4]
        own, new, after = slow(t), slow(changed), slow(TEXTS[following])
        want[k] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), digits(own), digits(new), slow.likeness(own, new), slow.likeness(own, after))
    out = imatch.digest_documents(docs, least, most)
    got = by_id(out, *out.columns[1:])
    assert {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in want.items()}
    assert all(got[k][4:] == pytest.approx(want[k][4:]) for k in want) and out.count() == len(ROWS)
    long = [v for k, v in got.items() if 300 < v[0] < 20_000 and k is not None and 4 <= k < 12]
    assert np.mean([v[4] for v in long]) > np.mean([v[5] for v in long]) + 0.2


def test_imatch_small_tables(spark, empty):
    assert imatch.digest_documents(empty).count() == 0
    one = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")
    (r,) = imatch.digest_documents(one).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"a b c a").hexdigest() and r["near_next"] == 1
    copies = spark.createDataFrame([(None, None)] * 9 + [(None, "x y")] * 5 + [(1, "")], "doc_id long, text string").repartition(4)
    got = collections.Counter(tuple(r) for r in imatch.digest_documents(copies).collect())
    assert sorted(got.values()) == [1, 5, 9]


def test_imatch_ranges():
    k, t = np.array([1, 1, 1, 4, 6]), np.array([0, 5, 9, 0, 2])
    assert imatch.range_of(k, t, np.array([1, 1, 1, 1, 2, 4, 6, 6, 7]), np.array([0, 4, 5, 99, -3, 7, 1, 2, -9])).tolist() == [0, 0, 1, 2, 2, 3, 3, 4, 4]


def test_imatch_hashes_what_the_lexicon_holds():
    lexicon = hashing.mix(np.arange(1, 200, dtype=np.uint64))
    make = imatch.Fingerprinter(lexicon.view(np.int64))
    assert (make.count == imatch.Fingerprinter._subsets(make.terms).sum(1)).all()
    texts = ["b a a", "a b", "", "a b c"]
    raw = [t.encode() for t in texts]
    h = make(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert (h[0] == h[1]).all() and not h[2].any() and not (h[0] == h[3]).all()
    assert imatch.likeness(h[:1], h[1:2])[0] == 1 and imatch.likeness(h[2:3], h[2:3])[0] == 1 and imatch.likeness(h[:1], h[2:3])[0] == 0


def test_length_histogram(spark, docs, empty):
    n = sorted(lengths.token_counts(docs).toPandas()["n_tokens"])
    got = {r["length"]: r for r in lengths.token_histogram(docs).collect()}
    assert sorted(got) == sorted(set(n)) and lengths.token_histogram(empty).count() == 0
    for limit, r in got.items():
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (n.count(limit), sum(x >= limit for x in n), sum(x for x in n if x >= limit))
        assert r["truncated_tokens"] == sum(min(x, limit) for x in n) and r["total_tokens"] == sum(n) and abs(r["quantile"] - sum(x <= limit for x in n) / len(n)) < 1e-12
    limits = {r["context"]: (r["docs_over"], r["truncated_tokens"]) for r in lengths.at_limits(lengths.token_histogram(docs), [0, 7, 500, 10**6]).collect()}
    assert limits == {c: (sum(x > c for x in n), sum(min(x, c) for x in n)) for c in (0, 7, 500, 10**6)}


def brute_components(n, num, den):
    sets = {}
    for k, t in TEXTS.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            low = least([x, y])
            root[x] = root[y] = low
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (1, 6, 10)])
def test_ngram_join(docs, empty, n, num, den, monkeypatch):
    monkeypatch.setattr(base, "SHARE", 5)
    monkeypatch.setattr(ngramjoin, "BLOCK", 3)
    monkeypatch.setattr(ngramjoin, "TRIED", 1)
    got = ngramjoin.join_documents(docs, n, num, den)
    want = brute_components(n, num, den)
    assert by_id(got, "n_shingles", "component_id") == want and got.count() == len(ROWS)
    assert len({v[1] for v in want.values()}) < len(want)
    assert ngramjoin.join_documents(empty, n, num, den).count() == 0


def test_ngram_parts_are_shared_by_all_links():
    """Any two sets of the threshold share a part, and bitmaps never bound the overlap too low."""
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100), (60, 100)):
        bands = ngramjoin.Bands(num, den)
        for _ in range(400):
            x = np.unique(rng.integers(0, 2**64, rng.integers(1, 300), np.uint64))
            differ = int(len(x) * (den - num) // num)
            gone = int(rng.integers(0, differ + 1))
            y = np.unique(np.concatenate([x[rng.permutation(len(x))[gone:]], rng.integers(0, 2**64, rng.integers(0, differ - gone + 1), np.uint64)]))
            if ngramjoin.linked(x, y, num, den):
                assert len(np.intersect1d(bands.keys(x), bands.keys(y)))
            a, b = ngramjoin.signature(x), ngramjoin.signature(y)
            while len(a) != len(b):
                long = a if len(a) > len(b) else b
                long = long[: len(long) // 2] ^ long[len(long) // 2 :]
                a, b = (long, b) if len(a) > len(b) else (a, long)
            assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(np.setxor1d(x, y))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (5, 5)], "a long, b long")
    got = {r["k"]: r["root"] for r in components.connected(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}
    assert components.connected(edges.where("a < 0")).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_id_planes(docs, empty, bits):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(wordtok.default_path())
    got = sorted((tuple(r) for r in planes.read_documents(planes.write_ids(docs, bits=bits)).collect()), key=lambda r: r[1])
    want, at = [], 0
    for k, t in sorted(((NO_ID if r[0] is None else r[0], r[1] or "") for r in ROWS), key=lambda x: x[0]):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want.append((None if k == NO_ID else k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want and planes.read_documents(planes.write_ids(empty, bits=bits)).count() == 0


def test_id_plane_files():
    ids = np.random.default_rng(2).integers(0, 2**32, 40_001, np.uint32)
    for bits in (False, True):
        file = planes.File(planes.write_file(ids, np.array([5, -1]), np.array([40_000, 1]), bits))
        assert (file.ids() == ids).all() and (file.block(1) == ids[planes.BLOCK : 2 * planes.BLOCK]).all() and file.doc_ids.tolist() == [5, -1]
    assert len(planes.File(planes.write_file(ids[:0], np.array([7]), np.array([0]))).ids()) == 0
    with pytest.raises(ValueError, match="not a file"):
        planes.File(b"x" * 99)


def test_best_boundaries_are_optimal():
    rng = np.random.default_rng(8)
    for _ in range(40):
        length = np.unique(rng.integers(0, 60, 9))
        count = rng.integers(1, 9, len(length))
        for buckets in (1, 2, 3, 20):
            cost = lambda tops: sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(length, count, strict=True))
            best = min(cost((*inner, length[-1])) for n in range(min(buckets, len(length))) for inner in itertools.combinations(length[:-1], n))
            got = packing.best_boundaries(length, count, buckets)
            assert len(got) <= buckets and got == sorted(got) and cost(got) == best
    assert packing.best_boundaries(np.array([]), np.array([])) == []


def test_packing(docs, empty, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 5)
    rows = packing.pack(docs, buckets=4, budget=2000).collect()
    assert len(rows) == len(ROWS) and packing.pack(empty).count() == 0
    groups = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["padding"] == r["bucket_len"] - r["n_tokens"]
        groups[r["bucket"], r["batch"]].append(r)
    for (bucket, batch), members in groups.items():
        slots = max(1, 2000 // max(members[0]["bucket_len"], 1))
        assert sorted(m["slot"] for m in members) == list(range(len(members))) and len(members) <= slots
        assert len(members) == slots or (bucket, batch + 1) not in groups
    counts = collections.Counter(r["n_tokens"] for r in rows)
    tops = packing.best_boundaries(np.array(sorted(counts)), np.array([counts[x] for x in sorted(counts)]), 4)
    assert {r["bucket_len"] for r in rows} == set(tops)


def test_packing_is_exact_at_any_length(spark):
    n = [5, 70_001, 70_003, 131_073, 131_074, 1_000_001, 1_000_001, 5_000_003]
    counts = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "k long, n_tokens long")
    for buckets in (1, 3, 6, 16):
        held = collections.Counter(n)
        want = packing.best_boundaries(np.array(sorted(held)), np.array([held[x] for x in sorted(held)]), buckets)
        assert packing.plan(counts, buckets) == (want, len(n)) and set(want) <= set(n) and want[-1] == max(n)


def labelled(spark, n=400):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        bad, rude = i % 4 == 0, i % 5 == 0
        w = words(rng, rng.randint(30, 90)).split()
        if bad:
            w = [x.upper() + "!!" for x in w]
        if rude:
            w[5:5] = ["idiot", "clown"]
        docs.append((i, " ".join(w), "en", "spam" if bad and i % 3 else "src", None))
        if i % 2:
            labels.append((i, int(not bad), int(rude)))
        elif i % 8 in (0, 2):
            labels.append((i, int(not bad), int(rude)))
    labels += [(None, 1, 0), (10**6, 0, 0), (3, None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cotraining_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    known = {r[0] for r in labels.collect()}
    got = by_id(cotrain.classify(docs, labels), "quality", "toxic", "keep")
    held = [k for k in got if k not in known]
    assert len(held) > 50
    assert np.mean([(got[k][0] >= 0.5) == (k % 4 != 0) for k in held]) > 0.95
    assert np.mean([(got[k][1] >= 0.5) == (k % 5 == 0) for k in held]) > 0.95
    kept = cotrain.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {k for k in got if got[k][2]}


def test_cotraining_exchanges_pseudo_labels():
    """Words that no labelled row holds are learnt from pool rows that the metadata view has labelled."""
    rng = np.random.default_rng(0)

    def row(c, word, place):
        return np.array([word + int(c), 50 + int(rng.integers(0, 9))]), np.array([place + int(c), 90 + int(rng.integers(0, 5))])

    y, pool = rng.integers(0, 2, 400), rng.integers(0, 2, 1000)
    labelled, unlabelled = [row(c, 0, 10) for c in y], [row(c, 20, 10) for c in pool]
    test = rng.integers(0, 2, 200)
    rows = [row(c, 20, 30) for c in test]  # words of the pool, metadata that tells nothing

    def right(rounds):
        model = cotrain.co_train(labelled, y.astype(float), np.ones(400), unlabelled, rounds)
        p = model.score(tuple(v.raw_rows([r[i] for r in rows]) for i, v in enumerate(model.views)))
        return ((p >= 0.5) == test).mean()

    assert right(0) < 0.7 and right(cotrain.ROUNDS) == 1


def test_lowest_takes_the_first_rows_by_hash(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, base.NO_ID).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("h"))
    brute = {tuple(r) for r in rows.orderBy(F.xxhash64("k", "h", F.lit(6)), "k", "h").limit(100).collect()}
    assert {tuple(r) for r in cotrain.lowest(rows, 6, 100, 20_000).collect()} == brute
    few = rows.where("k % 1000 = 1")
    assert cotrain.lowest(few, 6, 100, few.count()).count() == few.count() < 100
    assert cotrain.lowest(rows.where("false"), 6, 100, 0).count() == 0


def test_cotraining_views_share_nothing():
    data = np.frombuffer(b"one TWO\nthree", np.uint8)
    stats = np.zeros((cotrain.SOURCES, 2))
    doc, feature = cotrain.meta_features(["a", None], ["en", None], [5, None], stats)
    assert feature.max() < cotrain.META_SIZE and sorted(set(doc.tolist())) == [0, 1]
    assert cotrain.text_features(data, np.array([0, 7, 13]))[1].max() < cotrain.TEXT_SIZE and cotrain.text_features(data[:0], np.array([0, 0]))[1].tolist() == [cotrain._LINE]


def test_cotraining_ties_and_repeated_labels(spark):
    docs, labels = labelled(spark)
    more = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (1, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    seen = {}
    train = cotrain.co_train
    try:
        cotrain.co_train = lambda rows, y, w, pool, rounds: seen.setdefault(len(seen), y) is None or train(rows, y, w, pool, 0)
        cotrain.fit(docs, more.unionByName(spark.createDataFrame([(3, 1, 0)], more.schema)))
    finally:
        cotrain.co_train = train
    assert sorted(seen[0]) == [0, 1] and sorted(seen[1]) == [0, 1]
    assert labels.count()


def test_source_statistics(docs, empty):
    stats = cotrain.source_statistics(docs)
    sizes = collections.defaultdict(list)
    for r in ROWS:
        if r[4] is not None:
            sizes[zlib.crc32(("" if r[3] is None else "=" + r[3]).encode()) % cotrain.SOURCES].append(r[4])
    assert {i: (len(x), np.mean(x)) for i, x in sizes.items()} == {i: tuple(stats[i]) for i in np.flatnonzero(stats[:, 0]).tolist()}
    assert not cotrain.source_statistics(empty).any()


def test_cotraining_on_real_labels(spark):
    """Held-out labels of the given tables: the mix is no worse than either view."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(10)) < 4
    got = cotrain.classify(docs, labels.where(~held)).join(labels.where(held).select("doc_id", F.col("quality").alias("y")), "doc_id").toPandas()
    loss = lambda c: -np.log(np.clip(np.where(got["y"] == 1, got[c], 1 - got[c]), 1e-9, 1)).mean()
    assert len(got) > 100 and ((got["quality"] >= 0.5) == got["y"]).mean() > 0.95
    assert loss("quality") <= min(loss("quality_text"), loss("quality_meta")) + 0.01


def test_cotraining_edge_cases(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["keep"] for r in cotrain.classify(docs, none).collect()} == {True}
    one = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["keep"] for r in cotrain.classify(docs, one).collect()} == {True} and cotrain.classify(docs, one).count() == len(ROWS)
    assert cotrain.classify(empty, one).count() == 0 and cotrain.keep_good(docs, one).columns == docs.columns


def staged(spark, folder):
    """(name, input, output) of each stage over the tables in a folder."""
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(folder)).write.parquet(f"{folder}/{name}")
        yield name, now, spark.read.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")


def test_pipeline_with_awkward_rows(spark, docs, empty, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, _, out in staged(spark, tmp_path):
        assert name == "length_buckets" or (out.columns == docs.columns and extras_stay(out))
    roots = brute_components(5, 80, 100)
    kept = [k for k, (_, root) in roots.items() if k == root]
    assert sorted(r[0] or -1 for r in out.select("doc_id").distinct().collect()) == sorted(k or -1 for k in kept)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()
    (tmp_path / "none").mkdir()
    empty.write.parquet(str(tmp_path / "none/documents.parquet"))
    labels.write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def without_repeats(texts, length=100):
    """Texts in order without the characters all of whose bytes lie in strings that start earlier too."""
    seen, out = set(), []
    for t in texts:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        starts = [i for i, c in enumerate(b) if c & 0xC0 != 0x80] + [len(b)]
        out.append(b"".join(b[i:j] for i, j in zip(starts, starts[1:], strict=False) if not all(gone[i:j])).decode())
    return out


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(21)
    made, labels = labelled(spark)
    rows = [(r[0], r[1], "en", r[3], len(r[1])) for r in made.collect()]
    good = [r for r in rows if r[0] % 4 and r[0] % 5]
    passage, key = words(rng, 70), "".join(rng.choice("0123456789abcdef") for _ in range(32))
    extra = [good[0][1], good[1][1] + " end", "start " + good[2][1], f"{good[3][1]} {passage}", f"{passage} {good[4][1][:200]}", f"{words(rng, 60)} {key} {words(rng, 5)}", f"{words(rng, 60)} password: {key[:9]}", good[0][1] + " and more"]
    rows += [(1000 + i, t, "en", "src", len(t)) for i, t in enumerate(extra)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = {name: ({r["doc_id"]: r for r in a.collect()}, {r["doc_id"]: r for r in b.collect()}) for name, a, b in staged(spark, tmp_path)}
    text = lambda side: {k: r["text"] for k, r in side.items()}

    before, after = stages["quality"]
    clean = {r[0] for r in good} | set(range(1000, 1000 + len(extra)))
    assert all(after[k] == before[k] for k in after) and len(clean - set(after)) <= 3 and len(set(after) - clean) <= 0.1 * (len(rows) - len(clean))

    before, after = map(text, stages["near_duplicates"])
    sets = {k: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t.lower())] for i in range(len(w) - 4)} for k, t in before.items()}
    root = {k: k for k in before}
    for a in sorted(before):
        for b in sorted(before):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert after == {k: t for k, t in before.items() if root[k] == k} and len(before) - len(after) >= 3

    before, after = map(text, stages["repeats"])
    assert after == dict(zip(sorted(before), without_repeats([before[k] for k in sorted(before)]), strict=True)) and after != before

    before, after = map(text, stages["secret_scan"])
    hide = lambda t: re.sub(r"[0-9a-f]{24,}|password: [0-9a-f]{9}", "[SECRET]", t)
    assert after == {k: hide(t) for k, t in before.items()} and sum(after[k] != before[k] for k in after) == 2
    assert all(r["n_chars"] == len(r["text"]) for r in stages["secret_scan"][1].values())

    before, after = stages["length_buckets"]
    library = Tokenizer.from_file(wordtok.default_path())
    n = {k: len(library.encode(r["text"], add_special_tokens=False).ids) for k, r in before.items()}
    held = collections.Counter(n.values())
    tops = packing.best_boundaries(np.array(sorted(held)), np.array([held[x] for x in sorted(held)]))
    assert {k: (r["n_tokens"], r["bucket_len"], r["padding"]) for k, r in after.items()} == {k: (x, min(t for t in tops if t >= x), min(t for t in tops if t >= x) - x) for k, x in n.items()}


def test_spread_join(spark):
    many = spark.createDataFrame([(i % 50 if i % 2 else 7, i) for i in range(3000)] + [(None, -1)], "a long, v long")
    few = spark.createDataFrame([(i, i * i) for i in range(40)], "a long, w long")
    got = collections.Counter(tuple(r) for r in base.spread_join(many, few, "a").collect())
    assert got == collections.Counter(tuple(r) for r in many.join(few, "a").collect()) and len(got) > 2000
    assert base.spread_join(many, few, "a", "left").count() == 3001 and base.spread_join(many.where("v < -9"), few, "a").count() == 0


def test_folders_go_and_clusters_need_one(spark, docs):
    import types

    others = base.written()
    a, b = base.stash(docs.select("doc_id")), base.stash(docs.select("text"))
    base.clear(spark, keep=b, leave=others)
    assert b.count() == len(ROWS) and len(base.written()) == len(others) + 1
    with pytest.raises(Exception, match="(?i)path|file"):
        a.count()
    cluster = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        base.work_folder(cluster)


def rows_of_shared_ids():
    """Rows of no doc_id, and of one doc_id, with different texts: copies, repeats at the same offset, secrets."""
    rng = random.Random(11)
    base, passage = [words(rng, 80) for _ in range(5)], words(rng, 40)
    secret = "token=" + "".join(rng.choice("0123456789abcdef") for _ in range(30))
    texts = [(None, passage + base[0]), (None, passage + base[1]), (None, base[2]), (None, base[2] + " end"), (None, f"{secret} {base[3]}"), (None, base[3][:50] + f" {secret}"), (None, None)]
    texts += [(4, base[4]), (4, f"{passage} two {secret}"), (5, base[2]), (6, base[4] + " end"), (4, base[4]), (None, base[2])]
    return [(k, t, "en", f"src{i % 2}", len(t or "")) for i, (k, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def shared(spark):
    return spark.createDataFrame(rows_of_shared_ids(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select("doc_id", *columns).collect())


def test_redact_tells_rows_of_one_id_apart(shared):
    found = lambda t: t and re.sub("token=[0-9a-f]{30}", "[SECRET]", t)
    assert counted(secrets.redact(shared), "text") == collections.Counter((r[0], found(r[1])) for r in rows_of_shared_ids())


def test_suffixes_tell_rows_of_one_id_apart(spark, shared):
    once = shared.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("h", F.xxhash64("text"))
    seen, want, left = set(), {}, {}
    for k, t, _ in sorted((tuple(r) for r in once.collect()), key=lambda r: (NO_ID if r[0] is None else r[0], r[2])):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        starts = [i for i, c in enumerate(b) if c & 0xC0 != 0x80] + [len(b)]
        want[k, t] = (len(b), sum(gone), hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest())
        left[k, t] = b"".join(b[i:j] for i, j in zip(starts, starts[1:], strict=False) if not all(gone[i:j])).decode()
    rows = [(r[0], r[1] or "") for r in rows_of_shared_ids()]
    assert counted(suffixes.digest_documents(shared), "n_bytes", "n_removed", "kept_sha256") == collections.Counter((r[0], *want[r]) for r in rows)
    assert counted(suffixes.drop_repeats(shared), "text") == collections.Counter((r[0], None if raw[1] is None else left[r]) for r, raw in zip(rows, rows_of_shared_ids(), strict=True))
    assert sum(v[1] > 0 for (k, _), v in want.items() if k is None) >= 2


def test_ngram_join_tells_rows_of_one_id_apart(shared):
    size = lambda t: len({tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(len(w) - 4)})
    rows = rows_of_shared_ids()
    linked = {5: None, 6: 4}
    assert counted(ngramjoin.join_documents(shared, 5, 80, 100), "component_id") == collections.Counter((r[0], linked.get(r[0], r[0])) for r in rows)
    kept = counted(ngramjoin.keep_one(shared), "text")
    # of two near copies without a doc_id one stays, with the rows that repeat it
    pair = [(None, rows[2][1]), (None, rows[3][1])]
    assert sum(p in kept for p in pair) == 1 and all(kept[p] in (0, n) for p, n in zip(pair, (2, 1), strict=True))
    assert {k: n for k, n in kept.items() if k not in pair} == collections.Counter((r[0], r[1]) for r in rows if r[0] in (None, 4) and (r[0], r[1]) not in pair) and size(rows[2][1]) > 60


def test_cotraining_samples_rows_without_an_id_one_by_one(spark, monkeypatch):
    docs, labels = labelled(spark)
    known = labels.select("doc_id").where("doc_id IS NOT NULL")
    bare = docs.join(known, "doc_id", "left_anti").withColumn("doc_id", F.lit(None).cast("long")).select(docs.columns)
    given = {}
    train = cotrain.co_train
    monkeypatch.setattr(cotrain, "co_train", lambda rows, y, w, pool, rounds: given.update(n=len(rows), pool=len(pool)) or train(rows, y, w, pool, rounds))
    named = docs.join(known, "doc_id", "left_semi")
    cotrain.fit(named.unionByName(bare), labels, pool=20)
    assert given["pool"] == 20 and given["n"] == named.count()
    cotrain.fit(named.unionByName(bare), labels)
    assert given["pool"] == bare.select("text").distinct().count()


def test_packed_columns_come_back():
    a, b = np.array([1, 5, 2**63], np.uint64), np.array([-3, 0, 7], "<i4")
    x, y = hashing.unpack(hashing.pack(hashing.deltas(a), b))
    assert (np.cumsum(x, dtype=np.uint64) == a).all() and (y == b).all()
    data = np.frombuffer(b"abcXabc", np.uint8)
    h = hashing.span(hashing.prefix(data), np.array([0, 4, 1]), np.array([3, 7, 4]))
    assert h[0] == h[1] != h[2]


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(i) for i in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= set(names) and F is not None
