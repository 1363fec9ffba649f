"""Operators against brute force on small tables with nulls, empty texts, repeats and clashing columns."""

import functools
import hashlib
import os
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmill.llm import _shared as shared
from quillmill.llm import exchange, fingerprints, jaccard, katz, licenses, media, mixing, substrings, toxicity, trie_bpe, wavelet
from quillmill.llm._shared import word_hashes
from quillmill.llm.components import components

SCHEMA = "doc_id long, text string, source string, size int, row int, hash int, block int, score int"
rng = np.random.default_rng(1)
VOCAB = [f"w{i}" for i in range(200)] + ["é", "The", "don't", "x.y,", "日本語", "<|endoftext|>", "A.", " q"]


def sample():
    texts = [" ".join(rng.choice(VOCAB, n)) for n in (0, 1, 3, 5, 40, 40, 80, 300, 2000)]
    base = texts[7].split()
    near = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in (3, 150, 290)]
    texts += [*near, texts[7], texts[7].upper(), texts[6] + " " + " ".join(base[20:60]), None, "", " \t\n", "released under the MIT License. mit  license"]
    return [(i, t, [None, "a", "b", "c"][i % 4], 0, 0, 0, 0, 0) for i, t in enumerate(texts)]


ROWS = sample()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower() if lower else (text or "").encode())


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_word_hashes_agree_with_words():
    texts = pa.array([r[1] for r in ROWS])
    h, first = word_hashes(texts, lower=True)
    seen = {}
    for i, r in enumerate(ROWS):
        w = words(r[1], True)
        assert first[i + 1] - first[i] == len(w)
        for x, y in zip(w, h[first[i] : first[i + 1]]):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_fingerprints(docs, empty):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_neighbours(docs).collect()}
    for i, r in enumerate(ROWS):
        text, after = r[1] or "", ROWS[(i + 1) % len(ROWS)][1] or ""
        n = len(text) // 4
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()
    assert got[7]["fingerprint"] == got[12]["fingerprint"] and got[9]["near_next"] > 0.8 and 0.4 < got[8]["near_edited"] < 0.8
    assert fingerprints.fingerprint_neighbours(empty).count() == 0


def brute_anchors(text):
    """{position: hash} of the closed syncmers of a text, straight from the definition."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        return signed(seed)

    units = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        for part in re.findall(r"[\u3040-\u30ff\u4e00-\u9fff]|[^\u3040-\u30ff\u4e00-\u9fff]+", w):
            units += [part] if len(part) <= 16 else list(part)
    if not units:
        return {0: xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFFFF} if text else {}
    h = [0] * 4 + [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in units] + [0] * 4
    m = [chain(*h[i : i + 2]) for i in range(len(h) - 1)]
    out = {}
    for i in range(len(h) - 4):
        if min(m[i : i + 4]) in (m[i], m[i + 3]):
            out[i - 4] = chain(m[i], m[i + 2], m[i + 3]) & 0xFFFFFFFF
    return out


def test_fingerprints_against_brute_force(spark):
    """Fingerprints and all four likenesses of texts short and long, with repeated and null ids."""
    some = np.random.default_rng(8)
    texts = ["", "a", "one two", " \t", "日本語の文章です 本", "x" * 40 + " y", "one two three four five six seven eight nine ten", *(" ".join(some.choice(VOCAB, n)) for n in (9, 10, 11, 60, 400)), None]
    texts += ["same line\n" * 30, texts[10] + " more", "a"]
    rows = [(None if i % 7 == 6 else i // 2, t) for i, t in enumerate(texts)]
    got = fingerprints.fingerprint_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, e, n = (brute_anchors(x) for x in (t, edited, after))
        sets = [set(x.values()) for x in (a, e, n)]
        placed = [set(x.items()) for x in (a, e, n)]
        text = ["".join(f"{x:08x}" for x in sorted(s)) for s in sets[:2]]
        want.append((i, len(t), *text, like(sets[0], sets[1]), like(sets[0], sets[2]), like(placed[0], placed[1]), like(placed[0], placed[2])))
    columns = ["doc_id", "n_chars", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "placed_edited", "placed_next"]
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(want)


def test_passages_by_position(spark):
    some = np.random.default_rng(9)
    word = lambda n: [f"v{x}" for x in some.integers(0, 10**6, n)]
    shared, own = word(80), word(50)
    left, right = [*own, *shared], [*word(7), *shared[:40], "changed", *shared[40:], *word(9)]
    rows = [(1, " ".join(left), " ".join(right)), (2, " ".join(own), " ".join(word(50))), (3, None, "a"), (4, "", "")]
    got = fingerprints.passages(spark.createDataFrame(rows, "id long, x string, y string"), "x", "y", key="id").orderBy("begin").collect()
    assert [(r["id"], r["shift"]) for r in got] == [(1, -43), (1, -42)]
    assert 50 <= got[0]["begin"] < 60 and 80 <= got[0]["end"] <= 90 and 90 <= got[1]["begin"] < 100 and got[1]["end"] <= 130


def test_fingerprints_of_short_texts(spark):
    """No switch of units between 9 and 10 words, and no text but the empty one without anchors."""
    ten = "one two three four five six seven eight nine ten"
    texts = [ten, ten[:-4], "This.", "Avec.", "hello", "world", "12345", " ", "", "日本語の文章です", "日本語の文章でも"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_neighbours(df).collect()}
    assert got[0]["near_next"] > 0.3 and 0 < got[9]["near_next"] < 1
    assert all((got[i]["n_anchors"] > 0) == (x != "") for i, x in enumerate(texts))
    assert all(got[i]["near_next"] == 0 for i in range(2, 8)) and len({got[i]["fingerprint"] for i in range(2, 9)}) == 7


def test_fingerprints_hold_all_anchors(spark):
    """A changed passage of 60 words in 20,000 shows, and likeness is the Jaccard index of all anchors."""
    long = [f"v{i}" for i in rng.integers(0, 10**6, 20_000)]
    texts = [" ".join(long), " ".join([*long[:9000], *(f"x{i}" for i in range(60)), *long[9060:]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_neighbours(df).collect()}
    a, b = ({x["fingerprint"][i : i + 8] for i in range(0, len(x["fingerprint"]), 8)} for x in (got[0], got[1]))
    assert len(a) > 5000 and a != b and got[0]["near_next"] == len(a & b) / len(a | b) < 1


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10, 50])
def test_ranges_of_ids(spark, n):
    bounds = [3 * i - 7 for i in range(n)]
    got = spark.range(-7, 3 * n + 5).select("id", fingerprints._range_of(F.col("id"), bounds).alias("part")).collect()
    assert all(r["part"] == sum(b <= r["id"] for b in bounds) - 1 for r in got)


def test_wavelet_and_bpe(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    ids = [tok.encode(r[1] or "", add_special_tokens=False).ids for r in ROWS]
    got = sorted(trie_bpe.encode_decode(docs, tokenizer()).collect())
    raw = [np.array(x, "<u4").tobytes() for x in ids]
    assert [tuple(r) for r in got] == [(i, len(x), hashlib.sha256(raw[i]).hexdigest(), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in enumerate(ids)]
    got, start = sorted(wavelet.read_shards(wavelet.write_shards(docs, tokenizer())).collect()), 0
    for r, x in zip(got, ids):
        assert tuple(r)[1:] == (start, len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes()))
        start += len(x) + 1
    assert wavelet.read_shards(wavelet.write_shards(empty, tokenizer())).count() == 0 and trie_bpe.encode_decode(empty, tokenizer()).count() == 0


def test_joined_pieces_encode_as_if_alone():
    from tokenizers import Tokenizer

    from quillmill.llm import tokens

    tok, coder = Tokenizer.from_file(tokenizer()), tokens.library_encoder(tokenizer())
    some = ["plain", "<", "|>", "\u0301e", "e\u0301", "a\u00a0b", "\u2003", "'s", "ΟΔΟΣ", "日本", "\U0001f600", "x" * 5000, "İx", "ñandú", "ßß", "ŉa", "ªº", "aǅ", "ĳ", "é", "don't", "A", "ÀÉ", *[f"q{i}" for i in range(3 * tokens.JOINED)]]
    for names in (some, [*some, "a<|endoftext|>b", "<|x"]):
        coder.forget()
        assert coder.lookup(names) == [np.array(tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in names]


def test_capitals_compose_before_they_are_folded(spark):
    from tokenizers import Tokenizer

    from quillmill.llm import tokens

    tok = Tokenizer.from_file(tokenizer())
    pairs = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]
    texts = [p + "abc" for p in pairs] + ["A" + p + " plain. " + p + "." for p in pairs] + ["AJ", "\u030cX", "J\u0323\u030c", *(chr(c) + chr(m) for c in range(65, 91) for m in range(0x300, 0x340))]
    ids = [tok.encode(x, add_special_tokens=False).ids for x in texts]
    raw = [np.array(x, "<u4").tobytes() for x in ids]
    got, first = tokens.library_encoder(tokenizer()).encode(pa.array(texts))
    assert [got[a:b].tolist() for a, b in zip(first, first[1:])] == ids
    some = spark.createDataFrame(list(enumerate(texts[:12])), "doc_id long, text string")
    got = sorted(trie_bpe.encode_decode(some, tokenizer()).collect())
    assert [(r["n_tokens"], r["ids_sha256"]) for r in got] == [(len(x), hashlib.sha256(y).hexdigest()) for x, y in zip(ids, raw[:12])]
    got = sorted(wavelet.read_shards(wavelet.write_shards(some, tokenizer())).collect())
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array([*x, 1], "<u4").tobytes()) for x in ids[:12]]


@pytest.mark.parametrize("n, most", [(0, 1), (1, 1), (1, 70_000), (511, 2), (512, 50), (513, 50), (3000, 50), (5000, 70_000)])
def test_wavelet_queries(n, most):
    """Access, rank, count and select of every place and token against the ids themselves."""
    ids = rng.integers(0, most, n).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.build(ids, [1, None], np.array([n // 2, n - n // 2])))
    assert (m.tokens() == ids).all() and m.doc_ids == [1, None] and m.lengths.tolist() == [n // 2, n - n // 2]
    assert (m.access(np.arange(n)) == ids).all() and all(m.access(i) == ids[i] for i in range(0, n, 97))
    for token in {*ids[:20].tolist(), 0, 7, 99_999}:
        places = np.flatnonzero(ids == token)
        assert (m.rank(token, np.arange(n + 1)) == np.concatenate([[0], np.cumsum(ids == token)])).all() and m.count(token) == len(places)
        assert all(m.select(token, k) == p for k, p in list(enumerate(places))[:: max(1, len(places) // 20)])
        with pytest.raises(IndexError):
            m.select(token, len(places))


def test_wavelet_repeated_and_null_ids(spark, monkeypatch):
    """Rows of one id, or without, are spread over shards; starts add up, and a damaged file raises."""
    monkeypatch.setattr(wavelet, "SHARD_BYTES", 400)
    rows = [(i, f"text number {j} of many, repeated") for j, i in enumerate([7] * 40 + [None] * 40 + [1, 2, 3])] + [(4, "x" * 5000)]
    manifest = wavelet.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer())
    assert manifest.count() > 4 and manifest.agg(F.sum("n_docs")).first()[0] == len(rows) and manifest.agg(F.max("n_docs")).first()[0] < 40
    got = sorted(wavelet.read_shards(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows if i is not None)) + [None] * 40
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    with pytest.raises(Exception, match="end id"):
        wavelet.read_shards(manifest, end_id=2).collect()


def test_katz(docs, empty):
    got = {r["doc_id"]: r for r in katz.score(docs).collect()}
    train = [b for r in ROWS if zlib.crc32(str(r[0]).encode()) % 5 != 1 for b in [*words(r[1], True), None]]
    for r in ROWS:
        w = [*words(r[1], True), None]
        assert got[r[0]]["n_tokens"] == len(w) and got[r[0]]["n_known"] == sum(x in train for x in w) and got[r[0]]["train_tokens"] == len(train)
        z = len(train) + 0.5 * (len(set(train)) + 1)
        assert abs(got[r[0]]["base_score"] - sum(np.log10((train.count(x) + 0.5) / z) for x in w)) < 1e-6
    assert katz.score(empty).count() == 0


def thue_morse(n):
    """Two words that collide under every polynomial hash modulo a power of two."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_constructed_words_do_not_collide(spark):
    x, y = thue_morse(1024)
    for key in (shared.FIXED_KEY, shared.new_key()):
        assert len(set(word_hashes(pa.array([f"{x} {y} {'q' * 200_000} {'q' * 200_001}"]), False, key)[0])) == 4
    rest = [f"r{i}" for i in range(30)]
    texts = [" ".join([w if i % 3 == 0 else r for i, r in enumerate(rest)]) for w in (x, y)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["component_id"] for r in sorted(jaccard.jaccard_components(df).collect())] == [0, 1]
    assert [r["n_removed"] for r in substrings.remove_repeats(df).collect()] == [0, 0]
    assert {r["doc_id"]: r["n_known"] for r in katz.score(df).collect()}[1] == len(rest) + 1


@pytest.mark.parametrize("operator", [substrings.remove_repeats, katz.score])
def test_lost_answers_raise(docs, operator):
    """A deleted answer file, or all of them, is an error and not an answer."""
    before = set(shared._TEMPORARY)
    lazy = operator(docs)
    (folder,) = (p.removeprefix("file://") for p in shared._TEMPORARY - before if "-stats" not in p and ("repeats-" in p or "grams-3" in p))
    assert os.listdir(folder)
    for name in os.listdir(folder):
        os.remove(f"{folder}/{name}")
    with pytest.raises(Exception, match="FileNotFoundError|No such file"):
        lazy.collect()


def test_delivered_checks_its_buckets(tmp_path):
    path = f"{tmp_path}/{7:016x}"
    exchange.write_file(path, struct.pack("<iQ", 3, 2) + b"ab")
    assert exchange.delivered(str(tmp_path), 7, [3]) == {3: b"ab"} and exchange.delivered(str(tmp_path), 8, []) == {}
    with pytest.raises(RuntimeError):
        exchange.delivered(str(tmp_path), 7, [3, 4])


def katz_brute(rows, order):
    """Dictionaries of counts and plain recursion; gives a scorer, the vocabulary and the contexts."""
    train = [[*words(r[1], True), "</s>"] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    flat = [w for t in train for w in t]
    one = Counter(flat)
    z = len(flat) + 0.5 * (len(one) + 1)
    counts = {k: Counter(tuple((["<s>"] * (k - 1) + t)[i : i + k]) for t in train for i in range(len(t))) for k in range(2, order + 1)}
    d = {k: katz.discounts([sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]) for k, c in counts.items()}
    after = {}
    for c in counts.values():
        for gram, n in c.items():
            after.setdefault(gram[:-1], {})[gram[-1]] = n

    @functools.cache
    def parts(h):
        follow, dd = after[h], d[len(h) + 1]
        total = sum(follow.values())
        below = total + all(r > katz.K for r in follow.values())
        seen = {w: (dd[r - 1] if r <= katz.K else 1) * r / below for w, r in follow.items()}
        return seen, (1 - sum(seen.values())) / (1 - sum(p(w, h[1:]) for w in seen))

    def p(w, h):
        if not h:
            return (one[w] + 0.5) / z
        if h not in after:
            return p(w, h[1:])
        seen, alpha = parts(h)
        return seen[w] if w in seen else alpha * p(w, h[1:])

    return p, one, list(after)


@pytest.mark.parametrize("order, hot", [(2, 4096), (3, 4096), (3, 1)])
def test_katz_scores(spark, monkeypatch, order, hot):
    """Every score equals the brute force, whether contexts are dealt by gram or not, and every context sums to 1."""
    some = np.random.default_rng(order)
    vocab = [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(some.choice(vocab, some.integers(0, 60), p=np.arange(30, 0, -1) / 465))) for i in range(60)] + [(100, "Zq zq zq"), (101, None), (6, "v1 v1")]
    p, one, contexts = katz_brute(rows, order)
    for h in contexts:
        assert abs(sum(p(w, h) for w in one) + p("never met", h) - 1) < 1e-9
    if hot == 1:
        monkeypatch.setattr(katz, "HOT", 10**9)
        monkeypatch.setattr(katz, "LEAST_HOT", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], round(r["score"], 7)) for r in katz.score(df, order=order).collect())
    want = Counter()
    for i, text in rows:
        t = ["<s>"] * (order - 1) + [*words(text, True), "</s>"]
        want[i, round(sum(np.log10(p(t[j], tuple(t[j - order + 1 : j]))) for j in range(order - 1, len(t))), 7)] += 1
    assert got == want


def brute_components(rows):
    sets = {}
    for r in rows:
        w = words(r[1], True)
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def brute_links(rows):
    """Of each row, the other rows whose texts link with its text."""
    sets = []
    for r in rows:
        w = words(r[1], True)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    linked = lambda a, b: a and 100 * len(a & b) >= 75 * len(a | b)
    return Counter((r[0], sum(bool(linked(a, b)) for j, b in enumerate(sets) if j != i)) for i, (r, a) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("tile", [2000, 3])
def test_jaccard_links(spark, empty, monkeypatch, tile):
    """Links of every row, over groups of many sizes, with copies, repeated and null ids; tiles of three sets meet across bands."""
    monkeypatch.setattr(jaccard, "TILE_SETS", tile)
    some = np.random.default_rng(6)
    texts = ["", None, "one two", "one  TWO", " \t"]
    for n in (12, 40, 90):
        base = [f"u{x}" for x in some.integers(0, 10**6, n)]
        for _ in range(14):  # changed and cut short, so that sizes of one group lie in several bands
            own = base[: some.integers(n // 2, n + 1)]
            for i in some.integers(0, len(own), some.integers(0, 2)):
                own[i] = "changed"
            texts += [" ".join(own)] * some.integers(1, 3)
    rows = [(None if i % 11 == 4 else int(some.integers(0, 60)) if i % 3 else 100 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.jaccard_components(df, links=True).collect()
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == brute_links(rows)
    assert len({r["n_links"] for r in got}) > 5
    # Two texts under one id that no other document shares words with.
    pair = " ".join(VOCAB[:40])
    only = spark.createDataFrame([(1, pair), (1, pair + " tail"), (2, "other words")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_links"]) for r in jaccard.jaccard_components(only, links=True).collect()) == [(1, 1), (1, 1), (2, 0)]
    assert jaccard.jaccard_components(empty, links=True).count() == 0


@pytest.mark.parametrize("tile", [2000, 2])
def test_jaccard(docs, empty, monkeypatch, tile):
    """With tiles of two sets every group is dealt out, met again and compared tile by tile."""
    monkeypatch.setattr(jaccard, "TILE_SETS", tile)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute_components(ROWS)
    if tile == 2000:
        assert jaccard.jaccard_components(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 40), (40, 31)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 40: 30}


def test_substrings(docs, empty):
    got = {r["doc_id"]: r for r in substrings.remove_repeats(docs, texts_out=True).collect()}
    first = {}
    for r in ROWS:
        w = words(r[1])
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), r[0])
    for r in ROWS:
        w = words(r[1])
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < r[0] for j in range(i, i + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[r[0]]["n_words"], got[r[0]]["n_removed"], got[r[0]]["kept"].encode()) == (len(w), len(gone), kept)
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("window", [1, 3, 13])
def test_maximal_repeats(spark, window):
    """Spans of maximal repeats against brute force, over several blocks' worth of groups, for shallow and deep trees."""
    some = np.random.default_rng(window)
    vocab = ["a", "ab", "b", "\x01", "é", "x" * 300, *(f"w{i}" for i in range(40))]
    passages = [list(some.choice(vocab, 40)) for _ in range(4)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(some.integers(0, 4)):
            w += [*some.choice(vocab, some.integers(0, 20)), *passages[some.integers(4)][some.integers(0, 20) :]]
        rows.append((int(some.integers(0, 30)) if i % 9 else None, "  ".join(w)))
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, text in rows:
        w = words(text)
        for j in range(len(w) - window + 1):
            first[tuple(w[j : j + window])] = min(first.get(tuple(w[j : j + window]), (True, 1)), key(i))
    want = []
    for i, text in rows:
        w, spans = words(text), []
        for j in sorted({j + k for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < key(i) for k in range(window)}):
            if spans and spans[-1][0] + spans[-1][1] == j:
                spans[-1][1] += 1
            else:
                spans.append([j, 1])
        want.append((i, text, tuple(map(tuple, spans))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.remove_repeats(df, window=window, spans_out=True, texts_out=True).collect()
    assert Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["repeats"]))) for r in got) == Counter((i, len(words(t)), s) for i, t, s in want)
    assert any(s for _, _, s in want)


def test_subtree_parts():
    """Separators are prefixes of whole words in order, and groups take every suffix once, equal ones together."""
    some = np.random.default_rng(3)
    suffixes = sorted(b" ".join(some.choice([b"a", b"b", b"c", b"\x02"], 4)) for _ in range(500))
    cuts = substrings.separators(suffixes, 40)
    assert cuts == sorted(set(cuts)) and len({c.count(b" ") for c in cuts}) > 1
    assert [x for _, a, b in substrings.group_of(suffixes, cuts) for x in suffixes[a:b]] == suffixes
    assert substrings.group_of(suffixes[:5], cuts) == [(i, a, b) for i, a, b in substrings.group_of(suffixes[:5], cuts) if b > a]
    of = {x: g for g, a, b in substrings.group_of(suffixes, cuts) for x in suffixes[a:b]}
    assert all(of[x] == g for g, a, b in substrings.group_of(suffixes[::7], cuts) for x in suffixes[::7][a:b])
    parts = [(suffixes[i::3], some.integers(0, 99, len(suffixes[i::3])).astype(np.uint64)) for i in range(3)]
    least = {}
    for names, owners in parts:
        for x, o in zip(names, owners):
            least[x] = min(least.get(x, 10**9), o)
    assert [list(t) for t in substrings.deep_nodes(parts)] == [[least[x] for x in names] for names, _ in parts]


def test_licenses(docs, empty):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    last = got[len(ROWS) - 1]
    assert (last["n_base"], last["first_word"], last["last_word"], last["base_labels"], last["labels"]) == (2, 3, 5, "mit", "mit,mit-notice")
    for r in ROWS:
        n = len(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").encode().lower()))
        assert got[r[0]]["n_words"] == n
    assert got[0]["score"] == 0 and got[0]["first_word"] is None and licenses.scan_licenses(empty).count() == 0


def test_licenses_whole_texts(spark):
    """A whole licence with words put in and left out is one span; a chain of diagonals without end doesn't hide one."""
    full = dict((label, text.split()) for text, label in licenses.NOTICES)
    mit = full["mit-full"]
    changed = [*mit[:30], "new", "words", *mit[30:90], *mit[92:]]
    noise = ("is hereby granted " * 300).split()
    rows = [(1, " ".join(mit)), (2, "(c) " + " ".join(changed).title() + "."), (3, " ".join([*noise, *full["mit-text"], *noise])), (4, " ".join(full["bsd-full"][:40])), (5, None)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"], s["cover"]) for s in got[1]["spans"] if s["label"] == "mit-full"] == [(0, len(mit), 1.0)]
    (span,) = [s for s in got[2]["spans"] if s["label"] == "mit-full"]
    assert (span["start"], span["end"]) == (1, 1 + len(changed)) and 0.9 < span["cover"] < 1
    assert any(s["label"] == "mit-text" and s["cover"] == 1 and s["start"] <= len(noise) < s["end"] for s in got[3]["spans"])
    assert "bsd-text" in got[4]["labels"] and "bsd-full" not in got[4]["labels"] and 0.2 < got[4]["score"] <= 1 and got[5]["n_words"] == 0


@pytest.mark.parametrize("name", ["op5_jaccard", "op6_licenses", "op8_substrings", "op10_mixing"])
def test_queries_equal_their_sql(spark, tmp_path, name):
    """On a small table with copies, near copies, shared passages, licence texts, an empty and a null text."""
    import duckdb

    from quillmill.llm import queries

    some = np.random.default_rng(4)
    texts = [" ".join(some.choice(VOCAB, some.integers(0, 120))) for _ in range(40)] + [None, ""]
    texts += [texts[3], texts[4] + " tail", " ".join([*texts[5].split(), *texts[6].split()[:30]]), "The MIT License; Apache License. GENERAL public license", " ".join(t for t, _ in licenses.NOTICES), licenses.NOTICES[1][0].upper()]
    rows = [(i, t, "en", ["a", "b", "c"][i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(columns)
    rounded = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    assert sorted(map(repr, map(rounded, got.select(columns).collect()))) == sorted(map(repr, map(rounded, want.fetchall())))


def test_licenses_kelvin_sign_is_not_k(spark):
    df = spark.createDataFrame([(1, "the mit licenſe"), (2, "MIT LICENSE")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_base"] for r in licenses.scan_licenses(df).collect()} == {1: 0, 2: 1}


def test_media(docs, empty, spark):
    folder = media.write_archives(docs)
    got = {r["doc_id"]: r for r in media.describe(media.read_archives(spark, folder, rangeBytes=300)).collect()}
    for r in ROWS:
        data = (r[1] or "").encode()
        pay = media.payload_of(data)
        assert len(pay) % 192 == 0 and len(pay) >= 192 and media.from_png(media.to_png(pay)) == pay
        assert got[r[0]]["n_bytes"] == len(data) and got[r[0]]["payload_sha256"] == hashlib.sha256(pay).hexdigest() and got[r[0]]["tail_crc32"] == zlib.crc32(pay[-16:])
    assert len(got) == len(ROWS) and media.read_archives(spark, media.write_archives(empty)).count() == 0


def test_media_against_brute_force(docs, spark):
    """Every column from the definition; members are read again by offset when the first read fails, and damage raises."""
    import math
    import statistics

    folder = media.write_archives(docs)
    got = {r["doc_id"]: r for r in media.describe(media.read_archives(spark, folder)).collect()}
    for r in ROWS:
        pay = media.payload_of((r[1] or "").encode())
        png = media.to_png(pay)
        x = list(pay)
        share = [x.count(v) / len(x) for v in set(x)]
        width = 3 * (len(x) // 192)
        cells = [sum(x[i : i + width]) for i in range(0, len(x), width)][:64]
        bits = int("".join("1" if c > sum(cells) / len(cells) else "0" for c in cells), 2)
        values = dict(mean=sum(x) / len(x), std=statistics.pstdev(x), step=sum(abs(a - b) for a, b in zip(x, x[1:])) / (len(x) - 1), entropy=-sum(s * math.log2(s) for s in share))
        told = dict(y.split("=") for y in got[r[0]]["feature"].split(";"))
        assert all(abs(float(told[k]) - v) < 1e-3 for k, v in values.items()) and told["hash"] == f"{bits:016x}"
        assert got[r[0]]["media_bytes"] == len(png) and got[r[0]]["media_sha256"] == hashlib.sha256(png).hexdigest() and got[r[0]]["payload_bytes"] == len(pay)
    reader = media.MediaArchiveReader({"path": folder, "attempts": "3"})
    (part, *_) = reader.partitions()
    (first, *_) = [row for batch in reader.read(part) for row in batch.to_pylist()]
    assert reader._member(part, first["offset"])[3] == first["media"]
    reader._first = lambda src, offset: None  # every member's first read fails
    assert [row for batch in reader.read(part) for row in batch.to_pylist()][0] == first
    name = part.path.removeprefix("file://")
    data = bytearray(open(name, "rb").read())
    data[first["offset"] + media.HEAD_BYTES + 3] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(OSError, match="damaged"):
        list(reader.read(part))


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(ROWS[r["doc_id"]][2], []).append(r)
    for rows in by.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1 and rows[0]["target"] <= 2 * rows[0]["source_size"]
    assert abs(sum(r[0]["target"] for r in by.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    taken = {r["doc_id"]: r["taken"] for r in got}
    real = {}
    for r in mixing.mixed_documents(docs).collect():
        real[r["doc_id"]] = real.get(r["doc_id"], 0) + len(words(r["text"]))
    assert real == {k: v for k, v in taken.items() if v} and mixing.mix(empty).count() == 0


def test_toxicity_fit_and_held_out(spark):
    """The query over the driver's tables: the split by id, and what it finds among held-out labels."""
    import duckdb

    from quillmill.llm import queries

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    toxic = dict(duckdb.sql(f"select doc_id, toxic from '{folder}/labels.parquet'").fetchall())
    got = queries.op4_toxicity(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    bad, clean = [p for p, y in held if y == 1], [p for p, y in held if y == 0]
    assert len(bad) > 50 and np.mean(bad) >= 0.85 and np.mean(clean) <= 0.05


def test_toxicity_of_empty_tables(spark, empty):
    """Without labels or texts every text counts as clean, and no text gives no row."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(empty, labels)
    some = spark.createDataFrame([(1, "a text"), (None, None), (1, "")], "doc_id long, text string")
    assert [r["score"] < 0.5 for r in toxicity.score(some, model).collect()] == [True] * 3
    assert toxicity.score(empty.drop("score"), model).count() == 0


def test_toxicity_learns_and_gradients(docs, spark):
    m = toxicity.new_model()
    x, mask = rng.normal(size=(2, 3, 6, 24)).astype(np.float32), np.ones((3, 6), bool)
    mask[1, 4:] = False
    x[0][~mask] = 0
    x[1][~mask[:, ::-1]] = 0
    logit, saved = toxicity.forward(m, x, mask, keep=True)
    grads, _ = toxicity.backward(m, saved, mask, np.ones(3, np.float32))
    for name in ("uh", "un", "wa", "va", "wo"):
        flat = m[name].reshape(-1)
        was, step = flat[0], 1e-2
        flat[0] = was + step
        up = toxicity.forward(m, x, mask).sum()
        flat[0] = was - step
        down = toxicity.forward(m, x, mask).sum()
        flat[0] = was
        assert abs((up - down) / (2 * step) - grads[name].reshape(-1)[0]) < 2e-2
    texts = [" ".join(rng.choice(VOCAB[:200], 50)) for _ in range(240)]
    toxic = np.arange(240) % 3 == 0
    texts = [t + " vile brute" if y else t for t, y in zip(texts, toxic)]
    model = toxicity.train(texts, toxic)
    fresh = [" ".join(rng.choice(VOCAB[:200], 60)) for _ in range(40)]
    high = toxicity.text_logits(model, pa.array([f + " brute " + f for f in fresh]))
    low = toxicity.text_logits(model, pa.array(fresh))
    assert (high > 0).mean() > 0.9 and (low < 0).mean() > 0.9
    got = toxicity.score(docs.drop("score"), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
