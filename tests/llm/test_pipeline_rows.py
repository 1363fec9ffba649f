"""The pipeline's stages against brute force over rows with repeated and null ids."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import mixing, toxicity

rng = np.random.default_rng(5)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(f"w{i}" for i in rng.integers(0, 5000, n))


def rows():
    a, b, c, d, shared = prose(60), prose(70), prose(80), prose(50), prose(20)
    texts = [
        (1, a), (1, a), (1, a + " " + shared), (2, shared + "  " + b), (2, shared + " " + c), (2, "own \n" + prose(15)),
        (3, a), (None, a), (None, b), (None, c + " " + shared), (None, c + " " + shared), (None, d), (4, d), (5, None), (5, None), (None, None), (None, ""), (6, "short"), (None, "short"),
        (None, shared + " " + prose(40)), (7, prose(30) + " " + shared), (7, prose(30) + " " + shared),
    ]
    return [(i, t, "en", ["x", "y", None][k % 3], None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rank(row):
    return row[0] is None, row[0] or 0


def test_near_copies(spark, docs):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in ((r[1] or "").split() for r in ROWS)]
    label = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for r, x in zip(ROWS, label):
        groups.setdefault(x, []).append(r)
    got = Counter(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, "").collect()))
    assert sum(got.values()) == len(groups)
    left = Counter(got)
    for members in groups.values():
        least = min(map(rank, members))
        some = [r for r in members if rank(r) == least and left[r]]
        assert some
        left[some[0]] -= 1


def test_repeats(spark, docs):
    first = {}
    for r in ROWS:
        w = (r[1] or "").split()
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, (True, 1)), rank(r))
    want = []
    for r in ROWS:
        w = (r[1] or "").split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < rank(r) for j in range(i, i + 13)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else r[1]
        want.append((r[0], text, *r[2:4], len(text) if gone else r[4]))
    got = corpus_pipeline.drop_repeats(spark, docs, "")
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == Counter(want) and Counter(want) != Counter(ROWS)


def test_mix(spark, docs):
    ranked = mixing.mix(docs).collect()
    words = sum(len((r["text"] or "").split()) for r in corpus_pipeline.mix(spark, docs, "").collect())
    assert words == sum(r["taken"] for r in ranked)
    sizes = Counter((r["doc_id"], r["size"], r["taken"]) for r in ranked if r["taken"])
    got = Counter()
    for r in corpus_pipeline.mix(spark, docs, "").collect():
        assert any(r["doc_id"] == x[0] and r["source"] == x[3] and (r["text"] == x[1] or (x[1] or "").split()[: len(r["text"].split())] == r["text"].split()) for x in ROWS)
        got[r["doc_id"]] += len(r["text"].split())
    want = Counter()
    for (i, _, taken), n in sizes.items():
        want[i] += taken * n
    assert got == want


def test_toxic(spark, docs, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 0, 0), (2, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, model = [], {**toxicity.new_model(), "threshold": np.zeros(1, np.float32)}

    def train(texts, toxic, weight):
        seen.extend(texts)
        return model

    monkeypatch.setattr(toxicity, "train", train)
    got = Counter(map(tuple, corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()))
    logits = toxicity.text_logits(model, pa.array([r[1] or "" for r in ROWS]))
    assert got == Counter(r for r, x in zip(ROWS, logits) if x < 0)
    held = {r["i"] for r in spark.createDataFrame([(i,) for i in (1, 2, 4)], "i long").filter(F.crc32(F.col("i").cast("string").cast("binary")) % toxicity.OF == toxicity.HELD_OUT).collect()}
    assert Counter(seen) == Counter(r[1] for r in ROWS if r[0] in {1, 2, 4} - held and r[1])


def test_encoding(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = Counter()
    for r in ROWS:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, corpus_pipeline.encode(spark, docs, "").collect())) == want


#: Names of helper columns, past and present, as a user's own.
CLASH = ["__row", "___row", "__tie", "__cut", "__id", "__toxic", "toxic", "gone", "mix_tie", "mix_row", "mix_key", "mix_took", "mix_words", "mix_copy", "removed", "is_null", "text_hash", "block", "carried", "k", "score", "size", "taken", "component_id", "n", "part", "key"]


def wide(spark, rows):
    return spark.createDataFrame([(*r, *[f"{c}{i}" for c in CLASH]) for i, r in enumerate(rows)], SCHEMA + "".join(f", {c} string" for c in CLASH))


def untrained(texts, toxic, weight):
    return {**toxicity.new_model(), "threshold": np.full(1, 100, np.float32)}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_other_columns(spark, tmp_path, monkeypatch, name):
    """Columns that are named like helpers come out as they went in, each with its row."""
    spark.createDataFrame([(1, 0, 0), (2, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "train", untrained)
    docs, step = wide(spark, ROWS), dict(corpus_pipeline.STAGES)[name]
    got = step(spark, docs, str(tmp_path))
    if name == "encoding":
        assert got.count() == len(ROWS)
        return
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows
    plain = Counter(tuple(r[:5]) for r in rows)
    assert sum(plain.values()) == sum(Counter(map(tuple, step(spark, spark.createDataFrame(ROWS, SCHEMA), str(tmp_path)).collect())).values())
    for r in rows:
        i = int(r["__row"][len("__row") :])
        assert all(r[c] == f"{c}{i}" for c in CLASH) and (r["doc_id"], r["source"]) == (ROWS[i][0], ROWS[i][3])
        assert name == "mixing" or name == "substrings" or tuple(r[:5]) == ROWS[i]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_no_rows(spark, tmp_path, monkeypatch, name):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "train", untrained)
    docs = spark.createDataFrame([], SCHEMA)
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert got.count() == 0 and (name == "encoding" or got.columns == docs.columns)


def test_pipeline_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_largest_id_is_not_null(spark):
    """It is a component of its own, and one with a text like that of a row without an id."""
    from quillmill.llm import jaccard

    last, text, other = (1 << 63) - 1, prose(30), prose(30)
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df([(last, text), (None, other), (3, "x y"), (0, "a")])).collect()}
    assert got == {last: last, None: None, 3: 3, 0: 0}
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df([(last, text), (None, text)])).collect()}
    assert got == {last: last, None: last}
