"""Katz tables: scores of texts inside and outside the corpus against brute force and the other form, and what the tables hold."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import katz, katz_tables
from tests.llm.test_llm import katz_brute, words


def sample(n):
    some = np.random.default_rng(n)
    vocab = [f"v{i}" for i in range(25)]
    return [(i, " ".join(some.choice(vocab, some.integers(0, 40), p=np.arange(25, 0, -1) / 325))) for i in range(n)] + [(100, "Zq zq zq"), (101, None), (None, ""), (6, "v1 v1"), (6, "v1 v1")]


def named(rows):
    """A null id counts as the empty text when texts are held out."""
    return [("" if i is None else i, t) for i, t in rows]


def scores(p, rows, order):
    out = Counter()
    for i, text in rows:
        t = ["<s>"] * (order - 1) + [*words(text, True), "</s>"]
        out[i, len(t) - order + 1, round(sum(np.log10(p(t[j], tuple(t[j - order + 1 : j]))) for j in range(order - 1, len(t))), 6)] += 1
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_new_texts_and_the_corpus(spark, order):
    rows = sample(50)
    clash = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, text string, w string, n int, h3 double").repartition(3)
    model = katz_tables.fit(clash, order=order)
    p, _, _ = katz_brute(named(rows), order)
    new = [(1, "v1 v2 never seen v3"), (1, "V1 V2"), (None, "v0 v0 v0 v0"), (2, None), (3, "x " * 3000)]
    for some in (rows, new):
        got = katz_tables.score_texts(katz_tables.opened(spark, model.folder), spark.createDataFrame(some, "doc_id long, text string")).collect()
        assert Counter((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in got) == scores(p, some, order)
    same = {(r["doc_id"], round(r["score"], 6)) for r in katz.score(clash, order=order).collect()}
    assert same == {(i, s) for i, _, s in scores(p, rows, order)}


def test_what_follows_a_context_sums_to_one(spark):
    rows = sample(40)
    model = katz_tables.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    p, _, _ = katz_brute(named(rows), 3)
    for context in (("v0", "v1"), ("\n", "v0"), ("v2",)):
        plan = model.following(spark, *context)
        assert "PartitionFilters: [isnotnull(part" in plan._jdf.queryExecution().executedPlan().toString()
        got = {r["w"]: r["logp"] for r in plan.collect()}
        h = tuple("<s>" if x == "\n" else x.encode() for x in context)
        for w, logp in got.items():
            word = "</s>" if w == " " else w.encode()
            if len(h) == 2:
                assert abs(10**logp - p(word, h)) < 1e-9
        assert got and sum(10**x for x in got.values()) < 1 + 1e-9
    n = model.grams(spark, 3).agg(F.sum("n")).first()[0]
    assert n == model.total == model.grams(spark, 1).agg(F.sum("n")).first()[0] == model.contexts(spark, 3).agg(F.sum("n")).first()[0]


def test_tables_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = katz_tables.fit(none)
    assert katz_tables.score_texts(model, none).count() == 0
    (r,) = katz_tables.score_texts(model, spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
    assert r["n_tokens"] == 3 and abs(r["score"] - 3 * np.log10(0.5 / 0.5)) < 1e-9
