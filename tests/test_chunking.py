import hashlib

import pytest
from pyspark.sql import functions as F

from quillmill.operators import chunking
from quillmill.operators.parsing import BLOCK


def parsed(spark, *blocks):
    rows = [(1, [(i, "PARAGRAPH", t, None, p) for i, (t, p) in enumerate(blocks)])]
    return spark.createDataFrame(rows, f"doc_id long, blocks array<{BLOCK}>")


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def test_fixed(spark):
    df = parsed(spark, (words(25), ["A", "B"]), ("tail", ["C"]))
    got = chunking.chunk_fixed(df, max_tokens=10).orderBy("chunk_no").collect()
    assert [r["token_count"] for r in got] == [10, 10, 6] and all(r["section_path"] == "A > B" for r in got)
    assert got[0]["content"].startswith("[A > B]\nw0") and got[0]["content_hash"] == hashlib.sha256(got[0]["content"].encode()).hexdigest()
    assert chunking.chunk_fixed(parsed(spark)).count() == 0 and chunking.chunk_fixed(parsed(spark, ("", []))).count() == 0


def test_paragraphs(spark):
    df = parsed(spark, (words(3), ["A"]), ("", []), (words(25), []))
    got = chunking.chunk_paragraph(df, max_tokens=10).orderBy("chunk_no").collect()
    assert [r["token_count"] for r in got] == [3, 0, 10, 10, 5] and got[0]["content"] == "[A]\n" + words(3) and got[1]["content"] == ""
    over = chunking.chunk_paragraph_overlap(df, max_tokens=10, overlap=3).filter("chunk_no > 1").orderBy("chunk_no").collect()
    assert [r["token_count"] for r in over] == [10, 10, 10, 4]
    assert over[0]["content"].split()[-3:] == over[1]["content"].split()[:3]
    with pytest.raises(ValueError):
        chunking.chunk_paragraph_overlap(df, max_tokens=5, overlap=5)


def test_bpe_round_trip(spark):
    import public_tokenizers

    text = "plain words and 한국어 글자들 again"
    got = chunking.chunk_fixed(parsed(spark, (text, [])), max_tokens=1000, tokenizer=public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect()
    assert len(got) == 1 and got[0]["content"] == text


@pytest.mark.parametrize("counts,limits,code", [([], (3, 1000), "EMPTY_EXTRACTION"), ([1] * 4, (3, 1000), "CHUNK_LIMIT_EXCEEDED"), ([10] * 3, (3, 30), None), ([10] * 3, (3, 25), "TOTAL_TOKEN_LIMIT_EXCEEDED"), ([0] * 3, (3, 5), None)])
def test_guard(spark, counts, limits, code):
    rows = [(1, [(i, "PARAGRAPH", " ".join(["w"] * c), None, []) for i, c in enumerate(counts)])]
    parsed = spark.createDataFrame(rows, "doc_id long, blocks array<struct<order:int,type:string,text:string,page_no:int,heading_path:array<string>>>")
    got = chunking.guard_chunks(parsed, "PARAGRAPH", max_chunks=limits[0], max_total_tokens=limits[1]).first()
    assert (got["n_chunks"], got["total_tokens"], got["error_code"]) == (len(counts), sum(counts), code)
    assert chunking.chunk_fixed(parsed).count() == chunking.guard_chunks(parsed).first()["n_chunks"]


def test_bpe_ids_are_the_librarys(spark):
    """Ids of all test texts equal those of the library read from the same rank file."""
    import base64

    import public_tokenizers
    import tiktoken

    from quillmill.operators.tokenizers import PATTERN, bpe_ids

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb") if x.strip())}
    coder = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "plain words, don't", "日本語 ñandú", "<|endoftext|>", "\u0000\n\t  x", "a" * 3000, None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", bpe_ids(F.col("t"), path).alias("ids")).orderBy("i").collect()
    assert [r["ids"] for r in got] == [None if t is None else coder.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("overlap", [0, 8])
def test_time_grows_with_a_blocks_tokens(spark, overlap):
    """Twice the tokens of one block take about twice the time, not four times."""
    import time

    took = []
    for n in (20_000, 40_000):
        df = spark.createDataFrame([(i, [(0, "PARAGRAPH", words(n), None, [])]) for i in range(4)], f"doc_id long, blocks array<{BLOCK}>").coalesce(1).cache()
        df.count()
        best = []
        for _ in range(3):
            began = time.perf_counter()
            chunking.chunk_paragraph_overlap(df, max_tokens=64, overlap=overlap).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        took.append(min(best))
        df.unpersist()
    assert took[1] < 2.5 * took[0] + 0.3, took
