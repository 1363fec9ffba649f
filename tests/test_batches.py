"""What a task holds is bounded by bytes, not by the rows that Spark sends at once."""

import os
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quillmill.operators import parsing
from quillmill.operators.batches import parted
from quillmill.plans import fixtures


def test_parts():
    assert list(parted([3, 4, 5, 20, 1], lambda x: x, 7)) == [[3, 4], [5, 20], [1]] and list(parted([], len)) == []


def counted(kind):
    """A ``kind`` that knows how many of its values are alive in this process."""

    class Counted(kind):
        alive = 0

        def __new__(cls, *args):
            cls.alive += 1
            return super().__new__(cls, *args)

        def __del__(self):
            type(self).alive -= 1

    return Counted


def numbered(spark, n):
    return spark.range(n).coalesce(1).withColumnRenamed("id", "doc_id")


def test_files_are_made_a_few_at_a_time(spark):
    Made = counted(bytes)
    made = fixtures._made(numbered(spark, 300), lambda i: Made(b"%d|%d|" % (i, Made.alive) + bytes(500_000)))
    got = [r[0].split("|") for r in made.select(F.decode(F.substring("content", 1, 10), "iso-8859-1")).collect()]
    assert [int(i) for i, *_ in got] == list(range(300)) and max(int(alive) for _, alive, _ in got) < 30


def test_blocks_of_small_files_leave_a_few_at_a_time(spark):
    """A file that unpacks to many times its size: its blocks count, not its bytes."""
    Text = counted(str)

    class Packed(parsing.Parser):
        mime_types = frozenset({"x/y"})
        isolated = False

        def parse(self, content):
            yield parsing.Block(0, "PARAGRAPH", Text(f"{content.decode()}|{Text.alive}|" + "x" * 500_000), None, ["a"])

    files = numbered(spark, 300).select("doc_id", F.col("doc_id").cast("string").cast("binary").alias("content"), F.lit("x/y").alias("mime_type"))
    blocks = parsing.explode_blocks(parsing.parse_documents(files, parsing.ParserRegistry([Packed()])))
    got = [(r[0], *r[1].split("|")) for r in blocks.select("doc_id", F.substring_index("text", "|", 2)).collect()]
    assert [(i, int(j)) for i, j, _ in got] == [(i, i) for i in range(300)] and max(int(alive) for *_, alive in got) < 30


def test_pdfs_are_made_a_few_at_a_time(spark, tmp_path, monkeypatch):
    Made = counted(bytes)
    spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a word").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(fixtures, "pdf_bytes", lambda words, form: Made(b"%d|%d|" % (form, Made.alive) + bytes(500_000)))
    got = [(r[0], *r[1].split("|")) for r in fixtures.pdfs(spark, str(tmp_path)).select("doc_id", F.decode(F.substring("content", 1, 10), "iso-8859-1")).collect()]
    assert sorted((i, int(form)) for i, form, *_ in got) == [(i, i % 4) for i in range(300)] and max(int(alive) for _, _, alive, _ in got) < 30


def test_chunks_of_markdown_leave_a_few_documents_at_a_time(spark):
    """Documents that all fit one batch of 32 MB: each chunk's section tells how many texts of blocks its task held."""
    from quillmill.operators import chunking

    Text = counted(str)

    class Counting(parsing.TextParser):
        def parse(self, content):
            for b in super().parse(content):
                yield parsing.Block(b.order, b.type, Text(b.text), b.page_no, [*b.heading_path, str(Text.alive)])

    files = numbered(spark, 3000).select("doc_id", F.concat(F.lit("# "), F.col("doc_id"), F.lit("\n"), F.repeat(F.lit("w "), 5000)).alias("content"), F.lit("text/markdown").alias("mime_type"))
    chunks = chunking.chunk_fixed(parsing.parse_documents(files, parsing.ParserRegistry([Counting()])), max_tokens=10_000)
    got = [(r["doc_id"], r["token_count"], *map(int, r["section_path"].split(" > "))) for r in chunks.select("doc_id", "token_count", "section_path").collect()]
    assert [g[:3] for g in got] == [(i, 5001, i) for i in range(3000)] and max(g[3] for g in got) < 1600


def test_files_of_several_types_are_made_a_few_at_a_time(spark, tmp_path, monkeypatch):
    Made = counted(bytes)
    spark.range(600).select(F.col("id").alias("doc_id"), F.lit("a word").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = lambda *_: Made(b"%d|" % Made.alive + bytes(500_000))
    monkeypatch.setattr(fixtures, "docx_bytes", made)
    monkeypatch.setattr(fixtures, "pdf_bytes", made)
    rows = fixtures.mixed_files(spark, str(tmp_path)).select("doc_id", F.decode(F.substring("content", 1, 10), "iso-8859-1")).collect()
    assert sorted(r[0] for r in rows) == list(range(600)) and max(int(r[1].split("|")[0]) for r in rows if r[0] % 6 in (2, 3)) < 30


def test_rows_that_files_are_made_of_are_no_longer_than_their_text(spark, tmp_path, monkeypatch):
    """What Spark sends to a task at once is counted in rows, so each row carries its text once, whatever its file is."""
    text = "w, " * 4000
    spark.range(120).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(fixtures, "_made", lambda rows, make: rows)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    for files in (fixtures.pdfs, fixtures.docxs, fixtures.mixed_files):
        rows, size = files(spark, str(tmp_path)).drop("mime_type").mapInArrow(sizes, "rows long, bytes long").groupBy().sum().first()
        assert rows == 120 and size < rows * (len(text) + 200)


def test_a_parser_process_holds_no_batch(spark):
    """Each block tells the memory of the child that made it and of the task's process, which holds a batch of 60 MB."""

    class Telling(parsing.Parser):
        mime_types = frozenset({"x/y"})

        def parse(self, content):
            held = (int(re.search(r"RssAnon:\s+(\d+)", open(f"/proc/{p}/status").read())[1]) >> 10 for p in (os.getpid(), os.getppid()))
            yield parsing.Block(0, "PARAGRAPH", " ".join(map(str, held)), None, [])

    files = numbered(spark, 60).select("doc_id", F.encode(F.repeat(F.lit("x"), 1_000_000), "utf-8").alias("content"), F.lit("x/y").alias("mime_type"))
    blocks = parsing.explode_blocks(parsing.parse_documents(files, parsing.ParserRegistry([Telling()]))).select("text").collect()
    assert len(blocks) == 60 and all(child < task - 40 for child, task in (map(int, b["text"].split()) for b in blocks))
