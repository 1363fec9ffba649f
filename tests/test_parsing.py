import io
import zipfile
import zlib

import pytest

from quillmill.operators import parsing

from quillmill.operators.parsing import DocxParser, HwpParser, ParserRegistry, PdfParser, TextParser, page_blocks, parse_documents


def blocks(text):
    return [(b.order, b.type, b.text, b.heading_path) for b in TextParser().parse(text.encode())]


def test_headings_and_paths():
    assert blocks("# A\none\ntwo\n\n## B\n three \n# C\nfour") == [
        (0, "HEADING", "A", ["A"]), (1, "PARAGRAPH", "one two", ["A"]), (2, "HEADING", "B", ["A", "B"]),
        (3, "PARAGRAPH", "three", ["A", "B"]), (4, "HEADING", "C", ["C"]), (5, "PARAGRAPH", "four", ["C"]),
    ]


def test_text_edges():
    assert blocks("") == [] and blocks("# only") == [(0, "HEADING", "only", ["only"])]
    assert [b[1] for b in blocks("#\n\n####### x")] == ["PARAGRAPH", "PARAGRAPH"]
    assert blocks("﻿# x")[0][1] == "PARAGRAPH"
    assert [b[3] for b in blocks("### deep\n# top")] == [["deep"], ["top"]]
    assert len(blocks("a\r\n\r\nb\rc")) == 2


def docx(body):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_tables_follow_paragraphs():
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}{cell('1')}</w:tr></w:tbl>"
    head = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p>'
    got = list(DocxParser().parse(docx(table + head + "<w:p><w:r><w:t>p</w:t></w:r></w:p><w:tbl></w:tbl>")))
    assert [(b.type, b.text, b.heading_path) for b in got] == [("HEADING", "H", ["H"]), ("PARAGRAPH", "p", ["H"]), ("TABLE", "| a | b |\n| c | 1 |", ["H"])]


def test_pdf_pages_and_blank_page():
    stream = zlib.compress(b"BT 12 TL (one \\(1\\)) Tj 0 -14 Td (two) Tj 0 -40 Td (three) Tj ET")
    pdf = b"%PDF-1.4\n1 0 obj <</Type /Page /Contents 2 0 R>> endobj\n2 0 obj <</Filter /FlateDecode>> stream\n" + stream + b"\nendstream endobj\n3 0 obj <</Type /Page>> endobj\n4 0 obj <</Type /Page /Contents 5 0 R>> endobj\n5 0 obj <<>> stream\nBT (last) Tj ET\nendstream endobj\n"
    assert [(b.order, b.text, b.page_no) for b in PdfParser().parse(pdf)] == [(0, "one (1) two", 1), (1, "three", 1), (2, "last", 3)]
    assert [b.page_no for b in page_blocks(["a\n\nb", " ", "c"])] == [1, 1, 3]


def test_registry_and_hwp():
    with pytest.raises(ValueError):
        ParserRegistry([TextParser(), TextParser()])
    assert [b.text for b in HwpParser(lambda data: "a\n \n b  c ").parse(b"x")] == ["a", "b  c"]


def test_parse_documents_codes(spark):
    rows = [(1, b"hello", "text/plain"), (2, b"x", "application/octet-stream"), (3, b"x", "application/pdf"), (4, None, "text/plain")]
    got = {r["doc_id"]: r for r in parse_documents(spark.createDataFrame(rows, "doc_id long, content binary, mime_type string")).collect()}
    assert got[1]["blocks"][0]["text"] == "hello" and got[2]["parse_error"] == "UNSUPPORTED_MIME_TYPE" and got[3]["parse_error"] == "CORRUPTED_FILE" and got[4]["blocks"] == []


def run_one(spark, parser, content, mime):
    df = spark.createDataFrame([(1, content, mime)], "doc_id long, content binary, mime_type string")
    return parsing.parse_documents(df, parsing.ParserRegistry([parser])).first()


def test_failures_of_the_file_and_of_the_parser(spark):
    """Damaged bytes are final; a parser's own failure is tried again."""

    class Odd(parsing.Parser):
        mime_types = frozenset({"x/y"})

        def parse(self, content):
            raise RuntimeError("a bug") if content == b"bug" else OSError("damaged")

    assert run_one(spark, Odd(), b"bug", "x/y")["parse_error"] == "RuntimeError"
    assert run_one(spark, Odd(), b"bytes", "x/y")["parse_error"] == "CORRUPTED_FILE"
    for mime, parser in (("application/pdf", parsing.PdfParser()), ("application/x-hwp", parsing.HwpParser()), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", parsing.DocxParser())):
        assert run_one(spark, parser, b"no such file", mime)["parse_error"] == "CORRUPTED_FILE"


def test_pdf_hex_strings_tree_order_and_object_streams():
    import zlib

    inner = b"<< /Type /Page /Contents 8 0 R >>"
    packed = b"7 0 " + inner
    stream = zlib.compress(packed)
    objects = [
        b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj",
        b"2 0 obj << /Type /Pages /Kids [7 0 R 4 0 R] /Count 2 >> endobj",
        b"4 0 obj << /Type /Page /Contents [5 0 R] >> endobj",
        b"5 0 obj << /Length 1 >> stream\nBT /F1 12 Tf (second \\(page\\)) Tj ET\nendstream endobj",
        b"6 0 obj << /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode >> stream\n" + stream + b"\nendstream endobj",
        b"8 0 obj << >> stream\nBT <48656c6c6f> Tj [<FEFF0021> -200 ( there)] TJ ET\nendstream endobj",
    ]
    got = list(parsing.PdfParser().parse(b"%PDF-1.5\n" + b"\n".join(objects)))
    assert [(b.text, b.page_no) for b in got] == [("Hello! there", 1), ("second (page)", 2)]


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors, all streams in full sectors (none is small: the cutoff is 0)."""
    import struct

    sectors, fat, entries = [], [], []

    def add(data):
        first = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, max(len(data), 1), 512)]
        sectors.extend(parts)
        fat.extend([*range(first + 1, first + len(parts)), 0xFFFFFFFE])
        return first

    def entry(name, kind, left, right, child, start, size):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    none = 0xFFFFFFFF
    starts = {k: add(v) for k, v in streams.items()}
    # root -> FileHeader (right: BodyText) ; BodyText -> Section0 (right: Section1 ...)
    sections = [k for k in streams if k != "FileHeader"]
    entries = [entry("Root Entry", 5, none, none, 1, 0xFFFFFFFE, 0), entry("FileHeader", 2, none, 2, none, starts["FileHeader"], len(streams["FileHeader"])), entry("BodyText", 1, none, none, 3, 0, 0)]
    for i, k in enumerate(sections):
        entries.append(entry(k, 2, none, 4 + i if i + 1 < len(sections) else none, none, starts[k], len(streams[k])))
    directory = add(b"".join(entries))
    at = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, directory, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", at, *[none] * 108) + b"".join(sectors)


def test_hwp_text(spark):
    import struct
    import zlib

    def record(text, tag=67):
        data = text.encode("utf-16-le")
        return struct.pack("<I", tag | len(data) << 20) + data if len(data) < 0xFFF else struct.pack("<II", tag | 0xFFF << 20, len(data)) + data

    def section(*records):
        return zlib.compressobj(wbits=-15).compress(b"") + (c := zlib.compressobj(wbits=-15)).compress(b"".join(records)) + c.flush()

    control = "\x02" + "abcdefg"  # eight code units, not text
    streams = {"FileHeader": b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000300, 1), "Section0": section(record("제목\r"), record("x", 66), record(control + "본문\t" + "1234567" + "text")), "Section1": section(record("long " * 1000))}
    got = run_one(spark, parsing.HwpParser(), compound(streams), "application/x-hwp")
    assert got["parse_error"] is None and [b["text"] for b in got["blocks"]] == ["제목\n본문\ttext\n" + ("long " * 1000).strip()]
    assert run_one(spark, parsing.HwpParser(lambda data: "a\n\nb"), b"", "application/x-hwp")["blocks"][1]["text"] == "b"
    streams["FileHeader"] = streams["FileHeader"][:36] + struct.pack("<I", 3)
    assert run_one(spark, parsing.HwpParser(), compound(streams), "application/x-hwp")["parse_error"] == "CORRUPTED_FILE"


def test_hwp_controls_stand_where_their_marks_are(spark):
    """Cells of a table, a note, and a table in a cell, read between the words around them; what has no mark comes last."""
    import struct

    def record(tag, level, data=b""):
        head = struct.pack("<I", tag | level << 10 | min(len(data), 0xFFF) << 20)
        return head + (struct.pack("<I", len(data)) if len(data) >= 0xFFF else b"") + data

    def paragraph(level, text, *controls):
        return record(66, level, b"\0" * 22) + (record(67, level + 1, text.encode("utf-16-le")) if text is not None else b"") + record(68, level + 1, b"\0" * 8) + b"".join(controls)

    def control(level, *paragraphs):
        return record(71, level, b" lbt") + record(77, level + 1, b"\0" * 20) + b"".join(record(72, level + 1, b"\0" * 8) + p for p in paragraphs)

    mark = lambda code: chr(code) + "abcdefg"
    inner = control(3, paragraph(4, "inner one\r"), paragraph(4, "inner two\r"))
    table = control(1, paragraph(2, "cell a\r"), paragraph(2, f"cell b {mark(11)}after inner\r", inner), paragraph(2, "\r"))
    note = control(1, paragraph(2, "a note\r"))
    body = paragraph(0, f"{mark(2)}before {mark(11)}between{mark(17)} after\r", record(71, 1, b"dces"), table, note) + paragraph(0, None) + paragraph(0, "next\r", control(1, paragraph(2, "unmarked\r")))
    streams = {"FileHeader": b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000300, 0), "Section0": body.ljust(600, b"\0")}
    got = run_one(spark, parsing.HwpParser(), compound(streams), "application/x-hwp")
    assert [b["text"] for b in got["blocks"]] == ["before \ncell a\ncell b \ninner one\ninner two\nafter inner\nbetween\na note\n after", "next\nunmarked"]


def limits(spark, parser, *contents, **how):
    killed, leaked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, c, "x/y") for i, c in enumerate(contents)], "doc_id long, content binary, mime_type string").coalesce(1)
    got = {r["doc_id"]: (r["parse_error"], [b["text"] for b in r["blocks"] or []]) for r in parsing.parse_documents(df, parsing.ParserRegistry([parser]), killed=killed, leaked=leaked, **how).collect()}
    return got, killed.value, leaked.value


def test_a_parser_is_ended_within_c_code_too(spark):
    """Time, memory and crashes are one document's: those before and after it are parsed; each ended process is counted."""

    class Odd(parsing.Parser):
        mime_types = frozenset({"x/y"})

        def parse(self, content):
            import ctypes
            import os
            import time

            if content == b"sleep":
                time.sleep(30)
            if content == b"c code":
                re.match(r"(a+)+$", "a" * 40 + "b")  # for ages, and without a bytecode in between
            if content == b"memory":
                bytearray(1 << 40)
            if content == b"crash":
                os.kill(os.getpid(), 11)
            if content == b"unsendable":

                class Own(Exception):
                    pass

                raise Own("x")
            yield parsing.Block(0, "PARAGRAPH", content.decode(), None, [])

    import re

    got, killed, leaked = limits(spark, Odd(), b"a", b"c code", b"b", b"sleep", b"memory", b"c", b"crash", b"unsendable", b"d", timeout=1.0)
    assert got == {0: (None, ["a"]), 1: ("ParseTimeoutException", []), 2: (None, ["b"]), 3: ("ParseTimeoutException", []), 4: ("MemoryError", []), 5: (None, ["c"]), 6: ("ParserDied", []), 7: ("Own", []), 8: (None, ["d"])}
    assert (killed, leaked) == (3, 0)


def test_in_time_nothing_is_ended(spark):
    class Plain(parsing.Parser):
        mime_types = frozenset({"x/y"})

        def parse(self, content):
            if content == b"bad":
                raise OSError("bad pdf")
            yield parsing.Block(0, "PARAGRAPH", "x" * 3_000_000, None, [])

    got, killed, leaked = limits(spark, Plain(), b"1", b"bad", b"2", timeout=20.0)
    assert {i: (code, len("".join(t))) for i, (code, t) in got.items()} == {0: (None, 3_000_000), 1: ("CORRUPTED_FILE", 0), 2: (None, 3_000_000)} and (killed, leaked) == (0, 0)


def test_a_parser_without_isolation_is_interrupted(spark):
    class Loop(parsing.Parser):
        mime_types = frozenset({"x/y"})
        isolated = False

        def parse(self, content):
            while True:
                pass

    assert limits(spark, Loop(), b"1", timeout=0.5)[0] == {0: ("ParseTimeoutException", [])}
