"""Parsers: bytes -> ordered blocks, and the operator that runs them over a DataFrame.

A block is (order, type, text, page_no, heading_path).  One pass per document
in ``mapInArrow``: a document fits a worker, and no shuffle is needed.
"""

from __future__ import annotations

import io
import re
import signal
import struct
import threading
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import parted
from .isolate import MEMORY, Isolated, ParserDied, ParseTimeout
from .pdf import PdfError, page_texts

BLOCK = "struct<order:int,type:string,text:string,page_no:int,heading_path:array<string>>"
_ARROW = pa.struct([("order", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("page_no", pa.int32()), ("heading_path", pa.list_(pa.string()))])
_SPACE = "".join(chr(c) for c in [*range(9, 14), *range(0x1C, 0x21), 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_BLANK_LINE = re.compile(r"\n[ \t\n\x0b\f\r]*\n")
_HEADING = re.compile(r"(#{1,6})[ \t\n\x0b\f\r]+(.*)")


@dataclass
class Block:
    order: int
    type: str
    text: str
    page_no: int | None
    heading_path: list[str]


class Parser:
    """A registered parser: MIME types, a version tag, and ``parse``.

    ``isolated``: it runs in a child process, which a limit can end anywhere.
    One that only runs Python code in time proportional to its input may do without.
    """

    mime_types: frozenset[str] = frozenset()
    version = ""
    isolated = True

    def parse(self, content: bytes) -> Iterator[Block]:
        raise NotImplementedError


class TextParser(Parser):
    """Plain text and Markdown: headings by #, paragraphs by blank lines, lines joined by a space."""

    mime_types = frozenset({"text/plain", "text/markdown"})
    version = "text-parser/1.0.0"
    isolated = False

    def parse(self, content):
        stack: list[tuple[int, str]] = []
        lines: list[str] = []
        order = 0
        for line in [*re.split(r"\r\n|\n|\r", content.decode("utf-8", "replace")), None]:
            found = _HEADING.fullmatch(line) if line is not None else None
            if line is None or found or not line.strip(_SPACE):
                if lines:
                    yield Block(order, "PARAGRAPH", " ".join(lines), None, [t for _, t in stack])
                    order, lines = order + 1, []
            if found:
                level, title = len(found[1]), found[2].strip(_SPACE)
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, title))
                yield Block(order, "HEADING", title, None, [t for _, t in stack])
                order += 1
            elif line is not None and line.strip(_SPACE):
                lines.append(line.strip(_SPACE))


class DocxParser(Parser):
    """Paragraphs first, then all tables under the last heading; a heading replaces the whole path."""

    mime_types = frozenset({"application/vnd.openxmlformats-officedocument.wordprocessingml.document"})
    version = "docx-parser/1.0.0"
    _W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def _text(self, node) -> str:
        out = []
        for x in node.iter():
            if x.tag == self._W + "t":
                out.append(x.text or "")
            elif x.tag == self._W + "tab":
                out.append("\t")
            elif x.tag in (self._W + "br", self._W + "cr"):
                out.append("\n")
        return "".join(out)

    def parse(self, content):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(self._W + "body")
        path: list[str] = []
        order = 0
        for p in body.findall(self._W + "p"):
            text = self._text(p).strip(_SPACE)
            if not text:
                continue
            style = p.find(f"{self._W}pPr/{self._W}pStyle")
            heading = style is not None and style.get(self._W + "val", "").startswith("Heading")
            if heading:
                path = [text]
            yield Block(order, "HEADING" if heading else "PARAGRAPH", text, None, list(path))
            order += 1
        for table in body.findall(self._W + "tbl"):
            rows = ["| " + " | ".join("\n".join(self._text(p) for p in c.findall(self._W + "p")).strip(_SPACE) for c in row.findall(self._W + "tc")) + " |" for row in table.findall(self._W + "tr")]
            if rows:
                yield Block(order, "TABLE", "\n".join(rows), None, list(path))
                order += 1


def page_blocks(pages: list[str]) -> Iterator[Block]:
    """Blocks of page texts: split at blank lines, inner white space made one space, pages from 1."""
    order = 0
    for number, page in enumerate(pages, 1):
        for part in _BLANK_LINE.split(page.strip(_SPACE)):
            text = part.strip(_SPACE)
            for space in "\t\n\x0b\f\r":
                text = text.replace(space, " ")
            while "  " in text:
                text = text.replace("  ", " ")
            if text:
                yield Block(order, "PARAGRAPH", text, number, [])
                order += 1


class PdfParser(Parser):
    """PDF text by page, laid out by where it stands; paragraphs at blank lines, wide gaps and indents."""

    mime_types = frozenset({"application/pdf"})
    version = "pdf-parser/2.0.0"

    def parse(self, content):
        yield from page_blocks(page_texts(content))


class HwpParser(Parser):
    """HWP through an extractor (bytes -> whole text), that of ``hwp`` if none is given."""

    mime_types = frozenset({"application/x-hwp", "application/haansofthwp"})
    version = "hwp-parser/1.0.0"

    def __init__(self, extract=None):
        self.extract = extract

    def parse(self, content):
        from . import hwp

        parts = (p.strip(_SPACE) for p in _BLANK_LINE.split((self.extract or hwp.text)(content)))
        for order, text in enumerate(p for p in parts if p):
            yield Block(order, "PARAGRAPH", text, None, [])


class ParserRegistry:
    """Parsers by MIME type; two for one type are refused."""

    def __init__(self, parsers=None):
        self.by_type: dict[str, Parser] = {}
        for parser in parsers if parsers is not None else (TextParser(), DocxParser(), PdfParser(), HwpParser()):
            for mime in parser.mime_types:
                if mime in self.by_type:
                    raise ValueError(f"two parsers for {mime}")
                self.by_type[mime] = parser

    def find(self, mime: str | None) -> Parser | None:
        return self.by_type.get(mime)


class CorruptedFile(ValueError):
    """The bytes aren't what their MIME type says."""


#: What reading damaged bytes raises; anything else is the parser's failure and not the file's.
_BAD_BYTES = (OSError, CorruptedFile, PdfError, UnicodeError, EOFError, zipfile.BadZipFile, zlib.error, ElementTree.ParseError, struct.error)


def _interrupted(parser: Parser, content: bytes, seconds: float) -> list[dict]:
    """All blocks, or ParseTimeout after ``seconds`` of wall clock (only a main thread can be interrupted)."""
    if threading.current_thread() is not threading.main_thread() or seconds <= 0:
        return [vars(b) for b in parser.parse(content)]

    def stop(*_):
        raise ParseTimeout

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return [vars(b) for b in parser.parse(content)]
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _size(answer: tuple) -> int:
    """About the bytes of an answer's blocks as Python objects; a small file may unpack to many."""
    return 500 + sum(500 + len(b["text"] or "") + sum(map(len, b["heading_path"] or ())) for b in answer[0] or ())


def parse_documents(df: DataFrame, registry: ParserRegistry | None = None, *, key="doc_id", content="content", mime="mime_type", timeout: float = 60.0, memory: int = MEMORY, killed=None, leaked=None) -> DataFrame:
    """(key, blocks, parser_version, parse_error): blocks of each document, or the code of what went wrong.

    ``timeout`` seconds and ``memory`` bytes are a document's limits; beyond
    them ParseTimeoutException and MemoryError, after a crash ParserDied, all of
    which are tried again by whoever reads them.  ``killed`` and ``leaked`` may be
    accumulators: parser processes stopped, and those that wouldn't stop.
    """
    registry = registry or ParserRegistry()

    def parsed(kind: str, data: bytes, how=lambda parser, data: [vars(b) for b in parser.parse(data)]):
        try:
            return how(registry.find(kind), data), None
        except ParseTimeout:
            return None, "ParseTimeoutException"
        except _BAD_BYTES:
            return None, "CORRUPTED_FILE"
        except Exception as error:  # a parser's own failure: its class's name, which is tried again
            return None, type(error).__name__

    def outcome(child: Isolated, data: bytes, kind: str | None):
        parser = registry.find(kind)
        if parser is None:
            return None, None, "UNSUPPORTED_MIME_TYPE"
        if not parser.isolated:
            blocks, code = parsed(kind, data, lambda p, x: _interrupted(p, x, timeout))
            return blocks, parser.version, code
        try:
            blocks, code = child.run(timeout, kind, data)
        except ParseTimeout:
            blocks, code = None, "ParseTimeoutException"
        except ParserDied:
            blocks, code = None, "ParserDied"
        return blocks, parser.version, code

    def work(batches):
        with Isolated(parsed, memory=memory, killed=killed, leaked=leaked) as child:
            if any(parser.isolated for parser in registry.by_type.values()):
                child.start()  # before the first batch is read, of which it would keep a copy
            for batch in batches:
                first = 0
                answers = (outcome(child, data.as_py() or b"", kind.as_py()) for data, kind in zip(batch.column("content"), batch.column("mime")))
                for some in parted(answers, _size):
                    blocks, versions, errors = zip(*some)
                    yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, len(some)), pa.array(blocks, pa.list_(_ARROW)), pa.array(versions, pa.string()), pa.array(errors, pa.string())], names=[key, "blocks", "parser_version", "parse_error"])
                    first += len(some)

    rows = df.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content"), F.col(mime).alias("mime"))
    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(work, f"`{key}` {kind}, blocks array<{BLOCK}>, parser_version string, parse_error string")


def explode_blocks(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each block."""
    return parsed.select(key, F.explode("blocks").alias("b")).select(key, F.col("b.order").alias("block_order"), F.col("b.type").alias("type"), F.col("b.text").alias("text"), F.col("b.page_no").alias("page_no"), F.col("b.heading_path").alias("heading_path"))
