"""PDF text: objects, cross-references, fonts, layout, damage; and a query over PDFs made of the driver's documents."""

import base64
import zlib

import pytest

from quillmill.operators import pdf
from quillmill.operators.parsing import PdfParser


def blocks(content):
    return [(b.order, b.text, b.page_no) for b in PdfParser().parse(content)]


def build(objects, root=1, packed=False, extra=b""):
    """A file with cross-references: a table, or a stream with objects 100 + i packed."""
    out, places = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n", {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    at, size = len(out), max(places) + 1
    if packed:
        rows = b"".join((b"\x01" + places[n].to_bytes(3) + b"\0" if n in places else b"\0\0\0\0\0") for n in range(size)) + b"\x01" + at.to_bytes(3) + b"\0"
        rows = zlib.compress(b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(rows[i : i + 5], rows[i - 5 : i] if i else bytes(5))) for i in range(0, len(rows), 5)))
        head = b"<</Type /XRef /Size %d /W [1 3 1] /Root %d 0 R /Filter /FlateDecode /DecodeParms <</Predictor 12 /Columns 5>> /Length %d>>" % (size + 1, root, len(rows))
        out += b"%d 0 obj\n" % size + head + b"stream\n" + rows + b"\nendstream\nendobj\n"
    else:
        out += b"xref\n0 %d\n" % size + b"".join((b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n") for n in range(size))
        out += b"trailer\n<</Size %d /Root %d 0 R %s>>\n" % (size, root, extra)
    return out + b"startxref\n%d\n%%%%EOF" % at


def stream(data, head=b""):
    return b"<</Length %d %s>>\nstream\n" % (len(data), head) + data + b"\nendstream"


def pages(*contents, fonts=b"<</F1 <</Type /Font /Subtype /Type1 /BaseFont /Helvetica>>>>", **how):
    """A document whose pages show ``contents``; None is a page without content."""
    objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Count %d /Resources <</Font %s>> /Kids [%s]>>" % (len(contents), fonts, b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(contents))))}
    for i, c in enumerate(contents):
        objects[3 + 2 * i] = b"<</Type /Page /Parent 2 0 R %s>>" % (b"/Contents %d 0 R" % (4 + 2 * i) if c is not None else b"")
        if c is not None:
            objects[4 + 2 * i] = stream(c)
    return build(objects, **how)


def lines(*texts, pitch=14, top=700, left=50):
    return b"\n".join(b"BT /F1 12 Tf %d %d Td (%s) Tj ET" % (left, top - pitch * i, t) for i, t in enumerate(texts))


@pytest.mark.parametrize("packed", [False, True])
def test_strings_with_parentheses_and_escapes(packed):
    got = blocks(pages(rb"BT /F1 12 Tf 50 700 Td (call f(x) now) Tj ( \(a\051 \134 (b(c)) \
d) Tj ET", packed=packed))
    assert got == [(0, "call f(x) now (a) \\ (b(c)) d", 1)]


def test_gaps_part_words_and_kerning_does_not():
    assert blocks(pages(b"BT /F1 12 Tf 50 700 Td [(He) -20 (llo) -400 (world) 30 (s)] TJ ET"))[0][1] == "Hello worlds"
    assert blocks(pages(b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (Left) Tj 1 0 0 1 200 700 Tm (right) Tj ET"))[0][1] == "Left right"
    assert blocks(pages(b"BT /F1 12 Tf 50 700 Td (foot) Tj /F1 7 Tf 4 Ts (1) Tj 0 Ts /F1 12 Tf ( note) Tj ET"))[0][1] == "foot1 note"


def test_lines_placed_by_matrices():
    got = blocks(pages(b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (First) Tj 1 0 0 1 50 600 Tm (Second) Tj ET"))
    assert got == [(0, "First", 1), (1, "Second", 1)]
    assert blocks(pages(b"q 2 0 0 2 0 0 cm BT /F1 6 Tf 25 350 Td (one) Tj 0 -7 TD (two) Tj T* (three) Tj ET Q"))[0][1] == "one two three"
    assert blocks(pages(b"BT /F1 12 Tf 14 TL 50 700 Td (one) Tj (two) ' 1 2 (three) \" ET"))[0][1] == "one two three"
    assert blocks(pages(b"BT /F1 12 Tf 0 1 -1 0 300 50 Tm (turned) Tj 0 1 -1 0 314 50 Tm (text) Tj ET"))[0][1] == "turned text"


def test_paragraphs_of_one_page():
    """By a line of white space, by a wide gap alone, by an indent."""
    first, second = (b"paragraph one line a.", b"paragraph one line b."), (b"paragraph two line a.", b"paragraph two line b.")
    want = [(0, "paragraph one line a. paragraph one line b.", 1), (1, "paragraph two line a. paragraph two line b.", 1)]
    assert blocks(pages(lines(*first, b" ", *second))) == want
    assert blocks(pages(lines(*first) + b"\n" + lines(*second, top=700 - 14 - 40))) == want
    assert blocks(pages(lines(*first) + b"\n" + lines(second[0], top=672, left=70) + b"\n" + lines(second[1], top=658))) == want


def test_pages_keep_their_numbers():
    got = blocks(pages(lines(b"first page paragraph one.", b" ", b"first page paragraph two."), None, lines(b"third page.")))
    assert got == [(0, "first page paragraph one.", 1), (1, "first page paragraph two.", 1), (2, "third page.", 3)]


def test_newer_objects_win():
    """A later part of the file replaces a page's content; the old one is still there."""
    old = pages(lines(b"old"))
    body = b"4 0 obj\n" + stream(lines(b"new")) + b"\nendobj\n"
    at = len(old) + 1 + len(body)
    prev = int(old.rsplit(b"startxref\n", 1)[1].split()[0])
    new = old + b"\n" + body + b"xref\n4 1\n%010d 00000 n \ntrailer\n<</Size 5 /Root 1 0 R /Prev %d>>\nstartxref\n%d\n%%%%EOF" % (len(old) + 1, prev, at)
    assert blocks(new)[0][1] == "new" and blocks(old)[0][1] == "old"
    assert blocks(new.replace(b"startxref", b"nothing"))[0][1] == "new"  # cross-references lost: the last of each number counts


def test_unicode_maps_and_encodings():
    cmap = b"/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <D55C> <0002> <AE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00660069> <D83DDE00>] endbfrange end"
    fonts = b"<</F1 20 0 R /F2 21 0 R /F3 22 0 R>>"
    content = b"BT /F1 12 Tf 50 700 Td <00010002 0010 0011 0012 0020 0021 7777> Tj ET BT /F2 12 Tf 50 660 Td (a\\200b\\201) Tj ET BT /F3 12 Tf 50 620 Td (caf\\351 \\200) Tj ET"
    objects = {
        1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Count 1 /Resources <</Font %s>> /Kids [3 0 R]>>" % fonts, 3: b"<</Type /Page /Parent 2 0 R /Contents [4 0 R 4 0 R]>>", 4: stream(zlib.compress(content), b"/Filter [/FlateDecode]"),
        20: b"<</Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 23 0 R /DescendantFonts [<</DW 500 /W [1 [1000 1000] 16 18 400]>>]>>",
        21: b"<</Type /Font /Subtype /Type1 /Encoding <</Differences [128 /Eacute /f_i /uni20AC 97 /ccedilla]>> /FirstChar 97 /Widths [500 500]>>",
        22: b"<</Type /Font /Subtype /TrueType /Encoding /WinAnsiEncoding>>", 23: stream(cmap),
    }
    objects[3] = b"<</Type /Page /Parent 2 0 R /Contents 4 0 R>>"
    assert [t for _, t, _ in blocks(build(objects))] == ["한글abcfi\U0001f600", "çÉbfi", "café €"]
    assert [pdf.glyph_text(x) for x in ("A", "seven", "odieresis", "Scaron", "space", "uni0041", "u1F600", "f_f", "x.alt", "nosuchglyph")] == ["A", "7", "ö", "Š", " ", "A", "\U0001f600", "ff", "x", ""]


def test_filters_forms_and_inline_images():
    text = lines(b"plain words")
    for data, how in ((base64.a85encode(text) + b"~>", b"/ASCII85Decode"), (text.hex().encode() + b">", b"/ASCIIHexDecode"), (base64.a85encode(zlib.compress(text)) + b"~>", b"[/A85 /Fl]"), (bytes([len(text) - 1]) + text + b"\x80", b"/RunLengthDecode")):
        objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R]>>", 3: b"<</Type /Page /Contents 4 0 R>>", 4: stream(data, b"/Filter " + how)}
        assert blocks(build(objects))[0][1] == "plain words"
    assert pdf._unlzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    image = b"BI /W 1 /H 1 /BPC 8 ID \x28\xff(Tj EI\n"
    objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R]>>", 3: b"<</Type /Page /Contents 4 0 R /Resources <</XObject <</X1 5 0 R>>>>>>", 4: stream(image + b"% (a comment) Tj\n/X1 Do"), 5: stream(lines(b"in a form"), b"/Subtype /Form /Matrix [1 0 0 1 10 10]")}
    assert [t for _, t, _ in blocks(build(objects))] == ["in a form"]


def test_damage_is_the_files():
    whole = pages(lines(b"some words"))
    for bad in (b"", b"%PDF-1.4", b"no pdf", whole.replace(b"/Root", b"/Encrypt <<>> /Root")):
        with pytest.raises(pdf.PdfError):
            blocks(bad)
    for cut in range(20, len(whole), 37):  # cut anywhere: text, nothing or an error of the file, and never another
        try:
            assert [t for _, t, _ in blocks(whole[:cut])] in ([], ["some words"], *[["some words"[:i]] for i in range(10)])
        except pdf.PdfError:
            pass
    loop = build({1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [2 0 R 3 0 R]>>", 3: b"<</Type /Page /Contents 3 0 R>>"})
    assert blocks(loop) == []


def counting(monkeypatch, kind, name):
    """How often a method is called, in a list of one."""
    calls, method = [0], getattr(kind, name)

    def counted(*args):
        calls[0] += 1
        return method(*args)

    monkeypatch.setattr(kind, name, counted)
    return calls


@pytest.mark.parametrize("line", [b"0 -14 Td (a line of words) Tj", b"1 0 0 1 50 %d Tm [(a) -300 (line) -300 (of words)] TJ", b"1 0 0 1 50 %d Tm <61206c696e65206f6620776f726473> Tj", b"(a line of words) '"])
def test_plain_lines_are_read_at_once(monkeypatch, line):
    """Neither token by token nor with the fonts of the page before; the text is the same as with comments between the tokens."""
    shown = b"\n".join(line % (700 - 14 * i) if b"%" in line else line for i in range(40))
    page = b"BT /F1 12 Tf 14 TL 50 714 Td " + shown + b" ET"
    tokens, fonts = counting(monkeypatch, pdf.Lexer, "next"), counting(monkeypatch, pdf.Font, "__init__")
    got = blocks(pages(*[page] * 10))
    assert got == [(i, " ".join(["a line of words"] * 40), i + 1) for i in range(10)]
    assert tokens[0] < 10 * 40 and fonts[0] == 1
    assert blocks(pages(page.replace(b") ", b") %x\n").replace(b"> ", b"> %x\n").replace(b"\n0", b"\n%x\n0").replace(b"\n(", b"\n%x\n("))) == got[:1]


def test_arrays_part_words_as_the_layout_does():
    """Steps of several sizes, white space at the ends of strings, strings that show nothing, steps before and behind, and a matrix without a line."""
    show = lambda some, tm=b"1 0 0 1 50 700 Tm": [t for _, t, _ in blocks(pages(b"BT /F1 12 Tf " + tm + b" [" + some + b"] TJ (x) Tj ET"))]
    assert show(b"-500 (a) -300 (b) -100 (c) 100 (d) 300 (e) -300 ( f) -300 (g ) -300 (h) 10") == ["a bcd e f g hx"]
    assert show(b"(a) -300 (b) -300 (c) -300") == ["a b c x"] and show(b"(a) -300 (b) -300 () -300 (c)") == ["a b cx"] and show(b"") == ["x"] and show(b"-300") == ["x"]
    assert show(b"(a\\)) -300 (b) -300 <63> -300 (d)") == ["a) b c dx"]
    assert show(b"(a) (b)", b"0 0 0 1 50 700 Tm") == ["a b x"] and show(b"(a) -300 (b)", b"0 1 -1 0 50 700 Tm") == ["a bx"]
    two = pages(b"BT /F1 12 Tf 50 700 Td <d83dde00 0041> Tj <0042 00> Tj ET", fonts=b"<</F1 <</Type /Font /Subtype /Type0 /Encoding /UniJIS-UCS2-H /DescendantFonts [<</DW 500>>]>>>>")
    assert [t for _, t, _ in blocks(two)] == ["��AB�"]


def test_a_comment_at_the_end_shows_nothing_and_takes_no_time():
    assert [t for _, t, _ in blocks(pages(lines(b"words") + b"\n" + b"%" * 60))] == ["words"]
    assert pdf.Lexer(b" % a comment").next() is None


def test_fonts_of_many_files_dont_pile_up():
    """Equal fonts share their tables, which are few and small; files read with them and without them give the same."""
    font = lambda width: b"<</F1 <</Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [%s]>>>>" % b" ".join([b"%d" % width] * 224)
    files = [pages(b"BT /F1 10 Tf 50 700 Td (caf\xe9) Tj 1 0 0 1 %d 700 Tm (au lait) Tj ET" % (50 + 4 * width // 100 + 1), fonts=font(width)) for width in range(200, 300)]
    assert [blocks(f) for f in files * 3] == [[(0, "caf\xe9au lait", 1)] for _ in files * 3]
    assert len(pdf._TABLES) <= 32 and len(pdf._MAPS) <= 32
