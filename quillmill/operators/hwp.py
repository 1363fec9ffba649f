"""Text of HWP 5 files, from their published format: a compound file whose body sections are trees of records."""

from __future__ import annotations

import struct
import zlib

# Fixed values of the formats.
_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_SIGNATURE = b"HWP Document File"
_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF
_PARAGRAPH, _PARAGRAPH_TEXT, _CONTROL = 66, 67, 71
_COMPRESSED, _ENCRYPTED = 1, 2
#: Control characters that stand alone; 9, 10, 13, 24, 30 and 31 are text, the others hold eight code units.
_ALONE = {0, 10, 13, 24, 25, 26, 27, 28, 29, 30, 31}
#: Control characters that have a record of their own, in the same order.
_EXTENDED = {1, 2, 3, 11, 12, 14, 15, 16, 17, 18, 21, 22, 23}
_TEXT = {9: "\t", 10: "\n", 24: "-", 30: " ", 31: " "}


class CompoundFile:
    """Streams of an OLE compound file by their path; a damaged file raises OSError."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC or len(data) < 512:
            raise OSError("not a compound file")
        self.data = data
        (shift, mini_shift), self.cutoff = struct.unpack_from("<HH", data, 30), struct.unpack_from("<I", data, 56)[0]
        if not (7 <= shift <= 16 and 4 <= mini_shift <= shift):
            raise OSError("odd sector sizes")
        self.size, self.mini = 1 << shift, 1 << mini_shift
        directory, mini_fat, more = (struct.unpack_from("<I", data, at)[0] for at in (48, 60, 68))
        sectors, entries = [x for x in struct.unpack_from("<109I", data, 76) if x != _FREE], self.size // 4
        seen = set()
        while more < _END and more not in seen:
            seen.add(more)
            part = struct.unpack(f"<{entries}I", self._sector(more))
            sectors += [x for x in part[:-1] if x != _FREE]
            more = part[-1]
        self.fat = [x for s in sectors for x in struct.unpack(f"<{entries}I", self._sector(s))]
        raw = self._chain(directory)
        self.entries = [raw[i : i + 128] for i in range(0, len(raw) - 127, 128)]
        if not self.entries:
            raise OSError("no directory")
        self.mini_fat = list(struct.unpack(f"<{len(m) // 4}I", m)) if (m := self._chain(mini_fat)) else []
        self.mini_data = self._chain(struct.unpack_from("<I", self.entries[0], 116)[0])
        self.streams: dict[str, tuple[int, int]] = {}
        self._walk(struct.unpack_from("<I", self.entries[0], 76)[0], "")

    def _sector(self, n: int) -> bytes:
        out = self.data[(n + 1) * self.size : (n + 2) * self.size]
        if len(out) != self.size:
            raise OSError("a sector beyond the file's end")
        return out

    def _chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at < _END:
            if at in seen or at >= len(self.fat):
                raise OSError("a broken chain of sectors")
            seen.add(at)
            out.append(self._sector(at))
            at = self.fat[at]
        return b"".join(out)

    def _walk(self, top: int, base: str) -> None:
        todo, seen = [(top, base)], set()
        while todo:
            n, base = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            e = self.entries[n]
            name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le")
            left, right, child, start = (struct.unpack_from("<I", e, at)[0] for at in (68, 72, 76, 116))
            todo += [(left, base), (right, base)]
            if e[66] == 1:
                todo.append((child, f"{base}{name}/"))
            elif e[66] == 2:
                self.streams[base + name] = start, struct.unpack_from("<I", e, 120)[0]

    def read(self, name: str) -> bytes:
        if name not in self.streams:
            raise OSError(f"no stream {name}")
        at, size = self.streams[name]
        if size >= self.cutoff:
            return self._chain(at)[:size]
        out, seen = [], set()
        while at < _END and len(out) * self.mini < size:
            if at in seen or at >= len(self.mini_fat):
                raise OSError("a broken chain of small sectors")
            seen.add(at)
            out.append(self.mini_data[at * self.mini : (at + 1) * self.mini])
            at = self.mini_fat[at]
        return b"".join(out)[:size]


class Record:
    """A record of a section and those a level below it, in order."""

    def __init__(self, tag: int, data: bytes):
        self.tag, self.data, self.below = tag, data, []


def _tree(data: bytes) -> Record:
    """A section's records by level; one that skips levels lies below the last one above it."""
    top = Record(-1, b"")
    path, at = [(-1, top)], 0
    while at + 4 <= len(data):
        (word,) = struct.unpack_from("<I", data, at)
        tag, level, size, at = word & 0x3FF, word >> 10 & 0x3FF, word >> 20, at + 4
        if size == 0xFFF:
            (size,), at = struct.unpack_from("<I", data, at), at + 4
        record = Record(tag, data[at : at + size])
        at += size
        while path[-1][0] >= level:
            path.pop()
        path[-1][1].below.append(record)
        path.append((level, record))
    return top


def _lines(record: Record) -> list[str]:
    """Lines of all paragraphs below a record, in reading order."""
    out = []
    for x in record.below:
        if x.tag == _PARAGRAPH:
            out += _paragraph(x)
        elif x.tag == _PARAGRAPH_TEXT:
            out += _shown(x.data, [])
        else:
            out += _lines(x)
    return out


def _paragraph(record: Record) -> list[str]:
    controls = [[line for line in _lines(x) if line.strip()] for x in record.below if x.tag == _CONTROL]
    texts = [x.data for x in record.below if x.tag == _PARAGRAPH_TEXT]
    if not texts:
        return [line for some in controls for line in some] or [""] * bool(record.below)
    return _shown(b"".join(texts), controls)


def _shown(data: bytes, controls: list[list[str]]) -> list[str]:
    """A paragraph's text as lines: what a control holds (a table's cells, a note, a box) stands in lines of its own where its mark is."""
    units, out, line, i = struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2]), [], [], 0
    controls = list(controls)

    def end() -> None:
        out.append(b"".join(line).decode("utf-16-le", "replace"))
        line.clear()

    while i < len(units):
        if units[i] >= 32:
            line.append(struct.pack("<H", units[i]))
        elif units[i] in _TEXT:
            line.append(_TEXT[units[i]].encode("utf-16-le"))
        elif units[i] in _EXTENDED and controls:
            held = controls.pop(0)
            if held:
                if b"".join(line).strip(b"\0 "):
                    end()
                line.clear()
                out += held
        i += 1 if units[i] >= 32 or units[i] in _ALONE else 8
    if line or not out:
        end()
    return out + [x for some in controls for x in some]


def text(content: bytes) -> str:
    """The paragraphs of all body sections in order, a line each, and in their places those of tables, notes and boxes.  Encrypted and damaged files raise OSError."""
    file = CompoundFile(content)
    head = file.read("FileHeader")
    if not head.startswith(_SIGNATURE) or len(head) < 40:
        raise OSError("not an HWP file")
    (flags,) = struct.unpack_from("<I", head, 36)
    if flags & _ENCRYPTED:
        raise OSError("an encrypted HWP file")
    out = []
    for name in sorted((x for x in file.streams if x.startswith("BodyText/Section")), key=lambda x: int(x[16:] or 0)):
        data = file.read(name)
        if flags & _COMPRESSED:
            data = zlib.decompressobj(-15).decompress(data)
        out += _lines(_tree(data))
    return "\n".join(out)
