"""Media columns: texts as grey images in archives, read by a Spark data source of our own.

A payload of a multiple of 192 bytes becomes a PNG, 192 samples wide, 8 bits
each.  Archives are files of members:

    QMED, i64 id, u8 null mark, u32 unpadded bytes, u32 media bytes, u32 crc32 of the media, media

and end with the members' offsets (u64 each), their number (u64) and ``QEND``.
``MediaArchiveSource`` plans byte ranges over a directory's committed archives; a
range's reader takes the members that begin in it, in Arrow batches of bounded
size, and reads a member again, by its offset alone, if that fails.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ._shared import open_fs, shared_path, stage, write_file

WIDTH = 192
HEAD = "<4sqBIII"
HEAD_BYTES = struct.calcsize(HEAD)
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
SCHEMA = "doc_id long, n_bytes long, offset long, media binary"


def payload_of(data: bytes) -> bytes:
    """``data`` with spaces appended up to a positive multiple of 192."""
    return data + b" " * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey PNG whose samples are the payload's bytes; the same bytes for the same payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The samples of a PNG written by ``to_png``; checks every chunk's crc."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, width = 8, [], 0
    while at < len(png):
        (size,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's crc is wrong")
        if kind == b"IHDR":
            width, _, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filter other than 0")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, mean step between neighbours and entropy of the samples, and a 64-bit average hash."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    cells = np.add.reduceat(x.astype(np.int64), np.arange(0, len(x), 3 * (len(x) // WIDTH)))[:64] if len(x) >= 64 else x
    bits = "".join("1" if c > cells.mean() else "0" for c in cells)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"mean={x.mean():.4f};std={x.std():.4f};step={step:.4f};entropy={entropy:.4f};hash={int(bits, 2):016x}"


def write_archives(docs: DataFrame, *, id_col="doc_id", text_col="text") -> str:
    """Store every row's text; returns the archive directory's URI.

    Each task writes archives under names of its own attempt; the names that
    the finished job reports are committed in ``_committed``, so those left by a
    lost executor are never read.  Null texts count as empty, null ids stay null,
    rows that repeat are members each; of an empty table there is no archive.
    The folder is the caller's, and nothing here deletes it.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "media")

    def work(batches):
        members, offsets, at, n = [], [], 0, 0

        def flush():
            path = f"{folder}/archive-{uuid.uuid4().hex}.qma"
            write_file(path, b"".join([*members, np.array(offsets, "<u8").tobytes(), struct.pack("<Q4s", len(offsets), b"QEND")]))
            return pa.RecordBatch.from_pydict({"name": [path.rsplit("/", 1)[1]], "members": [len(offsets)]})

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = text.encode()
                png = to_png(payload_of(data))
                members.append(struct.pack(HEAD, b"QMED", doc or 0, doc is None, len(data), len(png), zlib.crc32(png)) + png)
                offsets.append(at)
                at += len(members[-1])
                if at >= 4 * RANGE_BYTES:
                    yield flush()
                    members, offsets, at = [], [], 0
        if offsets:
            yield flush()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = stage(base.mapInArrow(work, "name string, members long"), "media-manifest")
    # Names of archives, one for tens of megabytes, not rows.
    write_file(f"{folder}/_committed", json.dumps(sorted(r["name"] for r in made.toLocalIterator())).encode())
    return folder


class ArchiveRange(InputPartition):
    """Members of one archive that begin in a range of bytes."""

    def __init__(self, path: str, size: int, begin: int, end: int):
        self.path, self.size, self.begin, self.end = path, size, begin, end


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.step = int(options.get("rangeBytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self):
        fs, base = open_fs(self.folder)
        with fs.open_input_file(f"{base}/_committed") as src:
            names = json.loads(src.read())
        ranges = []
        for info in fs.get_file_info([f"{base}/{n}" for n in names]):
            path = f"{self.folder.rstrip('/')}/{info.base_name}"
            ranges += [ArchiveRange(path, info.size, a, min(a + self.step, info.size)) for a in range(0, info.size, self.step)]
        return ranges or [ArchiveRange("", 0, 0, 0)]

    def _member(self, part: ArchiveRange, offset: int):
        """One member by its offset; a fresh handle for each attempt."""
        for attempt in range(self.attempts):
            try:
                fs, path = open_fs(part.path)
                with fs.open_input_file(path) as src:
                    src.seek(offset)
                    magic, doc, null, n_bytes, size, crc = struct.unpack(HEAD, src.read(HEAD_BYTES))
                    media = src.read(size)
                if magic != b"QMED" or len(media) != size or zlib.crc32(media) != crc:
                    raise OSError(f"damaged member at {offset} of {part.path}")
                return (None if null else doc), n_bytes, offset, media
            except (OSError, struct.error):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.1 * 2**attempt)

    def read(self, partition):
        if not partition.size:
            return
        fs, path = open_fs(partition.path)
        with fs.open_input_file(path) as src:
            src.seek(partition.size - 12)
            count, magic = struct.unpack("<Q4s", src.read(12))
            if magic != b"QEND":
                raise OSError(f"no index in {partition.path}")
            src.seek(partition.size - 12 - 8 * count)
            offsets = np.frombuffer(src.read(8 * count), "<u8")
            rows, held = [], 0
            for offset in offsets[(offsets >= partition.begin) & (offsets < partition.end)].tolist():
                row = self._first(src, offset) or self._member(partition, offset)
                rows.append(row)
                held += len(row[3])
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _first(src, offset):
        """The member through the open handle, or None if anything is wrong with it."""
        try:
            src.seek(offset)
            magic, doc, null, n_bytes, size, crc = struct.unpack(HEAD, src.read(HEAD_BYTES))
            media = src.read(size)
            return ((None if null else doc), n_bytes, offset, media) if magic == b"QMED" and len(media) == size and zlib.crc32(media) == crc else None
        except (OSError, struct.error):
            return None

    @staticmethod
    def _batch(rows):
        ids, sizes, offsets, media = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "offset", "media"])


class MediaArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(directory)``; options rangeBytes, attempts."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MediaArchiveReader(self.options)


def read_archives(spark, folder: str, **options) -> DataFrame:
    """doc_id, n_bytes (unpadded), offset and media of every member; no row for a folder without any."""
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of the payloads read back, a row for each of ``media``, whatever its id.  Equal texts give equal values; an empty table gives none."""

    def work(batches):
        for batch in batches:
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for png in batch.column("media").to_pylist():
                payload = from_png(png)
                for k, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), feature(payload))):
                    out[k].append(v)
            arrays = [batch.column("doc_id"), batch.column("n_bytes")] + [pa.array(v, pa.int64() if k in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", *out])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
