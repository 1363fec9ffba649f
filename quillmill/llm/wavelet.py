"""Token ids as one wavelet matrix per shard.

File format (little-endian): ``QWM1``; u64 tokens, u32 documents, u8 levels;
then sections, each u64 length and zstd bytes: document ids (i64), a null mark
for each (u8), tokens of each (u32), and for every level, from the highest bit
down, the bit-plane (packed, first bit highest) and its ones before each
block of 512 bits (u32).  A plane's order is that of the level above with its
zeros moved before its ones.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import partitions, read_file, shared_path, slices, stage, write_file
from .tokens import library_encoder

BLOCK = 512
#: Bytes of text for each shard, about.
SHARD_BYTES = 8 << 20
#: Bytes of text encoded at a time.
SLICE_BYTES = 8 << 20
END_ID = 1


def _narrow(levels: int) -> type:
    """The type in which ids of so many bits are moved about."""
    return np.uint16 if levels <= 16 else np.uint32


def build(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """The file's bytes for the ids of documents in order."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    ids = np.asarray(ids)
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    out = [b"QWM1", struct.pack("<QIB", len(ids), len(doc_ids), levels)]

    def section(array: np.ndarray) -> None:
        data = squeeze(array.tobytes())
        out.extend((struct.pack("<Q", len(data)), data))

    section(np.array([0 if d is None else d for d in doc_ids], "<i8"))
    section(np.array([d is None for d in doc_ids], "u1"))
    section(np.asarray(lengths, "<u4"))
    kind = _narrow(levels)
    rest = ids.astype(kind)
    for level in reversed(range(levels)):
        bit = (rest & kind(1 << level)) != 0
        packed = np.packbits(bit)
        section(packed)
        blocks = np.zeros((-(-len(bit) // BLOCK), BLOCK // 64), np.uint64)
        blocks.reshape(-1).view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(blocks).sum(1, dtype=np.int64)
        section((np.cumsum(ones) - ones).astype("<u4"))
        rest = np.concatenate([rest[~bit], rest[bit]])
    return b"".join(out)


class WaveletMatrix:
    """A shard read from its bytes: documents, token access, counts and places of a token.

    Planes stay packed; what stands before a place is the directory's count for
    its block and the set bits of at most eight words.  Places may be arrays.
    """

    def __init__(self, data: bytes):
        if data[:4] != b"QWM1":
            raise ValueError("not a wavelet shard")
        self.n, docs, self.levels = struct.unpack_from("<QIB", data, 4)
        at, wide = 17, zstandard.ZstdDecompressor()

        def section(kind: str) -> np.ndarray:
            nonlocal at
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8 + size
            return np.frombuffer(wide.decompress(data[at - size : at]), kind)

        ids, null, self.lengths = section("<i8"), section("u1"), section("<u4")
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null)]
        assert len(self.doc_ids) == docs
        self.planes, self.zeros = [], []
        for _ in range(self.levels):
            words = np.zeros(-(-self.n // BLOCK) * (BLOCK // 64) + 1, ">u8")
            packed = section("u1")
            words.view(np.uint8)[: len(packed)] = packed
            directory = np.append(section("<u4").astype(np.int64), 0)
            self.planes.append((words.astype(np.uint64), directory))
            directory[-1] = (directory[-2] if len(directory) > 1 else 0) + int(np.bitwise_count(words[-1 - BLOCK // 64 :]).sum())
            self.zeros.append(int(self.n - directory[-1]))

    def _bit(self, level: int, i: np.ndarray) -> np.ndarray:
        return (self.planes[level][0][i >> 6] >> (63 - (i & 63)).astype(np.uint64)) & np.uint64(1) != 0

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before places i: the directory's count, whole words of the block, then bits of one word."""
        words, directory = self.planes[level]
        word, out = i >> 6, directory[i // BLOCK].copy()
        for j in range(1, BLOCK // 64):
            out += np.where(j <= word % (BLOCK // 64), np.bitwise_count(words[np.maximum(word - j, 0)]), 0)
        part = words[word] >> np.uint64(1) >> (63 - (i & 63)).astype(np.uint64)
        return out + np.bitwise_count(part)

    def access(self, i):
        """The tokens at places ``i``."""
        one_place, i = np.ndim(i) == 0, np.atleast_1d(np.asarray(i, np.int64))
        value = np.zeros(len(i), np.uint32)
        for level in range(self.levels):
            one, before = self._bit(level, i), self._ones(level, i)
            value = value << np.uint32(1) | one
            i = np.where(one, self.zeros[level] + before, i - before)
        return int(value[0]) if one_place else value

    def _down(self, token: int, *ends: np.ndarray) -> list[np.ndarray]:
        """Places ``ends`` followed down all levels along the token's bits."""
        for level in range(self.levels):
            ones = [self._ones(level, x) for x in ends]
            ends = [self.zeros[level] + o for o in ones] if token >> (self.levels - 1 - level) & 1 else [x - o for x, o in zip(ends, ones)]
        return ends

    def rank(self, token: int, i):
        """How often ``token`` stands before places ``i``."""
        one_place, i = np.ndim(i) == 0, np.atleast_1d(np.asarray(i, np.int64))
        if token >> self.levels:
            out = np.zeros(len(i), np.int64)
        else:
            begin, end = self._down(token, np.zeros(1, np.int64), i)
            out = end - begin
        return int(out[0]) if one_place else out

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _nth(self, level: int, one: int, k: int) -> int:
        """The place of bit number k (from 0) of a kind: the block by search in the directory, then within its words."""
        words, directory = self.planes[level]
        before = directory[:-1] if one else np.arange(len(directory) - 1) * BLOCK - directory[:-1]
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(words[block * (BLOCK // 64) : (block + 1) * (BLOCK // 64)].astype(">u8").view(np.uint8))
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """The place of occurrence k (from 0) of ``token``: down to its run, then back up."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = int(self._down(token, np.zeros(1, np.int64))[0][0]) + k
        for level in reversed(range(self.levels)):
            one = token >> (self.levels - 1 - level) & 1
            i = self._nth(level, one, i - self.zeros[level] if one else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order: from the lowest plane up, each undoes one move of zeros before ones."""
        kind = _narrow(self.levels)
        value = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            bits = np.unpackbits(self.planes[level][0].astype(">u8").view(np.uint8), count=self.n).view(bool)
            up = np.empty_like(value)
            up[~bits] = value[: self.zeros[level]]
            up[bits] = value[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            value = up
        return value.astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer: str, *, id_col="doc_id", text_col="text", end_id: int = END_ID) -> DataFrame:
    """Encode all texts and write the shards; returns the staged manifest (shard, path, n_docs, n_tokens, n_bytes).

    Shards are ranges of ascending id with like many rows, null ids last, their
    number set by the bytes of text.  Rows of one id, or without, are ordered and
    parted by a digest of the text, so that a shard needn't hold all of them.
    Null texts count as empty and hold only the end id.  An empty table gives
    no shards.  Other columns are ignored, whatever their names.  The folder is
    the caller's, and nothing here deletes it.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "wavelet")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    ranged = base.repartitionByRange(max(1, -(-size // SHARD_BYTES)), *order).sortWithinPartitions(*order)

    def write(batches):
        coder, ids, docs_, lengths, number = library_encoder(tokenizer), [], [], [], None
        for batch in batches:
            number, texts = batch.column("shard")[0].as_py(), batch.column("text")
            docs_ += batch.column("doc_id").to_pylist()
            for a, b in slices(texts, SLICE_BYTES):
                found, first = coder.encode(texts.slice(a, b - a))
                n = np.diff(first) + 1  # with the end id
                every = np.full(len(found) + len(n), end_id, np.uint32)
                inside = np.ones(len(every), bool)
                inside[np.cumsum(n) - 1] = False
                every[inside] = found
                ids.append(every.astype(np.uint16) if every.max() < 1 << 16 else every)
                lengths.append(n)
        if docs_:
            every, n = np.concatenate(ids), np.concatenate(lengths)
            data = build(every, docs_, n)
            path = f"{folder}/shard-{number:08d}-{uuid.uuid4().hex}.qwm"
            write_file(path, data)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "path": [path], "n_docs": [len(docs_)], "n_tokens": [len(every)], "n_bytes": [len(data)]})

    rows = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    return stage(rows.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long, n_bytes long"), "wavelet-manifest")


def read_shards(manifest: DataFrame, *, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document, from the files alone.

    The ids at the documents' ends are looked up by ``access`` and must be the
    end id: a shard that isn't what was written raises.  ``start`` counts the ids of all documents before it; the shards' offsets
    come from a window over the manifest, one row per shard.
    """
    spark = manifest.sparkSession
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("offset", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0))).select("shard", "path", "offset")
    parts = max(1, min(manifest.count(), 4 * partitions(spark)))

    def read(batches):
        for batch in batches:
            for path, offset in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist()):
                matrix = WaveletMatrix(read_file(path))
                raw = matrix.tokens().astype("<u4").tobytes()
                ends = np.cumsum(matrix.lengths.astype(np.int64))
                begins = ends - matrix.lengths
                if (matrix.access(ends - 1) != end_id).any():
                    raise ValueError(f"a document of {path} doesn't end with the end id")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(matrix.doc_ids, pa.int64()), "start": pa.array(begins + offset, pa.int64()), "n_tokens": pa.array(matrix.lengths.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    return shards.repartition(parts, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
