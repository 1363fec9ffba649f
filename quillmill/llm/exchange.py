"""Questions about the whole corpus, asked by blocks of text and answered by hash buckets.

A block is a run of rows of one file range holding about ``BLOCK_BYTES`` of text.
Its identity comes from the file, the range and the run's number, so a block
holds the same rows whenever the table is read, by whichever task.  An operator

1. ``ask``s: each block sends every bucket one packed array of the distinct
   hashes it holds there (plus counts and the like), already combined;
2. ``answer``s: a bucket sees all blocks' arrays, merges them and returns an
   array for each block, in the order of its question;
3. ``deliver``s: each block's answers become one file in the shared folder,
   which the next pass over the text opens by the block's identity.

So a hash met in every row still costs a bucket one entry for each block, and
text is never shuffled.  A block sends a bucket one row at most, and in all at most
one row for each distinct hash it holds; its work doesn't grow with the number of
buckets.  Every row asked is answered: a block that finds no file, or a file
without the answer of a bucket it asked, raises, so that a lost answer is never
taken for an empty one.  Rows of block -1 are for the driver: bounded statistics,
which ``deliver`` hands back as a small table.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, drop_path, partitions, read_file, release, stage, temporary_path, trim, write_file

BLOCK_BYTES = 4 << 20
#: Bytes of text for each bucket, about.
BUCKET_BYTES = 24 << 20
#: Kind of a row in which a block lists the buckets it asked; its answer has bucket -1.
MANIFEST = 6
ROWS = "kind int, block long, bucket int, payload binary, a long, b long"


# ------------------------------------------------------------------ packing

def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one zstd of their byte planes, each less its minimum; sorted ones as steps."""
    heads, planes = [], []
    for array in arrays:
        x = array if array.dtype == np.uint64 else array.astype(np.uint64)
        steps, low = False, 0
        if len(x):
            steps = len(x) > 1 and bool((x[1:] >= x[:-1]).all())
            low = int(x[0] if steps else x.min())
            if steps:
                x = np.diff(x, prepend=x[:1])
            elif low:
                x = x - np.uint64(low)
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        heads.append(struct.pack("<QQBB", len(x), low, steps, width))
        planes += [x.astype(np.uint8) if i == 0 else (x >> np.uint64(8 * i)).astype(np.uint8) for i in range(width)]
    data = zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes()) if planes else b""
    return b"".join([bytes([len(arrays)]), *heads, data])


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``, as uint64."""
    at, out, heads = 1 + 18 * blob[0], [], [struct.unpack_from("<QQBB", blob, 1 + 18 * i) for i in range(blob[0])]
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at:]), np.uint8) if at < len(blob) else np.zeros(0, np.uint8)
    at = 0
    for n, low, steps, width in heads:
        x = data[at : at + n].astype(np.uint64) if width else np.zeros(n, np.uint64)
        for i in range(1, width):
            x |= data[at + i * n : at + (i + 1) * n].astype(np.uint64) << np.uint64(8 * i)
        at += n * width
        if steps:
            np.cumsum(x, out=x)
        if low:
            x += np.uint64(low)
        out.append(x)
    return out


# ------------------------------------------------------------------- blocks

def in_blocks(docs: DataFrame, id_col: str, text_col: str, carried=None) -> DataFrame:
    """file, at, doc_id, text (and the column ``carried``).  What isn't read straight from files is staged first.

    Splits of small tables depend on the cores there are when a pass begins.
    The session's ``spark.sql.files.minPartitionNum`` is therefore fixed where it
    is unset: an executor lost between two passes must not move the blocks.
    """
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:
        conf.set("spark.sql.files.minPartitionNum", docs.sparkSession.sparkContext.defaultParallelism)
    nodes = docs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    plain = all(line.lstrip(" +-:").split(" ")[0] in ("Project", "Filter", "Relation", "RelationV2") for line in nodes)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([] if carried is None else [carried.alias("carried")]))
    if not plain or len([x for x in nodes if "Relation" in x]) != 1 or not docs.inputFiles():
        base = stage(base, "blocks")
    return base.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), *base.columns[2:])


def blocks(batches, most: int = BLOCK_BYTES, more: tuple[str, ...] = ()):
    """(block id, doc_id array, text array, and arrays of the columns ``more``) for each block of a task's batches."""
    release()
    held: list[pa.RecordBatch] = []
    size, number, origin = 0, 0, None

    def close():
        table = pa.Table.from_batches(held).combine_chunks()
        name = f"{origin[0]}:{origin[1]}:{number}"
        texts = table.column("text").cast(pa.large_string()).combine_chunks()
        rest = [table.column(c).combine_chunks() for c in ("doc_id", *more)]
        texts, ids, *rest = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (texts, *rest))
        return xxhash.xxh64_intdigest(name.encode()) >> 1, ids, texts, *rest

    for batch in batches:
        if not batch.num_rows:
            continue
        files, ats = batch.column("file").dictionary_encode(), batch.column("at").to_numpy(zero_copy_only=False)
        code = files.indices.to_numpy()
        edges = np.flatnonzero((code[1:] != code[:-1]) | (ats[1:] != ats[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            here = (files.dictionary[int(code[a])].as_py(), int(ats[a]))
            if here != origin:
                if held:
                    yield close()
                held, size, number, origin = [], 0, 0, here
            import pyarrow.compute as pc

            total = np.cumsum(pc.binary_length(batch.column("text").slice(a, b - a)).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < b - a:
                base = total[begin - 1] if begin else 0
                end = int(np.searchsorted(total, base + most - size, "left")) + 1
                full, end = end <= b - a, min(end, b - a)
                held.append(batch.slice(a + begin, end - begin))
                size += int(total[end - 1] - base)
                begin = end
                if full:
                    yield close()
                    held, size, number = [], 0, number + 1
                    trim()
    if held:
        yield close()
    release()


def row_batch(rows: list[tuple]) -> pa.RecordBatch:
    """(kind, block, bucket, payload, a, b) rows as one batch."""
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "block", "bucket", "payload", "a", "b"])


def text_buckets(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """How many buckets the texts ask for, and their bytes."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(partitions(docs.sparkSession), size // BUCKET_BYTES), size


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each 64-bit hash: one of n ranges of like width."""
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def runs_of(buckets: np.ndarray):
    """(bucket, begin, end) for each run of equal values in sorted ``buckets``."""
    at = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
    return zip(buckets[at].tolist(), at.tolist(), [*at[1:].tolist(), len(buckets)])


def ask(source: DataFrame, questions) -> DataFrame:
    """``questions(block, doc ids, texts)`` gives rows of ``ROWS`` for a block."""

    def work(batches):
        for block, ids, texts in blocks(batches):
            rows = questions(block, ids, texts)
            if rows:
                yield row_batch(rows)

    return source.mapInArrow(work, ROWS)


def _grouped(batches, key: str):
    """Rows of sorted batches, key by key."""
    release()
    now, rows = None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("kind", "block", "bucket", "payload", "a", "b")]):
            k = row[1] if key == "block" else row[2]
            if rows and k != now:
                yield now, rows
                rows = []
            now = k
            rows.append(row)
    if rows:
        yield now, rows
    release()


def answer(asked: DataFrame, merge, n: int) -> DataFrame:
    """``merge(bucket, rows)`` gives rows of ``ROWS``; it sees all rows of a bucket, by block."""

    def work(batches):
        for bucket, rows in _grouped(batches, "bucket"):
            out = merge(bucket, rows)
            if out:
                yield row_batch(out)

    return asked.repartition(n, "bucket").sortWithinPartitions("bucket", "block", "kind").mapInArrow(work, ROWS)


class Answers:
    """Where blocks' answers lie, and the driver's rows as a small staged table."""

    def __init__(self, folder: str, stats: DataFrame):
        self.folder, self.stats = folder, stats

    def drop(self) -> None:
        """Delete both; nothing may read them any more."""
        drop_path(self.folder)
        discard(self.stats)


def deliver(answers: DataFrame, name: str) -> Answers:
    """One file for each block that asked; rows of block -1 go into ``stats``."""
    spark = answers.sparkSession
    folder = temporary_path(spark, name)

    def work(batches):
        for block, rows in _grouped(batches, "block"):
            if block < 0:
                yield row_batch(rows)
                continue
            data = b"".join(struct.pack("<iQ", r[2], len(r[3])) + r[3] for r in rows)
            write_file(f"{folder}/{block:016x}", data)

    spread = F.when(F.col("block") < 0, F.col("bucket"))  # the driver's rows don't all go to one task
    many = answers.select("kind", "block", "bucket", "payload", "a", "b").repartition(partitions(spark), "block", spread).sortWithinPartitions("block", "bucket")
    return Answers(folder, stage(many.mapInArrow(work, ROWS), f"{name}-stats"))


def delivered(folder: str, block: int, asked=None) -> dict[int, bytes]:
    """A block's answers by bucket; raises unless they are those of the buckets ``asked``, or of its manifest."""
    if asked is not None and not len(asked):
        return {}
    data = read_file(f"{folder}/{block:016x}")
    at, out = 0, {}
    while at < len(data):
        bucket, size = struct.unpack_from("<iQ", data, at)
        at += 12 + size
        out[bucket] = data[at - size : at]
    if asked is None:
        asked = unpack(out.pop(-1))[0].tolist()
    if set(out) != set(asked):
        raise RuntimeError(f"block {block:016x} asked {len(asked)} buckets and has answers of {len(out)}: its rows aren't those of the pass that asked")
    return out
