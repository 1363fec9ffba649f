"""Helpers that the operators of this subpackage share.

* ``shared_path`` / ``stage``: tables and files every executor can see.
* ``WORD``: the word pattern of the contracts, white space being ASCII's six.
* ``release``: what earlier tasks left in a reused worker goes.
* ``spans`` / ``word_hashes``: words of a batch of texts as numpy arrays,
  found and hashed without one Python object per word, by a key drawn for each call.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import secrets
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, the folder all executors share.

    A temporary folder is made only where that setting is absent and the master
    is local (one machine, as in tests); a cluster without it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quillmill-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of intermediate tables and answers that still stand; the driver's end deletes them.
_TEMPORARY: set[str] = set()


def temporary_path(spark: SparkSession, name: str) -> str:
    """A ``shared_path`` for what only this session needs: deleted by ``drop_path``, or when the driver ends."""
    path = shared_path(spark, name)
    _TEMPORARY.add(path)
    return path


def drop_path(path: str) -> None:
    """Delete an intermediate folder that nothing reads any more."""
    fs, where = open_fs(path)
    if fs.get_file_info(where).type == pafs.FileType.Directory:
        fs.delete_dir(where)
    _TEMPORARY.discard(path)


@atexit.register
def _drop_all() -> None:
    for path in list(_TEMPORARY):
        try:
            drop_path(path)
        except OSError:  # the store is gone already
            pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage and keeps costly rows from being made twice; a lost
    executor costs only its running tasks, as the files stay.
    """
    spark = df.sparkSession
    path = temporary_path(spark, name)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for frame in staged:
        drop_path(frame.staged_at)


def fresh(name: str, columns) -> str:
    """``name``, with as many underscores before it as make it none of ``columns`` (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` staged with a key of each row's own, ascending by id (null last), then by a digest of the row, and that column's name."""
    order = [F.col(id_col).asc_nulls_last(), F.xxhash64(*docs.columns).asc()]
    ranged = docs.repartitionByRange(2 * partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    row = fresh("__row", docs.columns)
    return stage(ranged.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a shared URI; bare paths are local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of this attempt, then rename: readers see all or nothing."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def read_file(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as src:
        return src.read()


#: What operators keep in a worker between tasks; emptied when another operator's task begins there.
KEPT: list[dict] = []


def release(keep: dict | None = None) -> None:
    """Empty the memories of other operators in this worker, then ``trim``."""
    for memory in KEPT:
        if memory is not keep:
            memory.clear()
    trim()


def trim() -> None:
    """Give freed pages back to the system; allocators keep hundreds of megabytes otherwise."""
    pa.default_memory_pool().release_unused()
    glibc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if glibc_trim:
        glibc_trim(0)


# --------------------------------------------------------------- numpy words

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The field of the word hash: residues modulo the Mersenne prime 2^61 - 1.
_PRIME = (1 << 61) - 1
#: Bytes hashed at a time: the powers and sums stay in the processor's cache, and 2^17 products below 2^40 add up to less than 2^64.
_STEP = 1 << 17
#: Key of hashes that must be the same in every session.
FIXED_KEY = 0x9E3779B97F4A7C55 % _PRIME


def new_key() -> int:
    """A key for ``word_hashes``, drawn on the driver for each run: words can't be constructed to collide under it."""
    return 1 << 32 | secrets.randbits(60)


_low32, _low29, _p = np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1), np.uint64(_PRIME)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _p) + (x >> np.uint64(61))
    return np.where(x >= _p, x - _p, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b in the field, from products of 32-bit halves; 2^61 counts as 1."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _low32, b >> np.uint64(32), b & _low32
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    return _reduced(a1 * b1 * np.uint64(8) + (middle >> np.uint64(29)) + ((middle & _low29) << np.uint64(32)) + (low & _p) + (low >> np.uint64(61)))


_powers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _tables(key: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low and high 32 bits of the key's powers 0 to n - 1, and the powers of its inverse; one key's are kept."""
    if key not in _powers or len(_powers[key][0]) < n:
        n = 1 << 12 if n <= 1 << 12 else _STEP + 1
        both = []
        for base in (key, pow(key, -1, _PRIME)):
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, _product(out, np.uint64(pow(base, len(out), _PRIME)))])
            both.append(out[:n])
        _powers.clear()
        _powers[key] = both[0] & _low32, both[0] >> np.uint64(32), both[1]
    return _powers[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and n+1 offsets; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def lowered(texts: pa.Array, composing: bool = False) -> pa.Array:
    """Large strings with A-Z folded and nulls empty.  (Arrow's own ascii_lower breaks some letters beyond ASCII.)

    With ``composing``, a letter right before a byte beyond ASCII stays as it
    is: it may compose with what follows in one case and not in the other.
    """
    raw, offsets = text_bytes(texts)
    low = _LOWER[raw]
    if composing:
        before = np.flatnonzero(raw[1:] > 127)
        low[before] = raw[before]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(low))


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word's index for each text (n+1 values)."""
    n = len(raw)
    word = ~_SPACE[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins, ends = word.copy(), word.copy()
    if n:
        begins[1:] &= ~word[:-1] | cut[1:n]
        ends[:-1] &= ~word[1:] | cut[1:n]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_hashes(texts: pa.Array, lower: bool, key: int = FIXED_KEY) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the first word's index for each text (n+1 values).

    Words are cut at ASCII white space; ``lower`` folds A-Z only.  A word is a
    polynomial over the field of 2^61 - 1 elements, taken at ``key``: equal words
    have equal hashes under one key, and two words of at most L bytes, however
    they were chosen, collide for at most L of its 2^60 values.  Words beyond
    ``_STEP`` bytes take xxh3 of their bytes, seeded by the key.
    """
    key %= _PRIME
    raw, offsets = text_bytes(texts)
    if lower:
        raw = _LOWER[raw]
    start, end, first = spans(raw, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), first
    h = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):  # whole words of about _STEP bytes; a longer word stands alone
        b = max(a + 1, int(np.searchsorted(end, start[a] + _STEP, "right")))
        at = start[a]
        if end[b - 1] - at > _STEP:
            h[a] = xxhash.xxh3_64_intdigest(raw[at : end[a]].tobytes(), key)
            a = b
            continue
        part = raw[at : end[b - 1]].astype(np.uint64) + np.uint64(1)
        low, high, inverse = _tables(key, len(part) + 1)
        total = np.zeros((2, len(part) + 1), np.uint64)
        np.cumsum(part * low[: len(part)], out=total[0, 1:])
        np.cumsum(part * high[: len(part)], out=total[1, 1:])
        from_, to = start[a:b] - at, end[a:b] - at
        lows, highs = total[0, to] - total[0, from_], total[1, to] - total[1, from_]
        value = _reduced((lows & _p) + (lows >> np.uint64(61)) + (highs >> np.uint64(29)) + ((highs & _low29) << np.uint64(32)))
        h[a:b] = _product(value, inverse[from_])
        a = b
    h += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(h), first


def slices(texts: pa.Array, most: int = 4 << 20):
    """(begin, end) row ranges of about ``most`` bytes; a longer text stands alone."""
    n = len(texts)
    if not n:
        return
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield at, to
        at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, length) one after the other."""
    lengths = lengths.astype(np.int64)
    out = np.cumsum(lengths)
    total = int(out[-1]) if len(out) else 0
    return np.repeat(starts.astype(np.int64) - (out - lengths), lengths) + np.arange(total)
