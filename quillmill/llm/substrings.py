"""Substring dedup by prefix-partitioned suffix trees.

Every word position begins a suffix; only its first 13 words matter, so the tree is
cut off at that depth.  An inner node there is a repeat.

1. A filter: blocks send the leading bits of a hash of each distinct suffix (as
   many bits as the corpus asks for, some 1 in 128 clash), and learn which may
   begin in two documents.  The others can't lie below a deep inner node and go
   no further.  The same pass samples prefixes.
2. The sample's shortest telling prefixes, of as many words as it takes, split the
   rest into memory-sized groups.  A block sends each group its suffixes there, as
   words in order, with the least document of each.
3. A group merges its blocks' sorted suffixes into its subtree: leaves side by side
   whose words agree in full lie below one node at full depth.  Each leaf learns
   the least document below its node.  Words are compared, not hashes.
4. In each document, suffixes side by side that lie below such nodes, with a
   smaller document there, chain up to the maximal repeats, whose words go.

Within one block of some megabytes, suffixes are told apart by 64-bit hashes
under a key drawn for the run.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left, bisect_right
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import fresh, mix64, new_key, ragged, spans, text_bytes, word_hashes
from .exchange import BLOCK_BYTES, MANIFEST, answer, ask, blocks, bucket_of, deliver, delivered, in_blocks, pack, runs_of, text_buckets, unpack

WINDOW = 13
#: Groups for each bucket of the filter: a group's suffixes take much more room as words.
SPLIT = 4
#: Prefixes sampled for each group, and in all at most (the driver sorts them).
SAMPLED, SAMPLE_MOST = 16, 1_000_000
_LAST = (1 << 63) - 1
_SHIFT = np.uint64(1 << 63)


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as sortable uint64, null after all others."""
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _SHIFT


def leaves(texts: pa.Array, window: int, key: int):
    """Path hash at depth ``window`` and text number of every suffix with so many words, its word, and each text's first word."""
    h, first = word_hashes(texts, lower=False, key=key)
    counts = np.maximum(np.diff(first) - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(len(text))
    path = np.zeros(max(0, len(h) - window + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(window):
            path = path * np.uint64(0x9FB21C651E98DF25) + h[j : j + len(path)]
        path = mix64(path[start]) if len(start) else np.zeros(0, np.uint64)
    return path, text, start, first


def nodes(path: np.ndarray, owner: np.ndarray):
    """Distinct paths sorted, the least and the greatest owner of each, every leaf's place among them, and a leaf of each."""
    order = np.argsort(path, kind="stable")
    p = path[order]
    new = np.ones(len(p), bool)
    new[1:] = p[1:] != p[:-1]
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[order], at) if len(at) else owner[:0]
    most = np.maximum.reduceat(owner[order], at) if len(at) else owner[:0]
    place = np.empty(len(p), np.int64)
    place[order] = np.cumsum(new) - 1
    return p[at], least, most, place, order[at]


class Words:
    """The words of a batch of texts one after the other, a space after each, and where each begins."""

    def __init__(self, texts: pa.Array):
        raw, offsets = text_bytes(texts)
        start, end, _ = spans(raw, offsets)
        length = end - start + 1
        joined = np.append(raw, np.uint8(32))[ragged(start, length)] if len(start) else np.zeros(0, np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(length)])
        joined[self.begin[1:] - 1] = 32
        self.data = joined.tobytes()

    def suffixes(self, words: np.ndarray, depth: int) -> list[bytes]:
        """The ``depth`` words from each of ``words`` on."""
        data = self.data
        return [data[a:b] for a, b in zip(self.begin[words].tolist(), (self.begin[words + depth] - 1).tolist())]


def shared_words(a: bytes, b: bytes) -> int:
    """How many words two suffixes share from their beginning: the depth of the node where they part."""
    n = 0
    for x, y in zip(a.split(b" "), b.split(b" ")):
        if x != y:
            break
        n += 1
    return n


def separators(sample: list[bytes], groups: int) -> list[bytes]:
    """At most ``groups`` - 1 prefixes that split a sorted sample evenly, each with no more words than tell it from the one before it."""
    out: list[bytes] = []
    for i in range(1, groups):
        at = i * len(sample) // groups
        if at and sample[at] != sample[at - 1]:
            low = sample[at].split(b" ")
            cut = b" ".join(low[: shared_words(sample[at - 1], sample[at]) + 1])
            if not out or cut > out[-1]:
                out.append(cut)
    return out


def group_of(sorted_suffixes: list[bytes], cuts: list[bytes]):
    """(group, begin, end) for each group that holds some of the suffixes."""
    if len(cuts) < len(sorted_suffixes):
        edges = [0, *(bisect_left(sorted_suffixes, c) for c in cuts), len(sorted_suffixes)]
        return [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
    return list(runs_of(np.array([bisect_right(cuts, x) for x in sorted_suffixes], np.int64)))


def _packed(suffixes: list[bytes], *arrays: np.ndarray) -> bytes:
    words = zstandard.ZstdCompressor(level=3).compress(b"\n".join(suffixes))
    return struct.pack("<Q", len(words)) + words + pack(*arrays)


def _unpacked(blob: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    (size,) = struct.unpack_from("<Q", blob)
    return zstandard.ZstdDecompressor().decompress(blob[8 : 8 + size]).split(b"\n"), unpack(blob[8 + size :])


def deep_nodes(parts: list[tuple[list[bytes], np.ndarray]]) -> list[np.ndarray]:
    """For each part, (its sorted suffixes, their least owners): the least owner below each suffix's node at full depth.

    The leaves of all parts in order are the subtree's, from left to right; those
    that agree in full lie side by side below one node.
    """
    every = [x for part, _ in parts for x in part]
    order = sorted(range(len(every)), key=every.__getitem__)  # merges the parts' runs
    new = np.ones(len(every), bool)
    new[1:] = [every[a] != every[b] for a, b in zip(order, order[1:])]
    owner = np.concatenate([o for _, o in parts])
    order = np.array(order)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(new))
    told = np.empty(len(every), np.uint64)
    told[order] = least[np.cumsum(new) - 1]
    return np.split(told, np.cumsum([len(x) for x, _ in parts])[:-1])


def _subtrees(source: DataFrame, window: int, key: int):
    """Answers of the subtrees' groups to each block: places among its distinct suffixes, and the smaller document of each."""
    n, size = text_buckets(source, "text")
    bits = min(64, max(32, int(size // 4).bit_length() + 7))
    shift = np.uint64(64 - bits)
    groups = SPLIT * n
    # Each block samples about so many prefixes; with very many blocks, only some blocks do.
    each = max(1, SAMPLED * groups * BLOCK_BYTES // max(size, 1)) if SAMPLED * groups <= SAMPLE_MOST else 1
    one_in = max(1, size // BLOCK_BYTES * each // SAMPLE_MOST)

    def suspects(block, ids, texts):
        path, text, start, _ = leaves(texts, window, key)
        if not len(path):
            return []
        owner = ids_of(ids)[text]
        p, least, most, _, leaf = nodes(path, owner)
        rows = []
        if block % one_in == 0:
            some = start[leaf[:: max(1, len(leaf) // each)][:each]]
            rows.append((5, -1, int(bucket_of(p[:1], n)[0]), _packed(Words(texts).suffixes(some, window)), 0, 0))
        low = p >> shift
        return rows + [(0, block, i, pack(low[a:b], np.flatnonzero(least[a:b] != most[a:b])), 0, 0) for i, a, b in runs_of(bucket_of(p, n))]

    def judge(bucket, rows):
        """Which of its suffixes may begin in two documents, as bits for each block."""
        out = [r for r in rows if r[0] == 5]
        asked = [(r[1], *unpack(r[3])) for r in rows if r[0] == 0]
        if not asked:
            return out
        values, place, count = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True, return_counts=True)
        at = 0
        for _, low, twice in asked:
            count[place[at + twice.astype(np.int64)]] = 2
            at += len(low)
        often, at = count[place] > 1, 0
        for block, low, _ in asked:
            out.append((0, block, bucket, pack(np.packbits(often[at : at + len(low)])), 0, 0))
            at += len(low)
        return out

    filtered = deliver(answer(ask(source, suspects), judge, n), "suspects")
    folder = filtered.folder
    sample = sorted(x for r in filtered.stats.toLocalIterator() for x in _unpacked(r["payload"])[0])
    cuts = source.sparkSession.sparkContext.broadcast(separators(sample, groups))

    def suffixes(block, ids, texts):
        path, text, start, _ = leaves(texts, window, key)
        if not len(path):
            return []
        p, least, _, _, leaf = nodes(path, ids_of(ids)[text])
        runs = list(runs_of(bucket_of(p, n)))
        told, kept = delivered(folder, block, [i for i, _, _ in runs]), np.zeros(len(p), bool)
        for i, a, b in runs:
            kept[a:b] = np.unpackbits(unpack(told[i])[0].astype(np.uint8), count=b - a)
        at = np.flatnonzero(kept)
        words = Words(texts).suffixes(start[leaf[at]], window)
        order = sorted(range(len(words)), key=words.__getitem__)
        words = [words[i] for i in order]
        at = at[order]
        rows = [(0, block, i, _packed(words[a:b], at[a:b].astype(np.uint64), least[at[a:b]]), 0, 0) for i, a, b in group_of(words, cuts.value)]
        return [*rows, (MANIFEST, block, block % groups, pack(np.array([r[2] for r in rows], np.uint64)), 0, 0)]

    def subtree(group, rows):
        out = [(r[0], r[1], -1, r[3], 0, 0) for r in rows if r[0] == MANIFEST]
        rows = [r for r in rows if r[0] == 0]
        if not rows:
            return out
        parts = [_unpacked(r[3]) for r in rows]
        for row, (_, (at, mine)), least in zip(rows, parts, deep_nodes([(words, own) for words, (_, own) in parts])):
            less = least < mine
            out.append((0, row[1], group, pack(at[less], least[less]), 0, 0))
        return out

    found = deliver(answer(ask(source, suffixes), subtree, n), "repeats")
    filtered.drop()
    return found


def _removed(block: int, ids: pa.Array, texts: pa.Array, folder: str, window: int, key: int):
    """Each text's words, words removed and runs of them; and each word's mark of removal with each text's first word."""
    path, text, start, first = leaves(texts, window, key)
    own = ids_of(ids)
    p, least, _, place, _ = nodes(path, own[text])
    least = least.copy()
    for blob in delivered(folder, block).values() if len(p) else ():
        at, told = unpack(blob)
        least[at.astype(np.int64)] = told
    hit = least[place] < own[text] if len(path) else np.zeros(0, bool)
    words = int(first[-1])
    depth = np.bincount(start[hit], minlength=words + 1) - np.bincount(start[hit] + window, minlength=words + 1)
    gone = np.cumsum(depth[:words]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    begins[first[:-1][np.diff(first) > 0]] = gone[first[:-1][np.diff(first) > 0]]  # a text's runs end with it
    sums, runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
    removed = sums[first[1:]] - sums[first[:-1]]
    return np.diff(first).astype(np.int64), removed.astype(np.int64), (runs[first[1:]] - runs[first[:-1]]).astype(np.int64), gone, begins, first


def _kept(data: str, gone: np.ndarray) -> bytes:
    words = data.encode().split()
    return b" ".join(compress(words, (~gone).tolist()) if gone.any() else words)


def _spans(gone: np.ndarray, begins: np.ndarray) -> list[dict]:
    at = np.flatnonzero(begins)
    length = np.add.reduceat(gone, at) if len(at) else at
    return [{"start": a, "words": n} for a, n in zip(at.tolist(), length.tolist())]


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", window: int = WINDOW, texts_out: bool = False, spans_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and n_repeats for each row; ``kept`` too with ``texts_out``.

    A word goes if some window of ``window`` words over it also starts in a
    document with a smaller id.  Windows are those of the input.  ``n_repeats``
    counts the maximal repeats, and ``spans_out`` gives them as ``repeats``, an
    array of {start, words}.  Null and empty texts have no words; their kept text
    is empty.  Rows with one id never shorten each other; null ids come after
    all others.  Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    source, key = in_blocks(docs, id_col, text_col), new_key()
    folder = _subtrees(source, window, key).folder
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_repeats long" + ", kept string" * texts_out + ", repeats array<struct<start:long,words:long>>" * spans_out

    def work(batches):
        for block, ids, texts in blocks(batches):
            words, removed, repeats, gone, begins, first = _removed(block, ids, texts, folder, window, key)
            kept = [_kept(data, gone[a:b]) for data, a, b in zip(texts.to_pylist(), first, first[1:])]
            arrays = [ids, pa.array(words), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(repeats)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_repeats"]
            if texts_out:
                arrays, names = [*arrays, pa.array([x.decode() for x in kept], pa.string())], [*names, "kept"]
            if spans_out:
                spans_ = pa.array([_spans(gone[a:b], begins[a:b]) for a, b in zip(first, first[1:])], pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])))
                arrays, names = [*arrays, spans_], [*names, "repeats"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(work, schema)


def without_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", removed_col="n_removed", window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with the words that ``remove_repeats`` removes gone from its text, and their number as ``removed_col``.

    A text that loses nothing stays as it is, white space and null too.  Rows
    go through one by one, so repeated and null ids don't matter to which text
    a row gets.  ``removed_col`` must be a new name.
    """
    if removed_col in docs.columns:
        raise ValueError(f"{removed_col} is a column already")
    key = new_key()
    others = [c for c in docs.columns if c != text_col]
    null = fresh("is_null", others)
    source = in_blocks(docs, id_col, text_col, F.struct(*others, F.col(text_col).isNull().alias(null)))
    folder = _subtrees(source.drop("carried"), window, key).folder
    carried = source.schema["carried"].dataType
    schema = StructType().add("text", "string").add("removed", "long").add("carried", carried)

    def work(batches):
        for block, ids, texts, rest in blocks(batches, more=("carried",)):
            _, removed, _, gone, _, first = _removed(block, ids, texts, folder, window, key)
            out = [_kept(data, gone[a:b]).decode() if x else data for data, x, a, b in zip(texts.to_pylist(), removed, first, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(removed), rest], names=["text", "removed", "carried"])

    rows = source.mapInArrow(work, schema)
    text = F.when(~F.col("carried").getField(null), F.col("text"))
    return rows.select(*[(text if c == text_col else F.col("carried").getField(c)).alias(c) for c in docs.columns], F.col("removed").alias(removed_col))


#: DuckDB SQL of the whole: kept words need arrays of words, so it's for small tables.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), least_doc AS (
  SELECT g, min(doc_id) AS first_doc FROM win GROUP BY g HAVING count(DISTINCT doc_id) > 1
), hit AS (
  SELECT DISTINCT win.doc_id, i + k AS pos FROM win JOIN least_doc USING (g), range(0, 13) t(k) WHERE first_doc < win.doc_id
), gone AS (
  SELECT doc_id, list(pos) AS ats, count(*) AS n_removed, sum(CASE WHEN before IS NULL OR before < pos - 1 THEN 1 ELSE 0 END)::BIGINT AS n_repeats
  FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM hit) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ats IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ats, i)) END, ' '), '')) AS kept_sha256,
  coalesce(n_repeats, 0)::BIGINT AS n_repeats
FROM w LEFT JOIN gone USING (doc_id)
"""
