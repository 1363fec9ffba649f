"""Byte-level BPE tokens in Arrow batches; ``rank_file`` lists base64 tokens with their ranks."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the pre-tokenizer pattern published with the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict = {}


def encoding(rank_file: str):
    """The rank file's encoding, loaded once for each worker."""
    if rank_file not in _loaded:
        import tiktoken

        with open(rank_file, "rb") as src:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in src if line.strip())}
        _loaded[rank_file] = tiktoken.Encoding(rank_file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[rank_file]


def bpe_ids(text: Column, rank_file: str) -> Column:
    """Token ids of a text; special tokens' strings are ordinary text."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else encoding(rank_file).encode_ordinary(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


CUTS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("body", T.StringType()), T.StructField("count", T.IntegerType())])))


def bpe_cuts(texts: Column, rank_file: str, size: int, stride: int, keep_whole: bool) -> Column:
    """For each text of an array, its windows of ``size`` ids every ``stride``, decoded, with their numbers of ids.

    A cut inside a character decodes to the replacement character.  With
    ``keep_whole`` a text of at most ``size`` ids stays as it is.
    """

    @F.arrow_udf(CUTS)
    def cuts(column: pa.Array) -> pa.Array:
        enc, out = encoding(rank_file), []
        for some in column.to_pylist():
            row = []
            for text in some or []:
                ids = enc.encode_ordinary(text or "")
                if keep_whole and len(ids) <= size:
                    row.append([{"body": text, "count": len(ids)}])
                    continue
                last = max(0, -(-(len(ids) - size) // stride))
                row.append([{"body": enc.decode(w), "count": len(w)} for w in (ids[i * stride : i * stride + size] for i in range(last + 1)) if w])
            out.append(row)
        return pa.array(out, pa.list_(pa.list_(pa.struct([("body", pa.string()), ("count", pa.int32())]))))

    return cuts(texts)
