"""Chunking of parsed documents (one row each, with an array of blocks); no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import heading_prefix, section_path, word_tokens
from .tokenizers import bpe_cuts


def _windows(tokens: Column, size: int, stride: int) -> Column:
    """Slices of ``size`` tokens every ``stride``, up to the first that reaches the end."""
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(stride)))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * stride + 1, F.lit(size)))


def _exploded(df: DataFrame, key: str, chunks: Column, exploded: bool = True) -> DataFrame:
    """Rows of an array of {body, count, path, page_from, page_to}, numbered from 0; or, not exploded, its sums."""
    if not exploded:
        counts = F.transform(chunks, lambda c: F.coalesce(c["count"].cast("long"), F.lit(0).cast("long")))
        return df.select(key, F.size(chunks).cast("long").alias("n_chunks"), F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b).alias("total_tokens"))
    rows = df.select(key, F.posexplode(chunks).alias("chunk_no", "c"))
    content = F.concat(heading_prefix(F.col("c.path")), F.col("c.body"))
    return rows.select(
        key, "chunk_no", content.alias("content"), F.sha2(content, 256).alias("content_hash"), F.col("c.count").alias("token_count"),
        F.col("c.page_from").alias("page_from"), F.col("c.page_to").alias("page_to"), section_path(F.col("c.path")).alias("section_path"),
    )


def _chunk(body: Column, count: Column, path: Column, page_from: Column, page_to: Column) -> Column:
    return F.struct(body.alias("body"), count.alias("count"), path.alias("path"), page_from.alias("page_from"), page_to.alias("page_to"))


def _cut_words(text: Column, size: int, stride: int, keep_whole: bool, tokens: Column) -> Column:
    """Windows of a text's word ``tokens`` as {body, count}; those are a column or a lambda's variable, found once and not for each window."""
    n = F.size(tokens)
    parts = F.transform(_windows(tokens, size, stride), lambda w: F.struct(F.array_join(w, "").alias("body"), F.size(w).alias("count")))
    if keep_whole:
        return F.when(n <= size, F.array(F.struct(text.alias("body"), n.alias("count")))).otherwise(parts)
    return F.when(n > 0, parts).otherwise(F.array().cast("array<struct<body:string,count:int>>"))


def chunk_fixed(parsed: DataFrame, *, key="doc_id", max_tokens=DEFAULT.max_tokens, tokenizer="word", exploded=True) -> DataFrame:
    """All blocks joined by an empty line, cut every ``max_tokens``.

    Heading, section and first page come from the first block, the last page
    from the last block, on every chunk.  No tokens, no chunks.  ``tokenizer``
    is ``word`` or the path of a BPE rank file.
    """
    df = parsed.withColumn("text", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"))
    if tokenizer == "word":
        df = df.withColumn("tokens", word_tokens(F.col("text")))
    cuts = _cut_words(F.col("text"), max_tokens, max_tokens, False, F.col("tokens")) if tokenizer == "word" else bpe_cuts(F.array("text"), tokenizer, max_tokens, max_tokens, False)[0]
    df = df.withColumn("cuts", cuts)
    first, last = F.get("blocks", F.lit(0)), F.get("blocks", F.size("blocks") - 1)
    return _exploded(df, key, F.transform("cuts", lambda c: _chunk(c["body"], c["count"], first["heading_path"], first["page_no"], last["page_no"])), exploded)


def chunk_paragraph_overlap(parsed: DataFrame, *, key="doc_id", max_tokens=DEFAULT.max_tokens, overlap=DEFAULT.overlap, tokenizer="word", exploded=True) -> DataFrame:
    """Each block by itself: kept as it is up to ``max_tokens``, else cut in windows that share ``overlap`` tokens."""
    if overlap >= max_tokens:
        raise ValueError("overlap must be less than max_tokens")
    stride = max_tokens - overlap
    if tokenizer == "word":
        tokens = F.transform("blocks", lambda b: word_tokens(b["text"]))  # an argument, which is evaluated once, unlike what stands in the lambda
        cuts = F.transform(tokens, lambda t, i: _cut_words(F.get("blocks", i)["text"], max_tokens, stride, True, t))
    else:
        cuts = bpe_cuts(F.transform("blocks", lambda b: b["text"]), tokenizer, max_tokens, stride, True)
    df = parsed.withColumn("cuts", cuts)
    both = F.zip_with("blocks", "cuts", lambda b, some: F.transform(some, lambda c: _chunk(c["body"], c["count"], b["heading_path"], b["page_no"], b["page_no"])))
    return _exploded(df, key, F.flatten(both), exploded)


def chunk_paragraph(parsed: DataFrame, *, key="doc_id", max_tokens=DEFAULT.max_tokens, tokenizer="word", exploded=True) -> DataFrame:
    """Each block by itself, without overlap."""
    return chunk_paragraph_overlap(parsed, key=key, max_tokens=max_tokens, overlap=0, tokenizer=tokenizer, exploded=exploded)


STRATEGIES = {"FIXED_TOKEN": chunk_fixed, "PARAGRAPH": chunk_paragraph, "PARAGRAPH_OVERLAP": chunk_paragraph_overlap}


def chunk(parsed: DataFrame, strategy: str = DEFAULT.strategy, **how) -> DataFrame:
    return STRATEGIES[strategy](parsed, **how)


def guard_chunks(parsed: DataFrame, strategy: str = DEFAULT.strategy, *, key="doc_id", max_chunks=DEFAULT.max_chunks, max_total_tokens=DEFAULT.max_total_tokens, **how) -> DataFrame:
    """(key, n_chunks, total_tokens, error_code) for every document: none, too many chunks, too many tokens, in that order.

    Chunks are counted in the row that holds the blocks: nothing is exploded or
    shuffled, and each document is parsed once.
    """
    sums = chunk(parsed.withColumn("blocks", F.coalesce("blocks", F.array().cast(parsed.schema["blocks"].dataType))), strategy, key=key, exploded=False, **how)
    code = F.when(F.col("n_chunks") == 0, "EMPTY_EXTRACTION").when(F.col("n_chunks") > max_chunks, "CHUNK_LIMIT_EXCEEDED").when(F.col("total_tokens") > max_total_tokens, "TOTAL_TOKEN_LIMIT_EXCEEDED")
    return sums.withColumn("error_code", code)
