"""Corpus pipeline: five stages over ``documents``, each written and read again before the next.

toxicity      rejected documents go
jaccard       of each group of near copies the row with the least id stays
substrings    words of passages that begin in an earlier document go
mixing        rows are taken by source, to target weights: complete epochs, then in part
encoding      token ids, their number and digests, and the digest of what decodes

All stages but the last return the columns of ``documents``; ``n_chars`` is kept
true where a text changes.  SQL can't express the toxicity stage, so ORACLE_SQL
is None; tests/llm/test_pipeline_rows.py holds the stages against brute force.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from quillmill.llm import jaccard, mixing, substrings, toxicity, trie_bpe
from quillmill.llm._shared import fresh, numbered, stage

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model fitted on ``labels`` and these documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh("toxic", docs.columns)
    return toxicity.score(docs, model, score_col=score).filter(F.col(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the Jaccard join, the one with the least id (null last); each row is a document."""
    rows, row = numbered(docs, "doc_id")
    gone = fresh("gone", rows.columns)
    found = jaccard.jaccard_components(rows, id_col=row).filter("component_id <> doc_id").select(F.col("doc_id").alias(gone))
    return rows.join(found, rows[row] == found[gone], "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated passages; a text that loses nothing keeps its white space."""
    removed = fresh("removed", docs.columns)
    kept = substrings.without_repeats(docs, removed_col=removed)
    n_chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, as often as it takes them."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return trie_bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_near_copies), ("substrings", drop_repeats), ("mixing", mix), ("encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
