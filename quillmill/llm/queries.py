"""The registered queries ``opN_<name>`` over the driver's tables, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import centroids, cobuckets, fingerprints, jaccard, katz, licenses, media, mixing, substrings, toxicity, trie_bpe, url_filters, wavelet


TOKENIZER = "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_syncmers(spark, sf_dir):
    """Fingerprints of all ``documents`` and their edited texts, and their likeness to those and to the next document."""
    return fingerprints.fingerprint_neighbours(_documents(spark, sf_dir))


def op2_wavelet(spark, sf_dir):
    """Token ids of all ``documents`` through wavelet shards in a new folder, which stays: a digest of what is read back."""
    manifest = wavelet.write_shards(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return wavelet.read_shards(manifest)


def op7_trie_bpe(spark, sf_dir):
    """Ids and decoded texts of all ``documents``, as digests."""
    return trie_bpe.encode_decode(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op3_katz(spark, sf_dir):
    """Katz scores of all ``documents``, learnt from those not held out."""
    return katz.score(_documents(spark, sf_dir))


def op4_toxicity(spark, sf_dir):
    """Toxicity of all ``documents``, learnt from labels not held out."""
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % toxicity.OF == toxicity.HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_jaccard(spark, sf_dir):
    """Shingle sets, components and numbers of links of all ``documents``."""
    return jaccard.jaccard_components(_documents(spark, sf_dir), links=True)


def op8_substrings(spark, sf_dir):
    """Words that repeated passages take from all ``documents``."""
    return substrings.remove_repeats(_documents(spark, sf_dir))


def op9_media(spark, sf_dir):
    """All ``documents`` as images in archives in a new folder, which stays: digests and features of what is read back."""
    return media.describe(media.read_archives(spark, media.write_archives(_documents(spark, sf_dir))))


def op6_licenses(spark, sf_dir):
    """Licence phrases and notices in all ``documents``."""
    return licenses.scan_licenses(_documents(spark, sf_dir)).drop("spans")


def op10_mixing(spark, sf_dir):
    """What a mix to target weights takes of all ``documents``."""
    return mixing.mix(_documents(spark, sf_dir))


def op11_url_filters(spark, sf_dir):
    """Verdicts on all ``pages``, the model fitted on a bounded table of urls that a rule labels."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = url_filters.fit(url_filters.labelled_by_rules(pages))
    return url_filters.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op12_cobuckets(spark, sf_dir):
    """Final files of ``sales`` and ``sale_lines``, co-bucketed by sale in a new folder."""
    sales, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "sale_lines"))
    of_sales, of_lines = cobuckets.starting_numbers()
    return cobuckets.cobucket(sales, lines, key="sale_id", left_number=of_sales, right_number=of_lines, left_name="sales", right_name="sale_lines")


def op13_centroids(spark, sf_dir):
    """Clusters of all ``embeddings``."""
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries():
    return {
        "op1_syncmers": op1_syncmers,
        "op2_wavelet": op2_wavelet,
        "op7_trie_bpe": op7_trie_bpe,
        "op3_katz": op3_katz,
        "op4_toxicity": op4_toxicity,
        "op5_jaccard": op5_jaccard,
        "op8_substrings": op8_substrings,
        "op9_media": op9_media,
        "op6_licenses": op6_licenses,
        "op10_mixing": op10_mixing,
        "op11_url_filters": op11_url_filters,
        "op12_cobuckets": op12_cobuckets,
        "op13_centroids": op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard": jaccard.ORACLE_SQL, "op6_licenses": licenses.ORACLE_SQL, "op8_substrings": substrings.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL, "op13_centroids": centroids.ORACLE_SQL}
