"""Publishing chunks: upsert, trailing delete, completion, promotion, deletion and sweep, as table -> table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import is_blank


def upsert_chunks(current: DataFrame, incoming: DataFrame, documents: DataFrame, *, order: str | None = None) -> DataFrame:
    """``current`` with ``incoming`` in place of rows of the same (document_version_id, chunk_no); tenants come from ``documents``.

    Of incoming rows that repeat a key, one stays: the last by their column
    ``order``, as if written one after the other (nulls first); among equals, or without it, that of the
    greatest content.
    """
    first = [c for c in (order, "content", "content_hash") if c in incoming.columns]
    order = Window.partitionBy("document_version_id", "chunk_no").orderBy(*[F.col(c).desc_nulls_last() for c in first or ["document_id"]])
    incoming = incoming.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")
    tenants = documents.select(F.col("id").alias("document_id"), "tenant_id")
    rows = incoming.drop("tenant_id").join(tenants, "document_id")
    kept = current.join(rows.select("document_version_id", "chunk_no"), ["document_version_id", "chunk_no"], "left_anti")
    return kept.unionByName(rows.select(*current.columns))


def delete_trailing(chunks: DataFrame, published: DataFrame) -> DataFrame:
    """Without chunks beyond the last number just published for their version."""
    last = published.groupBy("document_version_id").agg(F.max("chunk_no").alias("__last"))
    return chunks.join(last, "document_version_id", "left").filter(F.col("__last").isNull() | (F.col("chunk_no") <= F.col("__last"))).select(*chunks.columns)


def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_version_id").agg(F.count("*").alias("n_chunks"))


def stored_count_check(chunks: DataFrame, published: DataFrame) -> DataFrame:
    """(document_version_id, expected, stored, ok) for every version just published."""
    want = published.groupBy("document_version_id").agg(F.count("*").alias("expected"))
    return want.join(count_chunks(chunks), "document_version_id", "left").select("document_version_id", "expected", F.coalesce("n_chunks", F.lit(0)).alias("stored"), (F.coalesce("n_chunks", F.lit(0)) == F.col("expected")).alias("ok"))


def publication_errors(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_version_id, error_code) for every version in ``incoming``: what forbids publishing it, null if nothing does.

    Before embedding, INVALID_EMBEDDING: chunk numbers must be 0..n-1, contents and hashes not blank.  Then
    IllegalStateException: all chunks of one document, and as many would be stored as
    are published: each number once, and a document to take the tenant from.
    """
    known = documents.select(F.col("id").alias("document_id"), F.lit(True).alias("__known"))
    n = F.count("*")
    blank = is_blank(F.col("content")) | (is_blank(F.col("content_hash")) if "content_hash" in incoming.columns else F.lit(False))
    odd = (F.min("chunk_no") != 0) | (F.max("chunk_no") != n - 1) | (F.count_distinct("chunk_no") != n) | F.bool_or(F.coalesce(blank, F.lit(True)))
    mixed = (F.count_distinct("document_id") > 1) | (F.count("__known") != n)
    rows = incoming.join(known, "document_id", "left")
    return rows.groupBy("document_version_id").agg(F.when(odd, "INVALID_EMBEDDING").when(mixed, "IllegalStateException").alias("error_code"))


def complete_versions(versions: DataFrame, published: DataFrame, now: Column) -> DataFrame:
    """Chunk count and time of the versions just published; their extracted metadata becomes null."""
    done = published.groupBy(F.col("document_version_id").alias("id"), "document_id").agg(F.count("*").cast("int").alias("__n"))
    rows = versions.join(done, ["id", "document_id"], "left")
    hit = F.col("__n").isNotNull()
    new = {"chunk_count": F.when(hit, F.col("__n")).otherwise(F.col("chunk_count")), "indexed_at": F.when(hit, now).otherwise(F.col("indexed_at"))}
    if "extracted_metadata" in versions.columns:
        new["extracted_metadata"] = F.when(~hit, F.col("extracted_metadata"))
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in versions.columns])


def promote(documents: DataFrame, versions: DataFrame, published: DataFrame) -> DataFrame:
    """The searchable version after publishing ``published`` (document_id, document_version_id).

    A candidate wins over the version in place only with a higher embedding
    version number; of equal ones the smallest id; deleted documents stay as they are.
    """
    v = versions.select(F.col("id").alias("__v"), F.col("document_id").alias("__d"), F.col("embedding_version_no").alias("__e"))
    best = published.select("document_id", "document_version_id").distinct().join(v, (F.col("document_version_id") == F.col("__v")) & (F.col("document_id") == F.col("__d")))
    best = best.groupBy(F.col("__d").alias("id")).agg(F.max(F.struct(F.col("__e"), (-F.col("__v")).alias("n"))).alias("__best"))
    now = versions.select(F.col("id").alias("searchable_version_id"), F.col("embedding_version_no").alias("__now"))
    rows = documents.join(best, "id", "left").join(now, "searchable_version_id", "left")
    hit = F.col("deleted_at").isNull() & F.col("__best").isNotNull() & (F.col("searchable_version_id").isNull() | (F.col("__now") < F.col("__best.__e")))
    new = {
        "searchable_version_id": F.when(hit, -F.col("__best.n")).otherwise(F.col("searchable_version_id")),
        "latest_embedding_version_no": F.when(hit, F.greatest("latest_embedding_version_no", F.col("__best.__e"))).otherwise(F.col("latest_embedding_version_no")),
    }
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in documents.columns])


def searchable_versions(documents: DataFrame, versions: DataFrame) -> DataFrame:
    v = versions.select(F.col("id").alias("searchable_version_id"), "embedding_version_no")
    return documents.join(v, "searchable_version_id").select(F.col("id").alias("document_id"), "embedding_version_no")


def delete_documents(chunks: DataFrame, document_ids: DataFrame) -> DataFrame:
    return chunks.join(document_ids.select("document_id"), "document_id", "left_anti")


def sweep_candidates(documents: DataFrame, chunks: DataFrame, limit: int = DEFAULT.sweep_limit) -> DataFrame:
    """Deleted documents that still have chunks, oldest deletion first, then least id."""
    left = documents.filter(F.col("deleted_at").isNotNull()).join(chunks.select(F.col("document_id").alias("id")), "id", "left_semi")
    return left.orderBy("deleted_at", "id").limit(limit).select(F.col("id").alias("document_id"), "deleted_at")


def embedding_error(vector: Column, dimensions: int) -> Column:
    """INVALID_EMBEDDING unless the vector has so many values, all finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNull() | (F.size(vector) != dimensions) | odd, "INVALID_EMBEDDING")


def join_embeddings(chunks: DataFrame, embeddings: DataFrame, now: Column) -> DataFrame:
    """Chunks with the vector of the same (document_version_id, chunk_no) and the time of embedding."""
    return chunks.join(embeddings.select("document_version_id", "chunk_no", "embedding"), ["document_version_id", "chunk_no"]).withColumn("embedded_at", now)


def audit_searchable(documents: DataFrame, jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks stored for every searchable version that has a completed job."""
    done = jobs.filter("status = 'COMPLETED'").select(F.col("document_version_id").alias("searchable_version_id")).distinct()
    sums = count_chunks(chunks).withColumnRenamed("document_version_id", "searchable_version_id")
    rows = documents.join(done, "searchable_version_id").join(sums, "searchable_version_id", "left")
    return rows.select(F.col("id").alias("document_id"), "searchable_version_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def audit_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n_jobs"))
