"""Events: decoding, routing and the validation cascade, errors as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..errors import first_error
from ..functions.text import trim

EVENT = "eventId string, eventType string, schemaVersion int, tenantId long, documentId long, documentVersionId long, occurredAt timestamp, traceId string"


def trace_id(headers: Column) -> Column:
    """The last ``traceId`` header as text; blank is null."""
    found = F.filter(headers, lambda h: h["key"] == "traceId")
    return F.when(F.size(found) > 0, F.nullif(trim(F.element_at(found, -1)["value"].cast("string")), F.lit("")))


def decode_events(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decoded, corrupt) from Kafka-shaped rows: topic, partition, offset, key, value and, if there, headers.

    A value that isn't the event's JSON, or lacks one of its required fields, is
    corrupt; the header's trace id overrides the payload's.
    """
    e = F.from_json(F.col("value").cast("string"), EVENT)
    rows = records.withColumn("e", e)
    needed = ["eventId", "eventType", "schemaVersion", "tenantId", "documentId", "occurredAt"]
    good = F.col("e").isNotNull()
    for name in needed:
        good = good & F.col(f"e.{name}").isNotNull()
    header = trace_id(F.col("headers")) if "headers" in records.columns else F.lit(None).cast("string")
    decoded = rows.filter(good).select(
        F.col("e.eventId").alias("source_event_id"), F.col("e.eventType").alias("event_type"), F.col("e.schemaVersion").alias("schema_version"), F.col("e.tenantId").alias("tenant_id"),
        F.col("e.documentId").alias("document_id"), F.col("e.documentVersionId").alias("document_version_id"), F.col("e.occurredAt").alias("occurred_at"), F.coalesce(header, F.col("e.traceId")).alias("trace_id"),
        F.col("topic").alias("kafka_topic"), F.col("partition").cast("int").alias("kafka_partition"), F.col("offset").cast("long").alias("kafka_offset"),
    )
    return decoded, rows.filter(~good | good.isNull()).drop("e")


def route(event_type: Column, version_id: Column) -> Column:
    """index, drop (an index request without a version), delete or unknown."""
    return F.when((event_type == "INDEXING_REQUESTED") & version_id.isNull(), "drop").when(event_type == "INDEXING_REQUESTED", "index").when(event_type == "DOCUMENT_DELETED", "delete").otherwise("unknown")


def ordered_rounds(events: DataFrame) -> DataFrame:
    """Index requests and deletions with ``round``, from 1 for each document: run one round after the other, they take effect as in order of their offsets.

    Records of one round don't depend on each other: a deletion has a round of
    its own among its document's, and requests share one only for different
    versions.  A document's rounds are as many as its longest chain of such
    records; other documents' run beside them.
    """
    kind = route(F.col("event_type"), F.col("document_version_id"))
    place = ["kafka_offset", "kafka_partition"]
    rows = events.withColumn("__delete", (kind == "delete").cast("int")).filter(kind.isin("index", "delete"))
    before = F.sum("__delete").over(Window.partitionBy("document_id").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__part", 2 * F.coalesce(before, F.lit(0)) + F.col("__delete"))
    nth = F.row_number().over(Window.partitionBy("document_id", "__part", "document_version_id").orderBy(*place))
    rows = rows.withColumn("__nth", F.when(F.col("__delete") == 1, 1).otherwise(nth))
    rank = F.dense_rank().over(Window.partitionBy("document_id").orderBy("__part", "__nth"))
    return rows.withColumn("round", rank).drop("__delete", "__part", "__nth")


def dedup_events(events: DataFrame) -> DataFrame:
    """``verdict``: NEW for an event's first record by (partition, offset), DUPLICATE for another one of it."""
    first = Window.partitionBy("source_event_id").orderBy("kafka_offset", "kafka_partition")
    return events.withColumn("verdict", F.when(F.row_number().over(first) == 1, "NEW").otherwise("DUPLICATE"))


def _known(events: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    v = versions.select(F.col("id").alias("v_id"), F.col("document_id").alias("v_document_id"), "file_size", "content_hash", "mime_type")
    d = documents.select(F.col("id").alias("d_id"), F.col("tenant_id").alias("d_tenant_id"))
    return events.join(v, F.col("document_version_id") == F.col("v_id"), "left").join(d, F.col("document_id") == F.col("d_id"), "left")


def validate_events(events: DataFrame, versions: DataFrame, documents: DataFrame, *, config=DEFAULT, actual_hash: Column | None = None, mime_types=None) -> DataFrame:
    """Index requests with ``error_code``, the first failure in stage order, null if none.

    ``actual_hash`` and ``mime_types`` add the checks of the stages after the
    download; rows rejected before never need the source's content.
    """
    checks = [
        (~F.col("schema_version").isin(list(config.schema_versions)), "UNSUPPORTED_SCHEMA_VERSION"),
        (F.col("v_id").isNull(), "DOCUMENT_VERSION_NOT_FOUND"),
        (F.col("v_document_id") != F.col("document_id"), "DOCUMENT_MISMATCH"),
        (F.col("d_id").isNull(), "DOCUMENT_NOT_FOUND"),
        (F.col("d_tenant_id") != F.col("tenant_id"), "TENANT_MISMATCH"),
        (F.col("file_size") > config.max_file_bytes, "FILE_TOO_LARGE"),
    ]
    if actual_hash is not None:
        checks.append((actual_hash != F.col("content_hash"), "HASH_MISMATCH"))
    if mime_types is not None:
        checks.append((~F.col("mime_type").isin(list(mime_types)) | F.col("mime_type").isNull(), "UNSUPPORTED_MIME_TYPE"))
    return _known(events, versions, documents).withColumn("error_code", first_error(*checks))


def validate_deletions(events: DataFrame, documents: DataFrame, *, config=DEFAULT) -> DataFrame:
    """Deletion events with ``error_code``; their version id is ignored."""
    d = documents.select(F.col("id").alias("d_id"), F.col("tenant_id").alias("d_tenant_id"))
    code = first_error((~F.col("schema_version").isin(list(config.schema_versions)), "UNSUPPORTED_SCHEMA_VERSION"), (F.col("d_id").isNull(), "DOCUMENT_NOT_FOUND"), (F.col("d_tenant_id") != F.col("tenant_id"), "TENANT_MISMATCH"))
    return events.join(d, F.col("document_id") == F.col("d_id"), "left").withColumn("error_code", code)
