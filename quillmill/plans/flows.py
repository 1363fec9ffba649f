"""Registered queries of records, file formats, strategies and endings of jobs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import ERRORS, is_permanent
from ..operators import chunking, events, jobs, parsing, publication
from ..streaming import metrics
from . import fixtures as fx
from .queries import _CUT, _EACH, _FIXED, _NEW, _OLD, _T, _parsed


def _now():
    return F.lit(fx.NOW).cast("timestamp")


def decode_events(spark, sf_dir):
    """Every record of the log, decoded or corrupt, with the trace id that it goes by."""
    good, bad = events.decode_events(fx.records(spark, sf_dir))
    good = good.select("kafka_partition", "kafka_offset", F.lit("decoded").alias("verdict"), "source_event_id", "event_type", "schema_version", "tenant_id", "document_id", "document_version_id", F.unix_seconds("occurred_at").alias("occurred"), "trace_id")
    bad = bad.select(F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.lit("corrupt").alias("verdict"))
    return good.unionByName(bad, allowMissingColumns=True)


def parse_docx_blocks(spark, sf_dir):
    """Blocks of DOCX files made of all documents' words."""
    blocks = parsing.explode_blocks(parsing.parse_documents(fx.docxs(spark, sf_dir)))
    return blocks.select("doc_id", "block_order", "type", F.array_join("heading_path", " > ").alias("path"), F.sha2("text", 256).alias("text_hash"))


def dispatch_parsers(spark, sf_dir):
    """All documents as files of several types, some damaged: the parser of each, its number of blocks or its error."""
    return parsing.parse_documents(fx.mixed_files(spark, sf_dir)).select("doc_id", "parser_version", "parse_error", F.when(F.col("blocks").isNotNull(), F.size("blocks")).alias("n_blocks"))


def chunk_by_strategy(spark, sf_dir):
    """Chunks and tokens of all documents under each strategy."""
    parsed = _parsed(spark, sf_dir)
    out = None
    for name in chunking.STRATEGIES:
        how = {"overlap": 16} if name == "PARAGRAPH_OVERLAP" else {}
        one = chunking.chunk(parsed, name, max_tokens=48, exploded=False, **how).select(F.lit(name).alias("strategy"), "doc_id", "n_chunks", "total_tokens")
        out = one if out is None else out.unionByName(one)
    return out


CODES = [*ERRORS, "SomethingElse"]


def _failed(spark, sf_dir):
    """All jobs, those of even ids failed by each code in turn; and the failures."""
    j = fx.jobs(spark, sf_dir).withColumn("status", F.when(F.col("kafka_offset") % 2 == 0, "PROCESSING").otherwise(F.col("status")))
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), ((F.col("kafka_offset") / 2).cast("int") % len(CODES) + 1).cast("int"))
    f = j.filter("kafka_offset % 2 = 0").select("source_event_id", code.alias("error_code"), F.lit("m").alias("error_message"))
    return j, f.withColumn("permanent", is_permanent(F.col("error_code")))


def failure_phases(spark, sf_dir):
    """What each code makes of a job: permanent or tried again, and the phase that it had reached."""
    j, f = _failed(spark, sf_dir)
    stages = F.create_map(*[F.lit(x) for name, (_, place) in ERRORS.items() for x in (name, place)])
    phases = f.select("source_event_id", "permanent", jobs.phase_of(stages[F.col("error_code")]).alias("reached"))
    out = jobs.record_failures(j, f, _now()).join(phases, "source_event_id")
    return out.select("source_event_id", F.col("last_error_code").alias("error_code"), "permanent", F.col("reached").alias("phase"), "status", F.unix_seconds("next_retry_at").alias("retry"))


def job_meters(spark, sf_dir):
    """The meters of all jobs after failures and another start of those that are due, as (meter, n)."""
    j, f = _failed(spark, sf_dir)
    after = jobs.start_jobs(jobs.record_failures(j, f, _now()), F.timestamp_add("SECOND", F.lit(60), _now()))
    sums = after.withColumn("__now", F.timestamp_add("SECOND", F.lit(60), _now())).agg(*metrics.job_meters(5))
    return sums.unpivot([], sums.columns, "meter", "n")


def deletion_race(spark, sf_dir):
    """Documents deleted while some of their jobs run: an unguarded completion follows, the document isn't promoted, and its chunks wait for the sweep."""
    documents, versions, new = fx.documents(spark, sf_dir), fx.versions(spark, sf_dir), fx.incoming_rows(spark, sf_dir)
    gone = documents.filter("deleted_at is not null").select(F.col("id").alias("document_id"))
    table, chunks = jobs.fail_jobs_for_deleted(fx.jobs(spark, sf_dir), gone, _now()), publication.delete_documents(fx.chunk_rows(spark, sf_dir), gone)
    late = table.join(new.select("document_version_id").distinct(), "document_version_id", "left_semi").filter("document_id % 4 < 2").select("source_event_id", "document_version_id")
    rows = new.join(late.select("document_version_id").distinct(), "document_version_id", "left_semi")
    chunks = publication.delete_trailing(publication.upsert_chunks(chunks, rows, documents), rows)
    table, after = jobs.complete_jobs(table, late, _now()), publication.promote(documents, versions, rows)
    counts = table.groupBy(F.col("document_id").alias("id")).agg(F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("last_error_code") == "DOCUMENT_DELETED").alias("ended"))
    stored = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("stored"))
    out = after.join(counts, "id", "left").join(stored, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(F.col("id").alias("document_id"), "searchable_version_id", zero("completed"), zero("ended"), zero("stored"), (F.col("deleted_at").isNotNull() & F.col("stored").isNotNull()).alias("to_sweep"))


_PARA = f"word AS (SELECT doc_id, coalesce(source, 'none') AS title, coalesce(lang, 'none') AS second, regexp_extract_all(text, '{fx.PDF_WORD}') AS w FROM documents), para AS (SELECT *, w[i * {fx.PDF_PARAGRAPH} + 1 : (i + 1) * {fx.PDF_PARAGRAPH}] AS p FROM (SELECT *, unnest(range(0, CAST(ceil(len(w) / {fx.PDF_PARAGRAPH}.0) AS BIGINT))) AS i FROM word)),"
_CODES = """code (idx, code, permanent, phase) AS (VALUES (1, 'UNSUPPORTED_SCHEMA_VERSION', true, NULL), (2, 'DOCUMENT_VERSION_NOT_FOUND', true, NULL), (3, 'DOCUMENT_MISMATCH', true, NULL), (4, 'DOCUMENT_NOT_FOUND', true, NULL), (5, 'TENANT_MISMATCH', true, NULL), (6, 'FILE_TOO_LARGE', true, NULL),
(7, 'DownloadException', false, 'DOWNLOADING'), (8, 'HASH_MISMATCH', true, 'DOWNLOADING'), (9, 'UNSUPPORTED_MIME_TYPE', true, 'PARSING'), (10, 'CORRUPTED_FILE', true, 'PARSING'), (11, 'ParseTimeoutException', false, 'PARSING'), (12, 'EMPTY_EXTRACTION', true, 'CHUNKING'), (13, 'CHUNK_LIMIT_EXCEEDED', true, 'CHUNKING'), (14, 'TOTAL_TOKEN_LIMIT_EXCEEDED', true, 'CHUNKING'),
(15, 'INVALID_EMBEDDING', true, 'EMBEDDING'), (16, 'EMBEDDING_REQUEST_REJECTED', true, 'EMBEDDING'), (17, 'IllegalStateException', false, 'EMBEDDING'), (18, 'SomethingElse', false, 'EMBEDDING')),
hit AS (SELECT j.*, c.code, c.permanent, c.phase, c.permanent OR attempt_count >= 5 AS final FROM job j JOIN code c ON c.idx = (kafka_offset // 2) % 18 + 1 WHERE kafka_offset % 2 = 0)"""
_LATER = f"{_T} + to_seconds(60)"
_METERS = f""",
after AS (
  SELECT CASE WHEN final THEN 'FAILED' ELSE 'RETRY_WAIT' END AS status, attempt_count, CASE WHEN NOT final THEN {_T} + to_seconds(30 * greatest(attempt_count, 1)) END AS next_retry_at, code FROM hit
  UNION ALL SELECT status, attempt_count, next_retry_at, NULL FROM job WHERE kafka_offset % 2 = 1),
st AS (SELECT *, attempt_count < 5 AND (status IN ('PENDING', 'PROCESSING') OR (status = 'RETRY_WAIT' AND (next_retry_at IS NULL OR next_retry_at <= {_LATER}))) AS again FROM after),
fin AS (SELECT CASE WHEN again THEN 'PROCESSING' ELSE status END AS status, attempt_count + CAST(again AS INT) AS attempts, again, code FROM st),
known AS (SELECT code FROM code WHERE idx < 18 UNION ALL VALUES ('MAX_ATTEMPTS_EXCEEDED'), ('DOCUMENT_DELETED'))
SELECT 'jobs_' || lower(s) AS meter, (SELECT count(*) FROM fin WHERE status = s) AS n FROM (VALUES ('PENDING'), ('PROCESSING'), ('RETRY_WAIT'), ('COMPLETED'), ('FAILED')) x(s)
UNION ALL SELECT 'failed_' || known.code, (SELECT count(*) FROM fin WHERE status = 'FAILED' AND fin.code = known.code) FROM known
UNION ALL SELECT 'failed_other', (SELECT count(*) FROM fin WHERE status = 'FAILED' AND (code IS NULL OR code NOT IN (SELECT code FROM known)))
UNION ALL SELECT 'retry_attempt_' || k, (SELECT count(*) FROM fin WHERE again AND attempts = k + 1) FROM range(1, 5) r(k)"""


def _strategies() -> str:
    """Sums of each strategy's chunks for every document."""
    parts = []
    for name, src, stride, keep in (("FIXED_TOKEN", _FIXED, 48, "false"), ("PARAGRAPH", _EACH, 48, "true"), ("PARAGRAPH_OVERLAP", _EACH, 32, "true")):
        cuts = src + _CUT.format(size=48, stride=stride, keep=keep)
        parts.append(f"SELECT '{name}' AS strategy, d.doc_id, coalesce(n, 0) AS n_chunks, coalesce(t, 0) AS total_tokens FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(token_count)::BIGINT AS t FROM (WITH {cuts}) GROUP BY doc_id) c USING (doc_id)")
    return " UNION ALL ".join(parts)


def _sql() -> dict[str, str]:
    bodies = {
        "decode_events": """, raw AS (SELECT *, '{"eventId":"' || source_event_id || '","eventType":"' || event_type || '","schemaVersion":' || schema_version || ',"tenantId":' || tenant_id || ',"documentId":' || document_id || ',"documentVersionId":' || coalesce(document_version_id::VARCHAR, 'null') || ',"occurredAt":"2024-02-' || lpad((kafka_offset % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:0' || (kafka_offset % 10) || 'Z"' || CASE WHEN kafka_offset % 3 = 0 THEN '' ELSE ',"traceId":"p' || kafka_offset || '"' END || '}' AS whole FROM event),
bad AS (SELECT *, CASE kafka_offset % 17 WHEN 1 THEN substring(whole, 1, 20) WHEN 2 THEN 'not json' WHEN 3 THEN replace(whole, '"eventType":', '"eventKind":') WHEN 4 THEN NULL WHEN 5 THEN '[]' WHEN 6 THEN replace(whole, '"documentId":', '"documentId":"x","was":') ELSE whole END AS value FROM raw),
js AS (SELECT *, CASE WHEN json_valid(value) THEN value::JSON END AS j FROM bad),
typed AS (SELECT kafka_partition, kafka_offset, j->>'$.eventId' AS a, j->>'$.eventType' AS b, TRY_CAST(j->>'$.schemaVersion' AS INT) AS c, TRY_CAST(j->>'$.tenantId' AS BIGINT) AS d, TRY_CAST(j->>'$.documentId' AS BIGINT) AS e, TRY_CAST(j->>'$.documentVersionId' AS BIGINT) AS f, epoch(TRY_CAST(j->>'$.occurredAt' AS TIMESTAMPTZ))::BIGINT AS g, coalesce(CASE WHEN kafka_offset % 5 IN (2, 3) THEN 'h' || kafka_offset END, j->>'$.traceId') AS h FROM js),
told AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL AND e IS NOT NULL AND g IS NOT NULL AS ok FROM typed)
SELECT kafka_partition, kafka_offset, CASE WHEN ok THEN 'decoded' ELSE 'corrupt' END AS verdict, CASE WHEN ok THEN a END AS source_event_id, CASE WHEN ok THEN b END AS event_type, CASE WHEN ok THEN c END AS schema_version, CASE WHEN ok THEN d END AS tenant_id, CASE WHEN ok THEN e END AS document_id, CASE WHEN ok THEN f END AS document_version_id, CASE WHEN ok THEN g END AS occurred, CASE WHEN ok THEN h END AS trace_id FROM told""",
        "parse_docx_blocks": "," + _PARA + """item AS (
  SELECT doc_id, 0 AS part, -1.0 AS place, 'HEADING' AS type, title AS text, title AS path FROM word
  UNION ALL SELECT doc_id, 0, 1.5, 'HEADING', second, second FROM para WHERE i = 2
  UNION ALL SELECT doc_id, 0, i, 'PARAGRAPH', array_to_string(p, ' '), CASE WHEN i < 2 THEN title ELSE second END FROM para
  UNION ALL SELECT doc_id, 1, i, 'TABLE', '| ' || p[1] || ' | ' || i || ' |' || chr(10) || '| ' || p[-1] || ' | ' || len(p) || ' |', CASE WHEN len(w) > 80 THEN second ELSE title END FROM para WHERE i % 3 = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, place) - 1 AS INT) AS block_order, type, path, sha256(text) AS text_hash FROM item""",
        "dispatch_parsers": "," + _PARA + """np AS (SELECT doc_id, count(*) AS n FROM para GROUP BY doc_id), nb AS (SELECT doc_id, count(*) AS b FROM block GROUP BY doc_id)
SELECT doc_id, CASE doc_id % 6 WHEN 3 THEN 'pdf-parser/2.0.0' WHEN 4 THEN NULL WHEN 2 THEN 'docx-parser/1.0.0' WHEN 5 THEN 'docx-parser/1.0.0' ELSE 'text-parser/1.0.0' END AS parser_version, CASE doc_id % 6 WHEN 4 THEN 'UNSUPPORTED_MIME_TYPE' WHEN 5 THEN 'CORRUPTED_FILE' END AS parse_error,
  CAST(CASE doc_id % 6 WHEN 2 THEN 1 + coalesce(n + CAST(n > 2 AS INT) + ceil(n / 3.0), 0) WHEN 3 THEN coalesce(n, 0) WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE coalesce(b, 0) END AS INT) AS n_blocks
FROM documents LEFT JOIN np USING (doc_id) LEFT JOIN nb USING (doc_id)""",
        "chunk_by_strategy": _strategies(),
        "failure_phases": "," + _CODES + f" SELECT source_event_id, code AS error_code, permanent, phase, CASE WHEN final THEN 'FAILED' ELSE 'RETRY_WAIT' END AS status, CASE WHEN NOT final THEN CAST(epoch({_T}) AS BIGINT) + 30 * greatest(attempt_count, 1) END AS retry FROM hit",
        "job_meters": "," + _CODES + _METERS,
        "deletion_race": "," + _OLD + _NEW + """j1 AS (SELECT *, document_id % 10 = 0 AND status IN ('PENDING', 'PROCESSING', 'RETRY_WAIT') AS ended, document_id % 4 < 2 AND document_version_id IN (SELECT document_version_id FROM newc) AS late FROM job),
counts AS (SELECT document_id AS id, count(*) FILTER (late OR (status = 'COMPLETED' AND NOT ended)) AS completed, count(*) FILTER (ended AND NOT late) AS ended FROM j1 GROUP BY 1),
rws AS (SELECT * FROM newc WHERE document_version_id IN (SELECT document_version_id FROM j1 WHERE late)),
united AS (SELECT document_id, document_version_id, chunk_no FROM oldc WHERE document_id % 10 <> 0 UNION SELECT document_id, document_version_id, chunk_no FROM rws),
stored AS (SELECT document_id AS id, count(*) AS stored FROM united LEFT JOIN (SELECT document_version_id, max(chunk_no) AS m FROM rws GROUP BY 1) l USING (document_version_id) WHERE m IS NULL OR chunk_no <= m GROUP BY 1),
cand AS (SELECT n.document_id, max(v.embedding_version_no) AS e, arg_max(v.id, v.embedding_version_no) AS c FROM (SELECT DISTINCT document_id, document_version_id FROM rws) n JOIN version v ON v.id = n.document_version_id AND v.document_id = n.document_id GROUP BY 1)
SELECT d.id AS document_id, CASE WHEN d.deleted_at IS NULL AND c IS NOT NULL AND (d.searchable_version_id IS NULL OR s.embedding_version_no < e) THEN c ELSE d.searchable_version_id END AS searchable_version_id,
  coalesce(completed, 0) AS completed, coalesce(ended, 0) AS ended, coalesce(stored, 0) AS stored, d.deleted_at IS NOT NULL AND stored IS NOT NULL AS to_sweep
FROM document d LEFT JOIN cand ON cand.document_id = d.id LEFT JOIN version s ON s.id = d.searchable_version_id LEFT JOIN counts k ON k.id = d.id LEFT JOIN stored t ON t.id = d.id""",
    }
    return {k: "WITH " + fx.SQL + v for k, v in bodies.items()}


ORACLE = _sql()
QUERIES = {name: globals()[name] for name in ORACLE}
