"""Registered queries of the document-indexing operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import chunking, events, jobs, parsing, publication
from . import fixtures as fx



def now():
    return F.lit(fx.NOW).cast("timestamp")


_CHUNK = ["doc_id", "chunk_no", "token_count", "section_path", "content_hash"]
_TEST = Config(max_file_bytes=20_000)


def _parsed(spark, sf_dir):
    return parsing.parse_documents(fx.markdown(spark, sf_dir), parsing.ParserRegistry([parsing.TextParser()]))  # Markdown alone, for which no task needs a child process


def parse_markdown_blocks(spark, sf_dir):
    blocks = parsing.explode_blocks(_parsed(spark, sf_dir))
    return blocks.select("doc_id", "block_order", "type", F.array_join("heading_path", " > ").alias("path"), F.sha2("text", 256).alias("text_hash"))


def parse_pdf_blocks(spark, sf_dir):
    """Blocks of PDFs made of all documents' words, in four ways of showing text."""
    blocks = parsing.explode_blocks(parsing.parse_documents(fx.pdfs(spark, sf_dir)))
    return blocks.select("doc_id", "block_order", "type", "page_no", F.sha2("text", 256).alias("text_hash"))


def chunk_fixed(spark, sf_dir):
    return chunking.chunk_fixed(_parsed(spark, sf_dir)).select(_CHUNK)


def chunk_paragraph(spark, sf_dir):
    return chunking.chunk_paragraph(_parsed(spark, sf_dir), max_tokens=64).select(_CHUNK)


def chunk_overlap(spark, sf_dir):
    return chunking.chunk_paragraph_overlap(_parsed(spark, sf_dir), max_tokens=64, overlap=8).select(_CHUNK)


def chunk_guard(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return chunking.guard_chunks(parsed, max_tokens=64, max_chunks=12, max_total_tokens=600)


def content_integrity(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    v = fx.versions(spark, sf_dir).join(d, "document_id")
    ok = F.concat(F.lit("sha256:"), F.sha2("text", 256)) == F.col("content_hash")
    return v.select("id", F.when(~ok, "HASH_MISMATCH").alias("error_code"))


def route_events(spark, sf_dir):
    return fx.events(spark, sf_dir).groupBy(events.route(F.col("event_type"), F.col("document_version_id")).alias("route")).agg(F.count("*").alias("n_events"))


def validate_events(spark, sf_dir):
    e = fx.events(spark, sf_dir).filter("event_type = 'INDEXING_REQUESTED' and document_version_id is not null")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("sha"))
    e = e.join(d, "document_id", "left")
    out = events.validate_events(e, fx.versions(spark, sf_dir), fx.documents(spark, sf_dir), config=_TEST, actual_hash=F.concat(F.lit("sha256:"), F.col("sha")), mime_types=["text/plain", "text/markdown"])
    return out.select("kafka_offset", "source_event_id", "error_code")


def validate_deletions(spark, sf_dir):
    out = events.validate_deletions(fx.events(spark, sf_dir).filter("event_type = 'DOCUMENT_DELETED'"), fx.documents(spark, sf_dir))
    return out.select("kafka_offset", "document_id", "error_code")


def ordered_rounds(spark, sf_dir):
    """The round in which each request or deletion takes effect after those of its document that it depends on."""
    return events.ordered_rounds(fx.events(spark, sf_dir)).select("kafka_offset", "document_id", "round")


def dedup_events(spark, sf_dir):
    return events.dedup_events(fx.events(spark, sf_dir)).select("kafka_offset", "source_event_id", "verdict")


def _new_jobs(spark, sf_dir):
    old = fx.jobs(spark, sf_dir).filter("kafka_offset % 4 = 0")
    e = fx.events(spark, sf_dir).filter("event_type = 'INDEXING_REQUESTED' and document_version_id is not null")
    return e, old, jobs.insert_jobs_if_absent(old, e, now())


def coalesce_active_jobs(spark, sf_dir):
    return _new_jobs(spark, sf_dir)[2].select("source_event_id", "document_version_id", "status", "attempt_count", "kafka_offset")


def acquire_verdicts(spark, sf_dir):
    return jobs.acquire_verdicts(*_new_jobs(spark, sf_dir)).select("kafka_offset", "source_event_id", "verdict")


_JOB = ["source_event_id", "status", "attempt_count", "next_retry_at", "started_at", "completed_at", "last_error_code"]


def job_acquire(spark, sf_dir):
    return jobs.start_jobs(fx.jobs(spark, sf_dir), now()).select(_JOB)


def job_fail_exceeded(spark, sf_dir):
    return jobs.fail_exceeded(fx.jobs(spark, sf_dir), now()).select(_JOB)


def record_failures(spark, sf_dir):
    j = fx.jobs(spark, sf_dir)
    f = j.filter("document_id % 3 <> 0").select("source_event_id", F.expr("case when document_id % 3 = 1 then 'HASH_MISMATCH' else 'DownloadException' end").alias("error_code"), F.lit("m").alias("error_message"), (F.col("document_id") % 3 == 1).alias("permanent"))
    return jobs.record_failures(j, f, now()).select(_JOB)


def complete_jobs(spark, sf_dir):
    j = fx.jobs(spark, sf_dir)
    return jobs.complete_jobs(j, j.filter("document_id % 4 = 1").select("source_event_id"), now()).select(_JOB)


def fail_jobs_for_deleted(spark, sf_dir):
    gone = fx.documents(spark, sf_dir).filter("deleted_at is not null").select(F.col("id").alias("document_id"))
    return jobs.fail_jobs_for_deleted(fx.jobs(spark, sf_dir), gone, now()).select(_JOB)


def _upserted(spark, sf_dir):
    new = fx.incoming_rows(spark, sf_dir)
    return publication.upsert_chunks(fx.chunk_rows(spark, sf_dir), new, fx.documents(spark, sf_dir)), new


def upsert_chunks(spark, sf_dir):
    return _upserted(spark, sf_dir)[0]


def trailing_delete(spark, sf_dir):
    return publication.delete_trailing(*_upserted(spark, sf_dir))


def stored_count(spark, sf_dir):
    both, new = _upserted(spark, sf_dir)
    return publication.stored_count_check(publication.delete_trailing(both, new), new)


def publish_batch(spark, sf_dir):
    """What forbids publishing each version of a faulty batch, and what is stored of the rest."""
    new, documents = fx.faulty_rows(spark, sf_dir), fx.documents(spark, sf_dir)
    errors = publication.publication_errors(new, documents)
    fine = new.join(errors.filter("error_code is null"), "document_version_id", "left_semi")
    stored = publication.delete_trailing(publication.upsert_chunks(fx.chunk_rows(spark, sf_dir), fine, documents), fine)
    return errors.join(publication.count_chunks(stored), "document_version_id", "left").select("document_version_id", "error_code", F.coalesce("n_chunks", F.lit(0)).alias("stored"))


def complete_version(spark, sf_dir):
    return publication.complete_versions(fx.versions(spark, sf_dir), fx.incoming_rows(spark, sf_dir), now()).select("id", "chunk_count", "indexed_at")


def promote_searchable(spark, sf_dir):
    out = publication.promote(fx.documents(spark, sf_dir), fx.versions(spark, sf_dir), fx.incoming_rows(spark, sf_dir))
    return out.select("id", "searchable_version_id", "latest_embedding_version_no")


def searchable_embedding_version(spark, sf_dir):
    return publication.searchable_versions(fx.documents(spark, sf_dir), fx.versions(spark, sf_dir))


def delete_document_chunks(spark, sf_dir):
    gone = fx.documents(spark, sf_dir).filter("deleted_at is not null").select(F.col("id").alias("document_id"))
    return publication.delete_documents(fx.chunk_rows(spark, sf_dir), gone).select("document_id", "document_version_id", "chunk_no")


def deletion_sweep(spark, sf_dir):
    return publication.sweep_candidates(fx.documents(spark, sf_dir), fx.chunk_rows(spark, sf_dir), DEFAULT.sweep_limit)


def embedding_validation(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vector = F.expr("case vec_id % 9 when 0 then slice(embedding, 1, 63) when 1 then transform(embedding, (x, i) -> if(i = 5, float('NaN'), x)) when 2 then transform(embedding, (x, i) -> if(i = 7, float('Infinity'), x)) else embedding end")
    return e.select("vec_id", publication.embedding_error(vector, 64).alias("error_code"))


def embed_join(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr("(vec_id div 4) * 10 + 1").alias("document_version_id"), F.expr("cast(vec_id % 4 as int)").alias("chunk_no"), "embedding")
    out = publication.join_embeddings(fx.chunk_rows(spark, sf_dir), e, now())
    return out.select("document_version_id", "chunk_no", "content", F.size("embedding").alias("dims"), "embedded_at")


def audit_status_counts(spark, sf_dir):
    return publication.audit_status(fx.jobs(spark, sf_dir))


def audit_searchable_chunks(spark, sf_dir):
    return publication.audit_searchable(fx.documents(spark, sf_dir), fx.jobs(spark, sf_dir), fx.chunk_rows(spark, sf_dir).filter("document_id % 6 <> 0"))


def tokenize_bpe(spark, sf_dir):
    """Needs public BPE rank files; each text's number of ids."""
    import public_tokenizers

    from ..operators.tokenizers import bpe_ids

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.size(bpe_ids(F.col("text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))).alias("n_tokens"))


_CUT = r"""
toks AS (SELECT *, regexp_extract_all(text, '[ \t\n\r\f]*[^ \t\n\r\f]+') AS tk FROM src),
cuts AS (
  SELECT doc_id, ord, text, path, i, tk, len(tk) AS n FROM (
    SELECT *, unnest(range(0, 1 + CASE WHEN len(tk) > {size} THEN CAST(ceil((len(tk) - {size}) / {stride}::DOUBLE) AS INT) ELSE 0 END)) AS i FROM toks)),
piece AS (
  SELECT doc_id, ord, i, path, CASE WHEN {keep} AND n <= {size} THEN text ELSE array_to_string(tk[i * {stride} + 1 : i * {stride} + {size}], '') END AS body,
    len(tk[i * {stride} + 1 : i * {stride} + {size}]) AS token_count FROM cuts WHERE {keep} OR n > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, i) - 1 AS INT) AS chunk_no, CAST(token_count AS INT) AS token_count, nullif(path, '') AS section_path,
  sha256(CASE WHEN path = '' THEN '' ELSE '[' || path || ']' || chr(10) END || body) AS content_hash FROM piece
"""
_FIXED = "src AS (SELECT doc_id, 0 AS ord, string_agg(text, chr(10) || chr(10) ORDER BY block_order) AS text, arg_min(path, block_order) AS path FROM block GROUP BY doc_id),"
_EACH = "src AS (SELECT doc_id, block_order AS ord, text, path FROM block),"
_T = "TIMESTAMP '2024-03-01 00:00:00'"
_J = "SELECT source_event_id, {status} AS status, {attempt} AS attempt_count, {retry} AS next_retry_at, {started} AS started_at, {completed} AS completed_at, {code} AS last_error_code FROM job"


def _job(when, status=None, attempt="attempt_count", retry="next_retry_at", started="started_at", completed="NULL::TIMESTAMP", code="NULL::VARCHAR"):
    c = lambda new, old: old if new == old else f"CASE WHEN {when} THEN {new} ELSE {old} END"
    return _J.format(status=c(status, "status"), attempt=c(attempt, "attempt_count"), retry=c(retry, "next_retry_at"), started=c(started, "started_at"), completed=c(completed, "NULL::TIMESTAMP"), code=c(code, "NULL::VARCHAR"))


_OLD = "old AS (SELECT doc_id AS document_id, doc_id * 10 + 1 AS document_version_id, CAST(substring(source, 4) AS BIGINT) AS tenant_id, CAST(unnest(range(0, 1 + doc_id % 4)) AS INT) AS chunk_no FROM documents), oldc AS (SELECT *, 'old ' || document_id || ' ' || chunk_no AS content FROM old),"
_NEW = "new0 AS (SELECT doc_id AS document_id, doc_id * 10 + CASE WHEN doc_id % 5 = 4 AND doc_id % 3 > 0 THEN 2 ELSE 1 END AS document_version_id, CAST(unnest(range(0, 1 + doc_id % 3)) AS INT) AS chunk_no FROM documents WHERE doc_id % 3 <> 2), newc AS (SELECT *, 'new ' || document_id || ' ' || chunk_no AS content FROM new0),"
_UP = _OLD + _NEW + "up AS (SELECT o.document_id, o.document_version_id, o.tenant_id, o.chunk_no, o.content FROM oldc o WHERE NOT EXISTS (SELECT 1 FROM newc n WHERE n.document_version_id = o.document_version_id AND n.chunk_no = o.chunk_no) UNION ALL SELECT n.document_id, n.document_version_id, d.tenant_id, n.chunk_no, n.content FROM newc n JOIN document d ON d.id = n.document_id),"
_TR = _UP + "tr AS (SELECT up.* FROM up LEFT JOIN (SELECT document_version_id, max(chunk_no) AS m FROM newc GROUP BY 1) l USING (document_version_id) WHERE m IS NULL OR chunk_no <= m)"
_INS = """oldj AS (SELECT * FROM job WHERE kafka_offset % 4 = 0),
req AS (SELECT * FROM event WHERE event_type = 'INDEXING_REQUESTED' AND document_version_id IS NOT NULL),
f1 AS (SELECT * FROM req WHERE source_event_id NOT IN (SELECT source_event_id FROM oldj) AND document_version_id NOT IN (SELECT document_version_id FROM oldj WHERE status IN ('PENDING', 'PROCESSING', 'RETRY_WAIT'))),
f2 AS (SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY source_event_id ORDER BY kafka_offset) = 1),
ins AS (SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY document_version_id ORDER BY kafka_offset) = 1)"""
_ACTIVE = "status IN ('PENDING', 'PROCESSING', 'RETRY_WAIT')"


def _sql() -> dict[str, str]:
    fixed, para, over = (src + _CUT.format(size=s, stride=t, keep=k) for src, s, t, k in ((_FIXED, 512, 512, "false"), (_EACH, 64, 64, "true"), (_EACH, 64, 56, "true")))
    guard = (_FIXED + _CUT.format(size=64, stride=64, keep="false")).replace("SELECT doc_id, CAST(row_number()", ", res AS (SELECT doc_id, CAST(row_number()", 1) + ")"
    bodies = {
        "parse_markdown_blocks": "SELECT doc_id, block_order, type, path, sha256(text) AS text_hash FROM block",
        "parse_pdf_blocks": (",", f"word AS (SELECT doc_id, regexp_extract_all(text, '{fx.PDF_WORD}') AS w FROM documents), para AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / {fx.PDF_PARAGRAPH}.0) AS BIGINT))) AS i FROM word) SELECT doc_id, CAST(i AS INT) AS block_order, 'PARAGRAPH' AS type, CAST(i // {fx.PDF_PAGE} + 1 AS INT) AS page_no, sha256(array_to_string(w[i * {fx.PDF_PARAGRAPH} + 1 : (i + 1) * {fx.PDF_PARAGRAPH}], ' ')) AS text_hash FROM para"),
        "chunk_fixed": ("," , fixed), "chunk_paragraph": (",", para), "chunk_overlap": (",", over),
        "chunk_guard": (",", guard + ", g AS (SELECT doc_id, count(*) AS n_chunks, sum(token_count)::BIGINT AS total_tokens FROM res GROUP BY doc_id) SELECT d.doc_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(total_tokens, 0) AS total_tokens, CASE WHEN n_chunks IS NULL THEN 'EMPTY_EXTRACTION' WHEN n_chunks > 12 THEN 'CHUNK_LIMIT_EXCEEDED' WHEN total_tokens > 600 THEN 'TOTAL_TOKEN_LIMIT_EXCEEDED' END AS error_code FROM documents d LEFT JOIN g USING (doc_id)"),
        "content_integrity": "SELECT v.id, CASE WHEN v.content_hash <> 'sha256:' || sha256(d.text) THEN 'HASH_MISMATCH' END AS error_code FROM version v JOIN documents d ON d.doc_id = v.document_id",
        "route_events": "SELECT CASE WHEN event_type = 'INDEXING_REQUESTED' AND document_version_id IS NULL THEN 'drop' WHEN event_type = 'INDEXING_REQUESTED' THEN 'index' WHEN event_type = 'DOCUMENT_DELETED' THEN 'delete' ELSE 'unknown' END AS route, count(*) AS n_events FROM event GROUP BY 1",
        "validate_events": "SELECT e.kafka_offset, e.source_event_id, CASE WHEN schema_version <> 1 THEN 'UNSUPPORTED_SCHEMA_VERSION' WHEN v.id IS NULL THEN 'DOCUMENT_VERSION_NOT_FOUND' WHEN v.document_id <> e.document_id THEN 'DOCUMENT_MISMATCH' WHEN d.id IS NULL THEN 'DOCUMENT_NOT_FOUND' WHEN d.tenant_id <> e.tenant_id THEN 'TENANT_MISMATCH' WHEN v.file_size > 20000 THEN 'FILE_TOO_LARGE' WHEN v.content_hash <> 'sha256:' || sha256(s.text) THEN 'HASH_MISMATCH' WHEN mime_type NOT IN ('text/plain', 'text/markdown') THEN 'UNSUPPORTED_MIME_TYPE' END AS error_code FROM event e LEFT JOIN version v ON v.id = e.document_version_id LEFT JOIN document d ON d.id = e.document_id LEFT JOIN documents s ON s.doc_id = e.document_id WHERE event_type = 'INDEXING_REQUESTED' AND document_version_id IS NOT NULL",
        "validate_deletions": "SELECT e.kafka_offset, e.document_id, CASE WHEN schema_version <> 1 THEN 'UNSUPPORTED_SCHEMA_VERSION' WHEN d.id IS NULL THEN 'DOCUMENT_NOT_FOUND' WHEN d.tenant_id <> e.tenant_id THEN 'TENANT_MISMATCH' END AS error_code FROM event e LEFT JOIN document d ON d.id = e.document_id WHERE event_type = 'DOCUMENT_DELETED'",
        "ordered_rounds": (",", "take AS (SELECT *, CAST(event_type = 'DOCUMENT_DELETED' AS INT) AS del FROM event WHERE event_type = 'DOCUMENT_DELETED' OR (event_type = 'INDEXING_REQUESTED' AND document_version_id IS NOT NULL)), part AS (SELECT *, 2 * coalesce(sum(del) OVER (PARTITION BY document_id ORDER BY kafka_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + del AS p FROM take), nth AS (SELECT *, CASE WHEN del = 1 THEN 1 ELSE row_number() OVER (PARTITION BY document_id, p, document_version_id ORDER BY kafka_offset) END AS n FROM part) SELECT kafka_offset, document_id, CAST(dense_rank() OVER (PARTITION BY document_id ORDER BY p, n) AS INT) AS round FROM nth"),
        "dedup_events": "SELECT kafka_offset, source_event_id, CASE WHEN row_number() OVER (PARTITION BY source_event_id ORDER BY kafka_offset) = 1 THEN 'NEW' ELSE 'DUPLICATE' END AS verdict FROM event",
        "coalesce_active_jobs": (",", _INS + " SELECT source_event_id, document_version_id, 'PENDING' AS status, 0 AS attempt_count, kafka_offset FROM ins"),
        "acquire_verdicts": (",", _INS + " SELECT r.kafka_offset, r.source_event_id, CASE WHEN i.kafka_offset = r.kafka_offset THEN 'NEW' WHEN coalesce(o.kafka_offset, i.kafka_offset) IS NULL THEN 'OTHER_ACTIVE' WHEN coalesce(o.kafka_offset, i.kafka_offset) = r.kafka_offset THEN 'REDELIVERY' ELSE 'DUPLICATE' END AS verdict FROM req r LEFT JOIN oldj o USING (source_event_id) LEFT JOIN ins i USING (source_event_id)"),
        "job_acquire": _job(f"attempt_count < 5 AND (status IN ('PENDING', 'PROCESSING') OR (status = 'RETRY_WAIT' AND (next_retry_at IS NULL OR next_retry_at <= {_T})))", "'PROCESSING'", "attempt_count + 1", "NULL", f"coalesce(started_at, {_T})"),
        "job_fail_exceeded": _job("status IN ('PENDING', 'PROCESSING') AND attempt_count >= 5", "'FAILED'", retry="NULL", completed=_T, code="'MAX_ATTEMPTS_EXCEEDED'"),
        "record_failures": _job("status = 'PROCESSING' AND document_id % 3 <> 0", "CASE WHEN document_id % 3 = 1 OR attempt_count >= 5 THEN 'FAILED' ELSE 'RETRY_WAIT' END", retry=f"CASE WHEN document_id % 3 = 1 OR attempt_count >= 5 THEN NULL ELSE {_T} + to_seconds(30 * greatest(attempt_count, 1)) END", completed=f"CASE WHEN document_id % 3 = 1 OR attempt_count >= 5 THEN {_T} END", code="CASE WHEN document_id % 3 = 1 THEN 'HASH_MISMATCH' ELSE 'DownloadException' END"),
        "complete_jobs": _job("document_id % 4 = 1", "'COMPLETED'", retry="NULL", completed=_T),
        "fail_jobs_for_deleted": _job(f"document_id % 10 = 0 AND {_ACTIVE}", "'FAILED'", retry="NULL", completed=_T, code="'DOCUMENT_DELETED'"),
        "upsert_chunks": (",", _UP.rstrip(",") + " SELECT * FROM up"),
        "trailing_delete": (",", _TR + " SELECT * FROM tr"),
        "stored_count": (",", _TR + " SELECT document_version_id, e.expected, coalesce(s.stored, 0) AS stored, coalesce(s.stored, 0) = e.expected AS ok FROM (SELECT document_version_id, count(*) AS expected FROM newc GROUP BY 1) e LEFT JOIN (SELECT document_version_id, count(*) AS stored FROM tr GROUP BY 1) s USING (document_version_id)"),
        "publish_batch": (",", _OLD + _NEW + "bad AS (SELECT CASE WHEN document_id % 19 = 0 AND chunk_no = 1 THEN document_id + 1 ELSE document_id + CASE WHEN document_id % 23 = 0 THEN 100000000 ELSE 0 END END AS document_id, document_version_id, chunk_no + CASE WHEN document_id % 7 = 0 THEN 1 WHEN document_id % 11 = 0 AND chunk_no = 1 THEN -1 ELSE 0 END AS chunk_no, CASE WHEN document_id % 13 = 0 THEN ' ' ELSE content END AS content FROM newc), err AS (SELECT document_version_id, CASE WHEN min(chunk_no) <> 0 OR max(chunk_no) <> count(*) - 1 OR count(DISTINCT chunk_no) <> count(*) OR bool_or(trim(content) = '') THEN 'INVALID_EMBEDDING' WHEN count(DISTINCT document_id) > 1 OR count(d.id) <> count(*) THEN 'IllegalStateException' END AS error_code FROM bad LEFT JOIN document d ON d.id = bad.document_id GROUP BY 1), fine AS (SELECT * FROM bad WHERE document_version_id IN (SELECT document_version_id FROM err WHERE error_code IS NULL)), every AS (SELECT document_version_id, chunk_no FROM oldc UNION SELECT document_version_id, chunk_no FROM fine), kept AS (SELECT e.* FROM every e LEFT JOIN (SELECT document_version_id, max(chunk_no) AS m FROM fine GROUP BY 1) l USING (document_version_id) WHERE m IS NULL OR chunk_no <= m) SELECT document_version_id, error_code, coalesce(n, 0) AS stored FROM err LEFT JOIN (SELECT document_version_id, count(*) AS n FROM kept GROUP BY 1) k USING (document_version_id)"),
        "complete_version": (",", _NEW.rstrip(",") + f" SELECT v.id, CAST(c.n AS INT) AS chunk_count, CASE WHEN c.n IS NOT NULL THEN {_T} END AS indexed_at FROM version v LEFT JOIN (SELECT document_version_id, document_id, count(*) AS n FROM newc GROUP BY 1, 2) c ON c.document_version_id = v.id AND c.document_id = v.document_id"),
        "promote_searchable": (",", _NEW + "cand AS (SELECT n.document_id, max(v.embedding_version_no) AS e, arg_max(v.id, v.embedding_version_no) AS c FROM (SELECT DISTINCT document_id, document_version_id FROM newc) n JOIN version v ON v.id = n.document_version_id AND v.document_id = n.document_id GROUP BY 1), st AS (SELECT d.*, c.e, c.c, d.deleted_at IS NULL AND c.c IS NOT NULL AND (d.searchable_version_id IS NULL OR s.embedding_version_no < c.e) AS hit FROM document d LEFT JOIN cand c ON c.document_id = d.id LEFT JOIN version s ON s.id = d.searchable_version_id) SELECT id, CASE WHEN hit THEN c ELSE searchable_version_id END AS searchable_version_id, CASE WHEN hit THEN greatest(latest_embedding_version_no, e) ELSE latest_embedding_version_no END AS latest_embedding_version_no FROM st"),
        "searchable_embedding_version": "SELECT d.id AS document_id, v.embedding_version_no FROM document d JOIN version v ON v.id = d.searchable_version_id",
        "delete_document_chunks": (",", _OLD.rstrip(",") + " SELECT document_id, document_version_id, chunk_no FROM oldc WHERE document_id NOT IN (SELECT id FROM document WHERE deleted_at IS NOT NULL)"),
        "deletion_sweep": (",", _OLD.rstrip(",") + " SELECT id AS document_id, deleted_at FROM document WHERE deleted_at IS NOT NULL AND id IN (SELECT document_id FROM oldc) ORDER BY deleted_at, id LIMIT 50"),
        "embedding_validation": "SELECT vec_id, CASE WHEN vec_id % 9 IN (0, 1, 2) OR len(embedding) <> 64 OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'INVALID_EMBEDDING' END AS error_code FROM embeddings",
        "embed_join": (",", _OLD.rstrip(",") + f" SELECT document_version_id, chunk_no, content, CAST(len(embedding) AS INT) AS dims, {_T} AS embedded_at FROM oldc JOIN (SELECT (vec_id // 4) * 10 + 1 AS document_version_id, CAST(vec_id % 4 AS INT) AS chunk_no, embedding FROM embeddings) e USING (document_version_id, chunk_no)"),
        "audit_status_counts": "SELECT status, count(*) AS n_jobs FROM job GROUP BY status",
        "audit_searchable_chunks": (",", _OLD.rstrip(",") + " SELECT d.id AS document_id, d.searchable_version_id, count(c.chunk_no) AS n_chunks FROM document d JOIN (SELECT DISTINCT document_version_id FROM job WHERE status = 'COMPLETED') j ON j.document_version_id = d.searchable_version_id LEFT JOIN (SELECT * FROM oldc WHERE document_id % 6 <> 0) c ON c.document_version_id = d.searchable_version_id GROUP BY 1, 2"),
    }
    return {k: "WITH " + fx.SQL + (v if isinstance(v, str) else "".join(v)) for k, v in bodies.items()}


ORACLE = _sql()
QUERIES = {name: globals()[name] for name in [*ORACLE, "tokenize_bpe"]}
