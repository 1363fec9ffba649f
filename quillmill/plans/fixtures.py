"""Document, version, event and job tables derived from the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import parted
from ..operators.batches import rows as each

NOW = "2024-03-01 00:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.expr("cast(substring(source, 4) as bigint)").alias("tenant_id"),
        F.expr("case when doc_id % 10 = 0 then timestamp_seconds(unix_seconds(timestamp'2024-02-01 00:00:00') + doc_id) end").alias("deleted_at"),
        (1 + F.col("doc_id") % 3).alias("latest_upload_version_no"), F.expr("case when doc_id % 5 = 1 then 0L else 1L end").alias("latest_embedding_version_no"),
        F.expr("case when doc_id % 5 = 1 then null else doc_id * 10 + 1 end").alias("searchable_version_id"),
    )


def versions(spark, sf_dir) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("sha"), F.explode(F.expr("sequence(1L, 1 + doc_id % 3)")).alias("ver"))
    vid = F.col("doc_id") * 10 + F.col("ver")
    return d.select(
        vid.alias("id"), F.col("doc_id").alias("document_id"), F.col("ver").alias("version_no"), F.col("ver").alias("embedding_version_no"), F.col("n_chars").alias("file_size"),
        F.when(vid % 41 == 0, "sha256:bad").otherwise(F.concat(F.lit("sha256:"), F.col("sha"))).alias("content_hash"),
        F.expr("case doc_id % 7 when 0 then 'application/octet-stream' when 1 then 'text/markdown' else 'text/plain' end").alias("mime_type"),
        F.lit(None).cast("string").alias("extracted_metadata"), F.lit(None).cast("int").alias("chunk_count"), F.lit(None).cast("timestamp").alias("indexed_at"),
    )


def events(spark, sf_dir) -> DataFrame:
    n = F.broadcast(_table(spark, sf_dir, "documents").agg(F.count("*").alias("n")))
    e = _table(spark, sf_dir, "events").crossJoin(n).withColumn("k", F.expr("event_id - case when event_id % 10 = 9 then 1 else 0 end"))
    e = e.withColumn("document_id", F.expr("k % n"))
    return e.select(
        F.expr("concat('e', k)").alias("source_event_id"),
        F.expr("case when k % 23 = 0 then 'UNKNOWN' when k % 11 = 0 then 'DOCUMENT_DELETED' else 'INDEXING_REQUESTED' end").alias("event_type"),
        F.expr("case when k % 50 = 0 then 2 else 1 end").alias("schema_version"), "document_id",
        F.expr("case when k % 29 = 0 or k % 11 = 0 then null when k % 31 = 0 then ((k + 1) % n) * 10 + 1 else (k % n) * 10 + 1 + (k div n + k) % 4 end").alias("document_version_id"),
        F.expr("document_id % 20 + case when k % 37 = 0 then 1 else 0 end").alias("tenant_id"),
        F.lit("doc.events.v1").alias("kafka_topic"), F.expr("cast(document_id % 4 as int)").alias("kafka_partition"), F.col("event_id").alias("kafka_offset"), F.col("ts").alias("occurred_at"), F.lit(None).cast("string").alias("trace_id"),
    )


def jobs(spark, sf_dir) -> DataFrame:
    """One job for each first event of a tenth of the events' ids, in every status."""
    e = _table(spark, sf_dir, "events").filter("event_id % 10 <> 9")
    n = F.broadcast(_table(spark, sf_dir, "documents").agg(F.count("*").alias("n")))
    e = e.crossJoin(n).withColumn("s", F.expr("(event_id div 7) % 5"))
    return e.select(
        F.expr("concat('e', event_id)").alias("source_event_id"), F.expr("event_id % n").alias("document_id"), F.expr("(event_id % n) * 10 + 1").alias("document_version_id"),
        F.expr("element_at(array('PENDING', 'PROCESSING', 'RETRY_WAIT', 'COMPLETED', 'FAILED'), cast(s + 1 as int))").alias("status"), F.expr("cast(event_id % 7 as int)").alias("attempt_count"),
        F.expr(f"case when s = 2 then timestamp_seconds(unix_seconds(timestamp'{NOW}') + event_id % 100 - 50) end").alias("next_retry_at"),
        F.lit(None).cast("string").alias("worker_id"), F.lit(None).cast("string").alias("last_error_code"), F.lit(None).cast("string").alias("last_error_message"), F.lit(None).cast("string").alias("trace_id"), F.lit(None).cast("string").alias("phase"),
        F.expr("case when event_id % 3 = 0 then timestamp'2024-02-28 00:00:00' end").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("timestamp").alias("updated_at"),
        F.lit("doc.events.v1").alias("kafka_topic"), F.expr("cast((event_id % n) % 4 as int)").alias("kafka_partition"), F.col("event_id").alias("kafka_offset"),
    )


def markdown(spark, sf_dir) -> DataFrame:
    """(doc_id, content, mime_type): headings from source and lang, then the text with its line ends doubled."""
    return _table(spark, sf_dir, "documents").select("doc_id", _marked_down().alias("content"), F.lit("text/markdown").alias("mime_type"))


def _marked_down():
    return F.concat(F.lit("# "), F.col("source"), F.lit("\n## "), F.col("lang"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))


#: Words of the PDFs made of the documents, of a line, and of a paragraph; paragraphs of a page.
PDF_WORD, PDF_LINE, PDF_PARAGRAPH, PDF_PAGE = "[0-9A-Za-zÀ-ÖØ-öø-ÿ().,]+", 8, 40, 3


def pdf_bytes(words: list[str], form: int) -> bytes:
    """A PDF of ``words`` in one of four forms: relative lines, matrices with gaps for spaces, two-byte codes in Flate, or next-line strings."""
    codes = words if form == 2 else " ".join(words).encode("cp1252").split()
    paragraphs = [codes[i : i + PDF_PARAGRAPH] for i in range(0, len(codes), PDF_PARAGRAPH)]
    escaped = lambda t: t.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    level = lambda t: min(accumulate((c == b"(") - (c == b")") for c in re.findall(rb"[()]", t[:-1])), default=0) >= 0 and t.count(b"(") == t.count(b")")
    contents = []
    for at in range(0, max(len(paragraphs), 1), PDF_PAGE):
        out, y = [b"BT /F1 12 Tf 14 TL 50 760 Td" if form in (0, 3) else b"BT /F1 12 Tf"], 760
        for n, paragraph in enumerate(paragraphs[at : at + PDF_PAGE]):
            for i in range(0, len(paragraph), PDF_LINE):
                line, first = paragraph[i : i + PDF_LINE], not i and n
                text = " ".join(line) if form == 2 else b" ".join(line)
                if form == 0:
                    out.append(b"0 %d Td (%s) Tj" % (-40 if first else -14, text if b"(" not in text and b")" not in text or level(text) else escaped(text)))
                elif form == 1:
                    out.append(b"1 0 0 1 50 %d Tm [(%s)] TJ" % (y - (26 if first else 0), escaped(text).replace(b" ", b") -300 (")))
                elif form == 2:
                    out.append(b"1 0 0 1 50 %d Tm <%s> Tj" % (y - (26 if first else 0), text.encode("utf-16-be").hex().encode()))
                else:
                    out.append((b"( ) ' " if first else b"") + b"(%s) '" % escaped(text))
                y -= 40 if first else 14
        contents.append(b"\n".join([*out, b"ET"]))
    font = b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding>>"
    if form == 2:
        font = b"<</Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R /DescendantFonts [<</DW 500>>]>>"
    kids = b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(contents)))
    objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [%s] /Count %d /Resources <</Font <</F1 3 0 R>>>>>>" % (kids, len(contents)), 3: font}
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0000> <00ff> <0000> endbfrange"
    streams = {4: cmap} | {6 + 2 * i: c for i, c in enumerate(contents)}
    objects |= {5 + 2 * i: b"<</Type /Page /Parent 2 0 R /Contents %d 0 R>>" % (6 + 2 * i) for i in range(len(contents))}
    for number, data in streams.items():
        data, how = (zlib.compress(data), b"/Filter /FlateDecode") if form == 2 else (data, b"")
        objects[number] = b"<</Length %d %s>>\nstream\n%s\nendstream" % (len(data), how, data)
    out, places = [b"%PDF-1.4\n"], []
    size = len(out[0])
    for number in range(1, len(objects) + 1):
        places.append(size)
        out.append(b"%d 0 obj\n%s\nendobj\n" % (number, objects[number]))
        size += len(out[-1])
    table = b"".join(b"%010d 00000 n \n" % x for x in places)
    return b"".join(out) + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d /Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(places) + 1, table, len(places) + 1, size)


def _made(rows: DataFrame, make) -> DataFrame:
    """(doc_id, content): ``make`` of the values of each row."""

    def work(batches):
        for batch in batches:
            first = 0
            for made in parted((make(*row) for row in each(batch)), len):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(made)), pa.array(made, pa.binary())], names=["doc_id", "content"])
                first += len(made)

    return rows.mapInArrow(work, "doc_id long, content binary")


def _words():
    """The words that files are made of, joined by spaces, which they hold none of: as a string a row is no longer than its text, as an array four bytes a word longer."""
    return F.array_join(F.regexp_extract_all(F.col("text"), F.lit(PDF_WORD), F.lit(0)), " ")


def pdfs(spark, sf_dir) -> DataFrame:
    """(doc_id, content, mime_type): each document's words as a PDF, in the form doc_id % 4."""
    made = _made(_table(spark, sf_dir, "documents").select("doc_id", _words().alias("words")), lambda i, words: pdf_bytes((words or "").split(), i % 4))
    return made.withColumn("mime_type", F.lit("application/pdf"))


DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def docx_bytes(words: list[str], title: str, second: str) -> bytes:
    """A DOCX: ``title`` as heading, paragraphs of two runs with blank ones between, ``second`` as heading of the third and later, a table before every third."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{t}</w:t></w:r>'
    heading = lambda level, t: f'<w:p><w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>{run(t)}</w:p>'
    row = lambda a, b: f"<w:tr><w:tc><w:p>{run(a)}</w:p></w:tc><w:tc><w:p>{run(b)}</w:p></w:tc></w:tr>"
    out = [heading(1, title)]
    for n, at in enumerate(range(0, len(words), PDF_PARAGRAPH)):
        some = words[at : at + PDF_PARAGRAPH]
        half = len(some) // 2
        if n == 2:
            out.append(heading(2, second))
        if n % 3 == 0:
            out.append(f"<w:tbl>{row(some[0], n)}{row(some[-1], len(some))}</w:tbl>")
        out.append(f"<w:p>{run(' '.join(some[:half]) + ' ')}{run(' '.join(some[half:]))}</w:p><w:p>{run(' ')}</w:p>")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(out)}</w:body></w:document>')
    return data.getvalue()


def _titled(spark, sf_dir, body) -> DataFrame:
    """(doc_id, title, second, body): what files are made of."""
    title, second = (F.coalesce(c, F.lit("none")).alias(name) for c, name in (("source", "title"), ("lang", "second")))
    return _table(spark, sf_dir, "documents").select("doc_id", title, second, body.alias("body"))


def docxs(spark, sf_dir) -> DataFrame:
    """(doc_id, content, mime_type): each document's words as a DOCX under its source and language."""
    made = _made(_titled(spark, sf_dir, _words()), lambda _, title, second, words: docx_bytes((words or "").split(), title, second))
    return made.withColumn("mime_type", F.lit(DOCX))


def mixed_files(spark, sf_dir) -> DataFrame:
    """(doc_id, content, mime_type): by doc_id % 6 plain text, Markdown, DOCX, PDF, a type that has no parser, and a DOCX that is none."""

    def make(i, title, second, body):
        body = body or ""
        return docx_bytes(body.split(), title, second) if i % 6 == 2 else pdf_bytes(body.split(), i % 4) if i % 6 == 3 else body.encode()

    body = F.when(F.pmod("doc_id", F.lit(6)).isin(2, 3), _words()).otherwise(_marked_down())  # a row carries only what its file is made of
    types = F.array(*[F.lit(x) for x in ("text/plain", "text/markdown", DOCX, "application/pdf", "application/octet-stream", DOCX)])
    return _made(_titled(spark, sf_dir, body), make).withColumn("mime_type", F.element_at(types, (F.col("doc_id") % 6 + 1).cast("int")))


def records(spark, sf_dir) -> DataFrame:
    """The events as records of a log: JSON values, six in seventeen of them damaged, and headers."""
    e = events(spark, sf_dir)
    value = F.expr(
        """concat('{"eventId":"', source_event_id, '","eventType":"', event_type, '","schemaVersion":', schema_version, ',"tenantId":', tenant_id, ',"documentId":', document_id,
        ',"documentVersionId":', coalesce(cast(document_version_id as string), 'null'), ',"occurredAt":"2024-02-', lpad(cast(kafka_offset % 28 + 1 as string), 2, '0'), 'T00:00:0', kafka_offset % 10, 'Z"',
        case when kafka_offset % 3 = 0 then '' else concat(',"traceId":"p', kafka_offset, '"') end, '}')"""
    )
    damaged = F.expr(
        """case kafka_offset % 17 when 1 then substring(value, 1, 20) when 2 then 'not json' when 3 then replace(value, '"eventType":', '"eventKind":') when 4 then null
        when 5 then '[]' when 6 then replace(value, '"documentId":', '"documentId":"x","was":') else value end"""
    )
    header = lambda key, text: f"struct('{key}' as key, cast({text} as binary) as value)"
    last = "concat('h', kafka_offset)"
    headers = F.expr(
        f"""case kafka_offset % 5 when 0 then null when 1 then filter(array({header('x', last)}), h -> false) when 2 then array({header('traceId', last)})
        when 3 then array({header('traceId', "'first'")}, {header('traceId', last)}, {header('x', "'other'")}) else array({header('traceId', last)}, {header('traceId', "'  '")}) end"""
    )
    e = e.withColumn("value", value).withColumn("value", damaged)
    return e.select(F.col("kafka_topic").alias("topic"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), F.col("document_id").cast("string").alias("key"), F.col("value").cast("binary").alias("value"), headers.alias("headers"))


def chunk_rows(spark, sf_dir) -> DataFrame:
    """A small stored chunk table: version 1 of each document holds 1 + doc_id % 4 chunks."""
    d = _table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") * 10 + 1).alias("document_version_id"), F.expr("cast(substring(source, 4) as bigint)").alias("tenant_id"), F.explode(F.expr("sequence(0, cast(doc_id % 4 as int))")).alias("chunk_no"))
    return rows.withColumn("content", F.expr("concat('old ', document_id, ' ', chunk_no)"))


def incoming_rows(spark, sf_dir) -> DataFrame:
    """Chunks to publish: for two documents in three, 1 + doc_id % 3 chunks of version 1, one in five of version 2."""
    d = _table(spark, sf_dir, "documents").filter("doc_id % 3 <> 2")
    rows = d.select(F.col("doc_id").alias("document_id"), F.expr("doc_id * 10 + case when doc_id % 5 = 4 and doc_id % 3 > 0 then 2 else 1 end").alias("document_version_id"), F.explode(F.expr("sequence(0, cast(doc_id % 3 as int))")).alias("chunk_no"))
    return rows.withColumn("content", F.expr("concat('new ', document_id, ' ', chunk_no)"))


def faulty_rows(spark, sf_dir) -> DataFrame:
    """``incoming_rows`` with faults: gaps, repeated numbers, blank contents, mixed and unknown documents."""
    document = F.expr("case when document_id % 19 = 0 and chunk_no = 1 then document_id + 1 else document_id + if(document_id % 23 = 0, 100000000, 0) end")
    number = F.expr("cast(chunk_no + case when document_id % 7 = 0 then 1 when document_id % 11 = 0 and chunk_no = 1 then -1 else 0 end as int)")
    return incoming_rows(spark, sf_dir).select(document.alias("document_id"), "document_version_id", number.alias("chunk_no"), F.expr("if(document_id % 13 = 0, ' ', content)").alias("content"))


#: The same tables for DuckDB, as a WITH prefix.
SQL = r"""
nd AS (SELECT count(*) AS n FROM documents),
document AS (
  SELECT doc_id AS id, CAST(substring(source, 4) AS BIGINT) AS tenant_id,
    CASE WHEN doc_id % 10 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' + to_seconds(doc_id) END AS deleted_at,
    1 + doc_id % 3 AS latest_upload_version_no, CASE WHEN doc_id % 5 = 1 THEN 0 ELSE 1 END::BIGINT AS latest_embedding_version_no,
    CASE WHEN doc_id % 5 = 1 THEN NULL ELSE doc_id * 10 + 1 END AS searchable_version_id
  FROM documents),
version AS (
  SELECT doc_id * 10 + ver AS id, doc_id AS document_id, ver AS version_no, ver AS embedding_version_no, n_chars AS file_size,
    CASE WHEN (doc_id * 10 + ver) % 41 = 0 THEN 'sha256:bad' ELSE 'sha256:' || sha256(text) END AS content_hash,
    CASE doc_id % 7 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'text/markdown' ELSE 'text/plain' END AS mime_type
  FROM (SELECT *, unnest(range(1, 2 + doc_id % 3)) AS ver FROM documents)),
ev0 AS (SELECT *, event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS k FROM events, nd),
event AS (
  SELECT 'e' || k AS source_event_id,
    CASE WHEN k % 23 = 0 THEN 'UNKNOWN' WHEN k % 11 = 0 THEN 'DOCUMENT_DELETED' ELSE 'INDEXING_REQUESTED' END AS event_type,
    CASE WHEN k % 50 = 0 THEN 2 ELSE 1 END AS schema_version, k % n AS document_id,
    CASE WHEN k % 29 = 0 OR k % 11 = 0 THEN NULL WHEN k % 31 = 0 THEN ((k + 1) % n) * 10 + 1 ELSE (k % n) * 10 + 1 + (k // n + k) % 4 END AS document_version_id,
    (k % n) % 20 + CASE WHEN k % 37 = 0 THEN 1 ELSE 0 END AS tenant_id,
    'doc.events.v1' AS kafka_topic, CAST((k % n) % 4 AS INT) AS kafka_partition, event_id AS kafka_offset
  FROM ev0),
job AS (
  SELECT 'e' || event_id AS source_event_id, event_id % n AS document_id, (event_id % n) * 10 + 1 AS document_version_id,
    (['PENDING', 'PROCESSING', 'RETRY_WAIT', 'COMPLETED', 'FAILED'])[CAST((event_id // 7) % 5 + 1 AS INT)] AS status, CAST(event_id % 7 AS INT) AS attempt_count,
    CASE WHEN (event_id // 7) % 5 = 2 THEN TIMESTAMP '2024-03-01 00:00:00' + to_seconds(event_id % 100 - 50) END AS next_retry_at,
    CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-02-28 00:00:00' END AS started_at, event_id AS kafka_offset, event_id
  FROM events, nd WHERE event_id % 10 <> 9),
md AS (SELECT doc_id, '# ' || source || chr(10) || '## ' || lang || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents),
line AS (
  SELECT doc_id, i, l, regexp_full_match(l, '#{1,6}[ \t\n\x0b\f\r]+.*') AS h, regexp_matches(l, '[^\s\p{Z}\x1c-\x1f]') AS filled
  FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(content, chr(10)) AS ls FROM md))),
marked AS (
  SELECT *, CASE WHEN h THEN len(regexp_extract(l, '^#{1,6}')) END AS lvl,
    sum(CASE WHEN h OR NOT filled THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM line),
placed AS (
  SELECT *, max(CASE WHEN lvl = 1 THEN i END) OVER w AS p1, max(CASE WHEN lvl = 2 THEN i END) OVER w AS p2,
    arg_max(CASE WHEN lvl = 1 THEN trim(regexp_replace(l, '^#+[ \t]+', '')) END, CASE WHEN lvl = 1 THEN i END) OVER w AS t1,
    arg_max(CASE WHEN lvl = 2 THEN trim(regexp_replace(l, '^#+[ \t]+', '')) END, CASE WHEN lvl = 2 THEN i END) OVER w AS t2
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pieces AS (
  SELECT doc_id, i, g, 'HEADING' AS type, trim(regexp_replace(l, '^#+[ \t]+', '')) AS text, t1, t2, p1, p2, lvl FROM placed WHERE h
  UNION ALL
  SELECT doc_id, min(i), g, 'PARAGRAPH', string_agg(regexp_replace(l, '^[\s\p{Z}\x1c-\x1f]+|[\s\p{Z}\x1c-\x1f]+$', '', 'g'), ' ' ORDER BY i), any_value(t1), any_value(t2), any_value(p1), any_value(p2), NULL
  FROM placed WHERE NOT h AND filled GROUP BY doc_id, g),
block AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS block_order, type, text,
    CASE WHEN t2 IS NOT NULL AND p2 > coalesce(p1, 0) THEN concat_ws(' > ', t1, t2) ELSE coalesce(t1, '') END AS path
  FROM pieces)
"""
