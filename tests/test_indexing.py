import datetime
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillmill.config import Config
from quillmill.operators import events, jobs, publication
from quillmill.operators import embedding
from quillmill.sources.store import Delta, LostRace, bucket_of
from quillmill.streaming.indexing import METRIC, REJECTED, TABLES, HealthGate, batch_handler, maintenance, open_store

T0 = datetime.datetime(2024, 3, 1)


def record(offset, doc, version, kind="INDEXING_REQUESTED", event=None, tenant=7):
    value = json.dumps({"eventId": event or f"e{offset}", "eventType": kind, "schemaVersion": 1, "tenantId": tenant, "documentId": doc, "documentVersionId": version, "occurredAt": "2026-08-16T09:14:22Z"})
    return ("t", 0, offset, str(doc), value)


def records(spark, *rows):
    return spark.createDataFrame(list(rows), "topic string, partition int, offset long, key string, value string")


def test_decode_and_route(spark):
    good, bad = events.decode_events(records(spark, record(0, 1, 10), ("t", 0, 1, "x", "not-json"), ("t", 0, 2, "x", '{"eventId": "a"}')))
    assert good.count() == 1 and bad.count() == 2
    assert good.select(events.route(F.col("event_type"), F.col("document_version_id"))).first()[0] == "index"


def test_job_matrix(spark):
    now = F.lit(T0).cast("timestamp")
    rows = [(f"e{i}", i, i, s, a, r) for i, (s, a, r) in enumerate([("PENDING", 0, None), ("PROCESSING", 5, None), ("RETRY_WAIT", 1, T0), ("RETRY_WAIT", 1, T0 + datetime.timedelta(seconds=1)), ("COMPLETED", 1, None)])]
    table = spark.createDataFrame(rows, "source_event_id string, document_id long, document_version_id long, status string, attempt_count int, next_retry_at timestamp")
    assert [r["status"] for r in jobs.start_jobs(table, now).orderBy("source_event_id").collect()] == ["PROCESSING", "PROCESSING", "PROCESSING", "RETRY_WAIT", "COMPLETED"]
    assert [r["attempt_count"] for r in jobs.start_jobs(table, now).orderBy("source_event_id").collect()] == [1, 5, 2, 1, 1]
    assert [r["status"] for r in jobs.fail_exceeded(table, now).orderBy("source_event_id").collect()][1] == "FAILED"


def test_promotion_is_strict(spark):
    d = spark.createDataFrame([(1, None, 1, 11), (2, None, 2, 22), (3, T0, 0, None)], "id long, deleted_at timestamp, latest_embedding_version_no long, searchable_version_id long")
    v = spark.createDataFrame([(11, 1, 1), (12, 1, 2), (21, 2, 1), (22, 2, 2), (31, 3, 1)], "id long, document_id long, embedding_version_no long")
    p = spark.createDataFrame([(1, 12), (2, 21), (3, 31)], "document_id long, document_version_id long")
    assert [r["searchable_version_id"] for r in publication.promote(d, v, p).orderBy("id").collect()] == [12, 22, None]


def test_stream_batches_replay_and_delete(spark, tmp_path):
    text = b"# Title\nhello world"
    digest = "sha256:" + hashlib.sha256(text).hexdigest()
    store = open_store(spark, str(tmp_path / "store"))
    documents = spark.createDataFrame([(1, 7, 1, 0, None, None), (2, 7, 1, 0, None, None)], TABLES["documents"])
    versions = spark.createDataFrame([(10, 1, 1, 1, "a", "text/markdown", 19, digest, None, None, None), (20, 2, 1, 1, "b", "text/plain", 19, "sha256:bad", None, None, None)], TABLES["versions"])
    store.commit(0, {"documents": documents, "versions": versions})
    sources = spark.createDataFrame([("a", text), ("b", text)], "source_object_key string, content binary")
    handle = batch_handler(store, sources, config=Config(dimensions=8), clock=lambda: T0)
    read = lambda name: store.read(name, TABLES[name]).collect()
    one = records(spark, record(0, 1, 10), record(1, 1, 10, event="e0"), record(2, 2, 20), ("t", 0, 3, "x", "not-json"), record(4, 1, None))
    handle(one, 1)
    assert {r["source_event_id"]: (r["status"], r["last_error_code"], r["phase"]) for r in read("jobs")} == {"e0": ("COMPLETED", None, "EMBEDDING"), "e2": ("FAILED", "HASH_MISMATCH", "DOWNLOADING")}
    chunks = read("chunks")
    assert len(chunks) == 1 and len(chunks[0]["embedding"]) == 8 and chunks[0]["tenant_id"] == 7
    assert [r["searchable_version_id"] for r in sorted(read("documents"))] == [10, None]
    before = sorted(os.listdir(tmp_path / "store" / "chunks"))
    handle(one, 1)
    assert sorted(os.listdir(tmp_path / "store" / "chunks")) == before
    handle(records(spark, record(5, 1, None, "DOCUMENT_DELETED")), 2)
    assert read("chunks") == [] and len(read("jobs")) == 2


def opened(spark, tmp_path, n=3):
    """A store of n documents of one version each, and their sources."""
    store = open_store(spark, str(tmp_path / "store"))
    text = b"# Title\nhello world"
    digest = "sha256:" + hashlib.sha256(text).hexdigest()
    documents = spark.createDataFrame([(i, 7, 1, 0, None, None) for i in range(1, n + 1)], TABLES["documents"])
    versions = spark.createDataFrame([(10 * i, i, 1, 1, f"k{i}", "text/markdown", 19, digest, None, None, None) for i in range(1, n + 1)], TABLES["versions"])
    store.commit(0, {"documents": documents, "versions": versions})
    sources = spark.createDataFrame([(f"k{i}", text) for i in range(1, n + 1)], "source_object_key string, content binary")
    return store, sources, lambda name: store.read(name, TABLES.get(name) or {"rejected": REJECTED, "metrics": METRIC}[name]).collect()


def test_records_of_a_document_keep_their_order(spark, tmp_path):
    """Index then delete leaves no chunk; delete then index leaves the chunks; others aren't touched."""
    store, sources, read = opened(spark, tmp_path)
    handle = batch_handler(store, sources, config=Config(dimensions=8), clock=lambda: T0)
    handle(records(spark, record(0, 1, 10), record(1, 1, None, "DOCUMENT_DELETED"), record(2, 2, None, "DOCUMENT_DELETED"), record(3, 2, 20), record(4, 3, 30), record(5, 9, None, "DOCUMENT_DELETED")), 1)
    assert sorted(r["document_id"] for r in read("chunks")) == [2, 3]
    assert {r["source_event_id"]: r["status"] for r in read("jobs")} == {"e0": "COMPLETED", "e3": "COMPLETED", "e4": "COMPLETED"}
    assert [(r["offset"], r["reason"]) for r in read("rejected")] == [(5, "DOCUMENT_NOT_FOUND")]
    assert {r["name"]: r["value"] for r in read("metrics") if "seconds" not in r["name"]} == {"jobs_completed": 3.0}
    assert {r["name"] for r in read("metrics") if r["value"] > 0} >= {"seconds_downloading", "seconds_parsing", "seconds_chunking", "seconds_embedding", "seconds_publishing", "batch_seconds"}


def test_a_provider_error_is_one_documents(spark, tmp_path):
    """A refusal is final, another failure is tried again by time alone; neither stops the other documents."""
    store, sources, read = opened(spark, tmp_path)
    sources = sources.unionByName(sources.limit(0))
    texts = {"k1": b"refuse me", "k2": b"fail me", "k3": b"fine"}
    sources = spark.createDataFrame(list(texts.items()), "source_object_key string, content binary")
    versions = spark.createDataFrame([(10 * i, i, 1, 1, f"k{i}", "text/plain", 9, "sha256:" + hashlib.sha256(texts[f"k{i}"]).hexdigest(), None, None, None) for i in (1, 2, 3)], TABLES["versions"])
    store.commit(1, {"versions": versions})

    def provider(some):
        if any("refuse" in x for x in some):
            raise embedding.EmbeddingRejected("no")
        if any("fail" in x for x in some):
            raise ConnectionError("later")
        return [[1.0] * 8 for _ in some]

    handle = batch_handler(store, sources, config=Config(dimensions=8), clock=lambda: T0, provider=provider)
    handle(records(spark, record(0, 1, 10), record(1, 2, 20), record(2, 3, 30)), 2)
    assert {r["source_event_id"]: (r["status"], r["last_error_code"]) for r in read("jobs")} == {"e0": ("FAILED", "EMBEDDING_REQUEST_REJECTED"), "e1": ("RETRY_WAIT", "ConnectionError"), "e2": ("COMPLETED", None)}
    assert [r["document_id"] for r in read("chunks")] == [3]
    counts = lambda: {r["name"]: r["value"] for r in read("metrics") if "seconds" not in r["name"]}
    assert counts() == {"jobs_failed": 1.0, "failed_EMBEDDING_REQUEST_REJECTED": 1.0, "jobs_retry_wait": 1.0, "jobs_completed": 1.0}
    # No record comes, but time: the waiting job runs, and a deleted document's chunks are swept.
    gone = spark.createDataFrame([(i, 7, 1, 0, None, T0 if i == 3 else None) for i in (1, 2, 3)], TABLES["documents"])
    store.commit(None, {"documents": gone})
    maintenance(store, sources, config=Config(dimensions=8), clock=lambda: T0 + datetime.timedelta(hours=1), provider=lambda some: [[1.0] * 8 for _ in some])()
    assert {r["source_event_id"]: r["status"] for r in read("jobs")} == {"e0": "FAILED", "e1": "COMPLETED", "e2": "COMPLETED"}
    assert [r["document_id"] for r in read("chunks")] == [2] and store.last_batch() == 2
    assert counts()["retry_attempt_1"] == 1.0


def test_processors_are_plugs(spark, tmp_path):
    """Each gets the context and the chunks in order; what one raises is its document's failure, message and all, and is tried again."""
    from quillmill.operators import processing

    store, sources, read = opened(spark, tmp_path)

    def note(context, chunks):
        if context["document_id"] == 2:
            raise RuntimeError("simulated failure")
        assert [c["chunk_no"] for c in chunks] == list(range(len(chunks))) and set(context) == set(processing.CONTEXT)
        return [c | {"content": f"{c['content']} of {context['document_id']}, version {context['version_no']}"} for c in chunks]

    stages = [processing.each_document(note, adds="note string"), processing.embedder(dimensions=8)]
    handle = batch_handler(store, sources, config=Config(dimensions=8), clock=lambda: T0, processors=stages)
    handle(records(spark, record(0, 1, 10), record(1, 2, 20)), 1)
    assert {r["source_event_id"]: (r["status"], r["last_error_code"], r["last_error_message"], r["phase"]) for r in read("jobs")} == {"e0": ("COMPLETED", None, None, "EMBEDDING"), "e1": ("RETRY_WAIT", "RuntimeError", "simulated failure", "EMBEDDING")}
    assert [r["content"] for r in read("chunks")] == ["[Title]\nTitle\n\nhello world of 1, version 1"]


def test_stream_meters(spark, tmp_path):
    """Starts after the first, batches, rows and failures of a named stream."""
    import time

    from quillmill.streaming.metrics import StreamMeters

    meters = StreamMeters()
    spark.streams.addListener(meters)
    schema = "a int"
    spark.createDataFrame([(1,), (2,)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    try:
        for n in range(3):
            def handle(df, batch, n=n):
                df.collect()
                if n == 1:
                    raise OSError("away")

            if n == 1:
                spark.createDataFrame([(3,)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            query = spark.readStream.schema(schema).json(str(tmp_path / "in")).writeStream.queryName("documents").foreachBatch(handle).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            try:
                query.awaitTermination(60)
            except Exception:
                assert n == 1
        until = time.time() + 30
        while time.time() < until and (meters.rows["documents"] < 3 or not meters.failures):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(meters)
    assert meters.restarts == {"documents": 2} and meters.failures == {"documents": 1} and meters.rows["documents"] == 3
    assert meters.millis["documents", "addBatch"] > 0


def test_a_commit_that_breaks_off_leaves_the_last_one(spark, tmp_path, monkeypatch):
    store, _, read = opened(spark, tmp_path)
    rows = spark.createDataFrame([(7, 10 * i, i, 0, "c", "h", 1, None, None, None, [0.0], T0) for i in (1, 2, 3)], TABLES["chunks"])
    store.commit(1, {"chunks": rows})
    was = sorted(os.listdir(tmp_path / "store"))

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "rename":
                raise OSError("lost")
            return getattr(self.fs, name)

    fs = store._fs
    store._fs = Broken(fs)
    try:
        store.commit(2, {"chunks": rows.limit(0)})
        raise AssertionError
    except OSError:
        store._fs = fs
    assert store.last_batch() == 1 and len(read("chunks")) == 3
    assert [x for x in sorted(os.listdir(tmp_path / "store")) if not x.startswith("_aside") and not x.startswith("._aside")] == was
    # A delta replaces its groups and leaves the others; one that is emptied goes; old parts go when nothing names them.
    for batch in range(2, 8):
        store.commit(batch, {"chunks": Delta(rows.filter("document_id = 1").withColumn("content", F.lit(f"c{batch}")), rows.filter("document_id = 2").select("document_id"))})
    assert sorted((r["document_id"], r["content"]) for r in read("chunks")) == [(1, "c7"), (3, "c")]
    one = rows.select("document_id").filter("document_id = 3")
    assert [r["document_id"] for r in store.read("chunks", TABLES["chunks"], one).collect()] == [3]
    assert store.compact(TABLES, most=3) == {"chunks": len({bucket(spark, 1), bucket(spark, 2)})} and store.compact(TABLES, most=3) == {}
    assert sorted((r["document_id"], r["content"]) for r in read("chunks")) == [(1, "c7"), (3, "c")]
    for batch in range(8, 12):
        store.commit(batch, {"chunks": rows.filter("document_id = 3")})
    assert [r["document_id"] for r in read("chunks")] == [3]
    assert len([x for x in os.listdir(tmp_path / "store") if x.startswith("_pointer.")]) == 3 and len(os.listdir(tmp_path / "store" / "chunks")) <= 4
    # Of two that computed from the same tables, the later one must start over.
    since = store.number()
    store.commit(12, {"chunks": rows}, since=since)
    with pytest.raises(LostRace):
        store.commit(13, {"chunks": rows}, since=since)


def bucket(spark, document):
    return spark.createDataFrame([(document,)], "document_id long").select(bucket_of("document_id")).first()[0]


def written(root):
    """Bytes of data below a folder, by file."""
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet") and "_work" not in d}


def test_bytes_written_dont_grow_with_the_tables(spark, tmp_path):
    """A batch of one event writes as much beside 3,000 documents as beside 30, and opens no more of their buckets."""
    size = {}
    for n in (30, 3_000):
        store, sources, read = opened(spark, tmp_path / str(n), n)
        handle = batch_handler(store, sources, config=Config(dimensions=8), clock=lambda: T0)
        before = written(tmp_path / str(n))
        handle(records(spark, record(0, 1, 10)), 1)
        after = written(tmp_path / str(n))
        size[n] = sum(v for k, v in after.items() if k not in before)
        assert [r["document_id"] for r in read("chunks")] == [1] and len(read("documents")) == n
        files = store.read("documents", TABLES["documents"], spark.createDataFrame([(1,)], "id long")).inputFiles()
        assert {f.split("__bucket=")[1].split("/")[0] for f in files} == {str(bucket(spark, 1))}
    assert size[3_000] < 1.2 * size[30], size


def test_a_sweep_reads_chunks_of_deleted_documents_alone(spark, tmp_path, monkeypatch):
    store, sources, read = opened(spark, tmp_path, 12)
    handle = batch_handler(store, sources, config=Config(dimensions=8), clock=lambda: T0)
    handle(records(spark, *[record(i, i, 10 * i) for i in range(1, 9)]), 1)
    rows = store.read("documents", TABLES["documents"])
    gone = rows.filter("id in (3, 11)").withColumn("deleted_at", F.lit(T0))
    store.commit(None, {"documents": Delta(gone)})
    seen = {}
    real = type(store).read

    def spy(self, table, schema, keys=None):
        out = real(self, table, schema, keys)
        seen.setdefault(table, set()).update(out.inputFiles() if keys is not None else ["all"])
        return out

    monkeypatch.setattr(type(store), "read", spy)
    tick = maintenance(store, sources, config=Config(dimensions=8), clock=lambda: T0)
    tick()
    assert {f.split("__bucket=")[1].split("/")[0] for f in seen["chunks"]} == {str(bucket(spark, 3))}
    monkeypatch.undo()
    assert sorted(r["document_id"] for r in read("chunks")) == [i for i in range(1, 9) if i != 3]
    monkeypatch.setattr(type(store), "read", spy)
    seen.clear()
    tick()
    assert seen["chunks"] == set()  # nothing is left to sweep, so no chunk is read


def simulate(versions, sequence):
    """Each record taken alone, in order: jobs by event, chunks' versions by document, searchable versions, refusals."""
    jobs_, chunks, searchable, refused = {}, set(), {}, []
    for offset, doc, version, kind, event in sequence:
        if kind == "DOCUMENT_DELETED":
            for j in jobs_.values():
                if j["document"] == doc and j["status"] in ("PENDING", "PROCESSING", "RETRY_WAIT"):
                    j |= {"status": "FAILED", "code": "DOCUMENT_DELETED"}
            chunks = {v for v in chunks if versions[v]["document"] != doc}
            continue
        if event in jobs_:
            refused.append((offset, "DUPLICATE"))
        elif any(j["version"] == version and j["status"] == "RETRY_WAIT" for j in jobs_.values()):
            refused.append((offset, "OTHER_ACTIVE"))
        else:
            how = versions[version]["fails"]
            jobs_[event] = {"document": doc, "version": version, "status": {None: "COMPLETED", "HASH_MISMATCH": "FAILED"}.get(how, "RETRY_WAIT"), "code": how}
            if how is None:
                chunks.add(version)
                old = searchable.get(doc)
                if old is None or versions[old]["emb"] < versions[version]["emb"]:
                    searchable[doc] = version
    return {e: (j["status"], j["code"]) for e, j in jobs_.items()}, chunks, searchable, sorted(refused)


def test_any_sequence_is_as_if_taken_one_by_one(spark, tmp_path):
    """Requests, repeats and deletions of three documents in one batch and the next end as a simulation of each record alone does."""
    rng = random.Random(20)
    text = b"# Title\nhello world"
    digest = "sha256:" + hashlib.sha256(text).hexdigest()
    versions = {10 * d + v: {"document": d, "emb": v, "fails": None} for d in (1, 2, 3) for v in (1, 2)}
    versions[12]["fails"], versions[21]["fails"] = "HASH_MISMATCH", "DownloadException"
    store = open_store(spark, str(tmp_path / "store"))
    rows = [(i, x["document"], x["emb"], x["emb"], f"k{i}" if x["fails"] != "DownloadException" else "missing", "text/markdown", 19, "sha256:bad" if x["fails"] == "HASH_MISMATCH" else digest, None, None, None) for i, x in versions.items()]
    store.commit(0, {"documents": spark.createDataFrame([(i, 7, 2, 0, None, None) for i in (1, 2, 3)], TABLES["documents"]), "versions": spark.createDataFrame(rows, TABLES["versions"])})
    sources = spark.createDataFrame([(f"k{i}", text) for i in versions], "source_object_key string, content binary")
    sequence = []
    for offset in range(14):
        doc = rng.choice((1, 2, 3))
        kind = "DOCUMENT_DELETED" if rng.random() < 0.25 else "INDEXING_REQUESTED"
        again = [x for x in sequence if x[1] == doc and x[3] == kind == "INDEXING_REQUESTED"]
        if again and rng.random() < 0.2:
            _, _, version, _, event = rng.choice(again)
        else:
            version, event = 10 * doc + rng.choice((1, 2)), f"e{offset}"
        sequence.append((offset, doc, version, kind, event))
    handle = batch_handler(store, sources, config=Config(dimensions=8), clock=lambda: T0)
    for batch, part in ((1, sequence[:10]), (2, sequence[10:])):
        handle(records(spark, *[record(o, d, v if k == "INDEXING_REQUESTED" else None, k, e) for o, d, v, k, e in part]), batch)
    read = lambda name: store.read(name, TABLES.get(name) or REJECTED).collect()
    jobs_, chunks, searchable, refused = simulate(versions, sequence)
    assert {r["source_event_id"]: (r["status"], r["last_error_code"]) for r in read("jobs")} == jobs_
    assert {r["document_version_id"] for r in read("chunks")} == chunks
    assert {r["id"]: r["searchable_version_id"] for r in read("documents") if r["searchable_version_id"]} == searchable
    assert sorted((r["offset"], r["reason"]) for r in read("rejected")) == refused and refused


def test_rounds(spark):
    """Records that depend on each other keep their order in rounds, and no document has more of them than it needs."""
    rng = random.Random(3)
    rows = [(o, rng.randrange(4), None if rng.random() < 0.2 else rng.randrange(3), 0) for o in range(120)]
    kind = lambda v: "DOCUMENT_DELETED" if v is None else "INDEXING_REQUESTED"
    df = spark.createDataFrame([(o, 0, d, v, kind(v)) for o, d, v, _ in rows], "kafka_offset long, kafka_partition int, document_id long, document_version_id long, event_type string")
    got = {r["kafka_offset"]: r["round"] for r in events.ordered_rounds(df).collect()}
    assert len(got) == len(rows)
    for a in rows:
        later = [b for b in rows if b[1] == a[1] and b[0] > a[0]]
        assert all(got[b[0]] > got[a[0]] for b in later if a[2] is None or b[2] is None or a[2] == b[2])
    for d in range(4):
        mine = sorted({got[r[0]] for r in rows if r[1] == d})
        assert mine == list(range(1, len(mine) + 1))


def test_health_gate_waits():
    answers, slept = iter([False, OSError, True, True]), []

    def probe():
        x = next(answers)
        if x is OSError:
            raise OSError
        return x

    gate = HealthGate(probe, sleep=slept.append)
    gate.wait()
    gate.wait()
    assert slept == [5.0, 5.0] and gate.paused == 1


def test_trace_id_header(spark):
    """The last header wins over the payload; white space of any kind around it goes, and a blank one counts as none."""
    value = json.dumps({"eventId": "e", "eventType": "X", "schemaVersion": 1, "tenantId": 1, "documentId": 1, "occurredAt": "2026-08-16T09:14:22Z", "traceId": "payload"})
    rows = [("t", 0, i, "k", value, h) for i, h in enumerate([None, [], [("traceId", b"a"), ("traceId", "\u3000b\u2003".encode())], [("traceId", "\u3000".encode())], [("other", b"x")]])]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, key string, value string, headers array<struct<key:string,value:binary>>")
    assert [r["trace_id"] for r in events.decode_events(df)[0].orderBy("kafka_offset").collect()] == ["payload", "payload", "b", "payload", "payload"]


def test_sources_by_key(spark, tmp_path):
    from quillmill.sources.objects import load_sources

    os.makedirs(tmp_path / "objects" / "a")
    (tmp_path / "objects" / "a" / "x.md").write_bytes(b"hello")
    assert [(r["source_object_key"], bytes(r["content"]), r["content_length"]) for r in load_sources(spark, str(tmp_path / "objects")).collect()] == [("a/x.md", b"hello", 5)]
