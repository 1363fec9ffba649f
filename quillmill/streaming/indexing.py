"""The event stream: micro-batches over a snapshot store; a replayed batch changes nothing."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import events, jobs, publication
from ..plans.indexing import CHUNK, State, apply_deletions, rejected_deletions, run_ordered
from ..sources.store import Delta, Key, LostRace, SnapshotStore
from .metrics import Clock, job_meters

DOCUMENT = "id long, tenant_id long, latest_upload_version_no long, latest_embedding_version_no long, searchable_version_id long, deleted_at timestamp"
VERSION = "id long, document_id long, version_no long, embedding_version_no long, source_object_key string, mime_type string, file_size long, content_hash string, extracted_metadata string, chunk_count int, indexed_at timestamp"
TABLES = {"documents": DOCUMENT, "versions": VERSION, "jobs": jobs.JOB, "chunks": CHUNK}
REJECTED = "topic string, partition int, offset long, value string, reason string, trace_id string"
METRIC = "batch long, name string, value double"
KEYED = {"documents": Key("id", "id"), "versions": Key("id", "id"), "jobs": Key("document_id", "source_event_id"), "chunks": Key("document_id", "document_id"), "holders": Key("document_id", "document_id")}
#: Documents that have chunks: what the sweep looks at instead of the chunks.
HOLDER = "document_id long, n_chunks long"


def open_store(spark, root: str) -> SnapshotStore:
    """The store of the stream's tables: state by key, rejected records and metrics appended."""
    return SnapshotStore(spark, root, keyed=KEYED, appended=("rejected", "metrics"))


class HealthGate:
    """Holds a batch back while ``probe`` says the stores can't be reached; counts the pauses."""

    def __init__(self, probe: Callable[[], bool], *, every_seconds: float = 5.0, sleep=time.sleep):
        self.probe, self.every, self.sleep, self.paused = probe, every_seconds, sleep, 0

    def wait(self) -> None:
        held = False
        while not self._healthy():
            self.paused += not held
            held = True
            self.sleep(self.every)

    def _healthy(self) -> bool:
        try:
            return bool(self.probe())
        except Exception:  # a probe that fails says no
            return False


def _touched(store: SnapshotStore, documents: DataFrame, wanted: DataFrame, keep) -> State:
    """What the tables hold about some documents, and the versions ``wanted`` (one column of ids): only those buckets are read."""
    read = lambda name, keys: keep(store.read(name, TABLES[name], keys), f"was-{name}")
    docs, jobs_, chunks = read("documents", documents), read("jobs", documents), read("chunks", documents)
    ids = wanted.select(F.col(wanted.columns[0]).alias("id"))
    for some in (docs.select("searchable_version_id"), jobs_.filter(F.col("status").isin(*jobs.ACTIVE)).select("document_version_id")):
        ids = ids.unionByName(some.toDF("id"))
    return State(docs, read("versions", ids), jobs_, chunks)


def _changes(was: State, out: State) -> dict[str, Delta]:
    """What a run has changed, by table: whole rows, and for chunks all rows of the documents concerned."""
    found = {name: Delta(getattr(out, name).select(*getattr(was, name).columns).subtract(getattr(was, name))) for name in ("documents", "versions", "jobs")}
    slim = ["document_id", "document_version_id", "chunk_no", "content_hash", "embedded_at"]
    now, before = out.chunks.select(*slim), was.chunks.select(*slim)
    moved = now.exceptAll(before).unionByName(before.exceptAll(now)).select("document_id").distinct()
    rows = out.chunks.select(*was.chunks.columns).join(moved, "document_id", "left_semi")
    gone = moved.join(rows.select("document_id"), "document_id", "left_anti")
    held = rows.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    return found | {"chunks": Delta(rows, gone), "holders": Delta(held, gone)}


#: Times that a run starts over because another writer was faster.
RACES = 5


def _run(store: SnapshotStore, *args) -> None:
    """``_once``, again from the newest tables where another writer has committed meanwhile; after ``RACES`` times it raises."""
    for left in reversed(range(RACES)):
        try:
            return _once(store, *args)
        except LostRace:
            if not left:
                raise


def _once(store: SnapshotStore, batch: int | None, decoded: DataFrame, sources, now, rejected: DataFrame | None, config: Config, swept: int, how: dict) -> None:
    """One run over what the store's tables hold about the documents of ``decoded``, or, without a batch, of jobs that are due and of at most ``swept`` leftovers of deletions."""
    clock, since = Clock(), store.number()
    work = store.work_folder()

    def keep(df, name):
        """Written and read again: computed once, whoever is lost, and the plans of what follows stay short."""
        with clock.during(name):
            df.write.parquet(f"{work}/{name}")
        return store.spark.read.schema(df.schema).parquet(f"{work}/{name}")

    try:
        decoded = keep(decoded, "decoded")
        documents, left = decoded.select("document_id"), None
        if swept:
            deleted = keep(store.read("documents", DOCUMENT).filter("deleted_at is not null"), "deleted")
            left = keep(publication.sweep_candidates(deleted, store.read("holders", HOLDER, deleted.select("id")), swept), "left")
            due = store.read("jobs", jobs.JOB).filter(jobs.startable(now, config.max_attempts)).select("document_id")
            documents = keep(documents.unionByName(left.select("document_id")).unionByName(due), "concerned")
        was = _touched(store, documents, decoded.select("document_version_id"), keep)
        state = was if left is None else apply_deletions(was, left, now)
        out, dropped = run_ordered(state, decoded, sources, now, config=config, keep=keep, **how)
        out = State(*[keep(getattr(out, name).select(*getattr(was, name).columns), f"is-{name}") for name in TABLES])
        changes = _changes(was, out)
        seen = Observation()
        moved = keep(changes["jobs"].rows.withColumn("__now", now).observe(seen, *job_meters(config.max_attempts)), "moved").drop("__now")
        values = {k: float(n) for k, n in seen.get.items() if n} | clock.values()
        tables = changes | {"jobs": Delta(moved), "metrics": store.spark.createDataFrame([(batch, k, v) for k, v in values.items()], METRIC)}
        place = [F.col("kafka_topic").alias("topic"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), F.lit(None).cast("string").alias("value"), F.col("verdict").alias("reason"), "trace_id"]
        refused = dropped.select(*place)
        store.commit(batch, tables | {"rejected": refused if rejected is None else rejected.unionByName(refused)}, since=since)
    finally:
        store.drop_folder(work)


def batch_handler(store: SnapshotStore, sources, *, config: Config = DEFAULT, clock=None, gate: HealthGate | None = None, **how):
    """A function for ``foreachBatch``.  ``clock()`` gives a batch's time, one for all its rows.

    ``sources`` is an ``ObjectStore`` or a table (source_object_key, content).
    Corrupt records, unknown event types, refused deletions and requests that get
    no job go to the table ``rejected``, counts and times to ``metrics``; a failure of the store raises,
    and the batch is replayed from the checkpoint.  ``gate`` holds batches back.
    """
    clock = clock or _utc

    def handle(records: DataFrame, batch: int) -> None:
        if gate is not None:
            gate.wait()
        if batch <= store.last_batch():
            return
        decoded, corrupt = events.decode_events(records)
        odd = decoded.filter(events.route(F.col("event_type"), F.col("document_version_id")).isin("unknown", "drop"))
        reason = F.when(F.col("event_type") == "INDEXING_REQUESTED", "MISSING_DOCUMENT_VERSION_ID").otherwise("UNKNOWN_EVENT_TYPE")
        refused = rejected_deletions(decoded, store.read("documents", DOCUMENT, decoded.select("document_id")), config=config).withColumn("reason", F.col("error_code"))
        place = [F.col("kafka_topic").alias("topic"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), F.lit(None).cast("string").alias("value"), "reason", "trace_id"]
        bad = corrupt.select("topic", F.col("partition").cast("int").alias("partition"), F.col("offset").cast("long").alias("offset"), F.col("value").cast("string").alias("value"), F.lit("DESERIALIZATION").alias("reason"), F.lit(None).cast("string").alias("trace_id"))
        rejected = bad.unionByName(odd.withColumn("reason", reason).select(*place)).unionByName(refused.select(*place))
        _run(store, batch, decoded, sources, F.lit(clock()).cast("timestamp"), rejected, config, 0, how)

    return handle


def maintenance(store: SnapshotStore, sources, *, config: Config = DEFAULT, clock=None, **how):
    """Work that time alone calls for: jobs due for another try, and the sweep.  ``start_maintenance`` runs it on a timer, as may any scheduler."""
    clock = clock or _utc

    def tick() -> None:
        none = events.decode_events(store.spark.createDataFrame([], "topic string, partition int, offset long, key string, value string"))[0]
        _run(store, None, none, sources, F.lit(clock()).cast("timestamp"), None, config, config.sweep_limit, how)
        store.compact(TABLES | {"holders": HOLDER})

    return tick


def start_maintenance(spark, tick, checkpoint: str, seconds: int = DEFAULT.sweep_seconds):
    """``tick`` every so many seconds, as a stream of its own.  Where it meets a batch of the event stream, the later of the two starts over."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: tick()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def _utc() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC).replace(tzinfo=None)


def start(stream: DataFrame, checkpoint: str, handler, **trigger):
    """Run ``handler`` on the stream's micro-batches."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
