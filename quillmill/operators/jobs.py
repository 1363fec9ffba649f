"""The job state machine as projections over the job table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT

ACTIVE = ("PENDING", "PROCESSING", "RETRY_WAIT")
# The phases in order.
PHASES = ("DOWNLOADING", "PARSING", "CHUNKING", "EMBEDDING")
JOB = (
    "source_event_id string, document_id long, document_version_id long, status string, attempt_count int, next_retry_at timestamp, worker_id string, last_error_code string, "
    "last_error_message string, trace_id string, phase string, started_at timestamp, completed_at timestamp, updated_at timestamp, kafka_topic string, kafka_partition int, kafka_offset long"
)


def _set(jobs: DataFrame, when: Column, **values) -> DataFrame:
    """``values`` where ``when`` holds; all read the row as it was before."""
    when = F.coalesce(when, F.lit(False))
    types = dict(jobs.dtypes)
    put = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items() if c in types}
    return jobs.select(*[F.when(when, put[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in jobs.columns])


def insert_jobs_if_absent(jobs: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """New PENDING rows for events: none for an event that has a job, nor while a version has an active one; of several, the first offset."""
    fresh = events.join(jobs.select("source_event_id"), "source_event_id", "left_anti")
    busy = jobs.filter(F.col("status").isin(*ACTIVE)).select("document_version_id").distinct()
    fresh = fresh.join(busy, "document_version_id", "left_anti")
    for key in ("source_event_id", "document_version_id"):
        first = Window.partitionBy(key).orderBy("kafka_offset", "kafka_partition", "source_event_id")
        fresh = fresh.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    given = {"status": F.lit("PENDING"), "attempt_count": F.lit(0), "updated_at": now}
    return fresh.select(*[given[c].cast(t).alias(c) if c in given else F.col(c).cast(t).alias(c) if c in fresh.columns else F.lit(None).cast(t).alias(c) for c, t in jobs.dtypes])


def acquire_verdicts(events: DataFrame, jobs: DataFrame, inserted: DataFrame) -> DataFrame:
    """``verdict`` of each event's record: NEW, OTHER_ACTIVE (no job row), DUPLICATE (another record's job), REDELIVERY."""
    held = jobs.unionByName(inserted).select("source_event_id", F.struct("kafka_topic", "kafka_partition", "kafka_offset").alias("held_by"))
    new = inserted.select("source_event_id", F.lit(True).alias("is_new"))
    rows = events.join(held, "source_event_id", "left").join(new, "source_event_id", "left")
    same = F.col("held_by") == F.struct("kafka_topic", "kafka_partition", "kafka_offset")
    verdict = F.when(F.col("held_by").isNull(), "OTHER_ACTIVE").when(~same, "DUPLICATE").when(F.col("is_new"), "NEW").otherwise("REDELIVERY")
    return rows.withColumn("verdict", verdict).drop("held_by", "is_new")


def startable(now: Column, max_attempts: int = DEFAULT.max_attempts) -> Column:
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)
    return (F.col("attempt_count") < max_attempts) & (F.col("status").isin("PENDING", "PROCESSING") | ((F.col("status") == "RETRY_WAIT") & due))


def start_jobs(jobs: DataFrame, now: Column, *, worker_id=DEFAULT.worker_id, max_attempts=DEFAULT.max_attempts) -> DataFrame:
    return _set(jobs, startable(now, max_attempts), status="PROCESSING", attempt_count=F.col("attempt_count") + 1, next_retry_at=None, worker_id=worker_id, started_at=F.coalesce("started_at", now), updated_at=now)


def fail_exceeded(jobs: DataFrame, now: Column, *, max_attempts=DEFAULT.max_attempts) -> DataFrame:
    spent = F.col("status").isin("PENDING", "PROCESSING") & (F.col("attempt_count") >= max_attempts)
    return _set(jobs, spent, status="FAILED", last_error_code="MAX_ATTEMPTS_EXCEEDED", next_retry_at=None, completed_at=now, updated_at=now)


def complete_jobs(jobs: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """COMPLETED for the events in ``done``, whatever their status is."""
    marked = jobs.join(done.select("source_event_id").distinct().withColumn("__done", F.lit(True)), "source_event_id", "left").select(*jobs.columns, "__done")
    return _set(marked, F.col("__done"), status="COMPLETED", last_error_code=None, last_error_message=None, next_retry_at=None, completed_at=now, updated_at=now).drop("__done")


def fail_jobs_for_deleted(jobs: DataFrame, document_ids: DataFrame, now: Column) -> DataFrame:
    """Active jobs of the documents in ``document_ids`` (document_id) fail."""
    marked = jobs.join(document_ids.select("document_id").distinct().withColumn("__gone", F.lit(True)), "document_id", "left").select(*jobs.columns, "__gone")
    return _set(marked, F.col("__gone") & F.col("status").isin(*ACTIVE), status="FAILED", last_error_code="DOCUMENT_DELETED", next_retry_at=None, completed_at=now, updated_at=now).drop("__gone")


def record_failures(jobs: DataFrame, failures: DataFrame, now: Column, *, max_attempts=DEFAULT.max_attempts, base_delay=DEFAULT.base_delay_seconds) -> DataFrame:
    """Failures (source_event_id, error_code, error_message, permanent) of jobs in PROCESSING.

    Final if permanent or out of attempts; else the job waits for ``base_delay`` times its attempts.
    """
    f = failures.select("source_event_id", F.col("error_code").alias("__code"), F.col("error_message").alias("__message"), F.col("permanent").alias("__permanent"))
    marked = jobs.join(f, "source_event_id", "left").select(*jobs.columns, "__code", "__message", "__permanent")
    final = F.col("__permanent") | (F.col("attempt_count") >= max_attempts)
    wait = F.timestamp_add("SECOND", F.greatest(F.col("attempt_count"), F.lit(1)) * base_delay, now)
    hit = F.col("__code").isNotNull() & (F.col("status") == "PROCESSING")
    return _set(
        marked, hit, status=F.when(final, "FAILED").otherwise("RETRY_WAIT"), last_error_code=F.substring("__code", 1, 100), last_error_message=F.substring("__message", 1, 1000),
        completed_at=F.when(final, now), next_retry_at=F.when(~final, wait), updated_at=now,
    ).drop("__code", "__message", "__permanent")


def phase_of(stage: Column) -> Column:
    """Last phase entered, from the place of the stage that failed (null: none did)."""
    return F.when(stage.isNull() | (stage >= 15), PHASES[3]).when(stage >= 12, PHASES[2]).when(stage >= 9, PHASES[1]).when(stage >= 7, PHASES[0])
