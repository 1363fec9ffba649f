"""One batch of events from records to published chunks; errors are columns, tables go in and come out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..errors import ERRORS, is_permanent
from ..operators import chunking, events, jobs, parsing, processing, publication
from ..sources.objects import ContentTable

CHUNK = "tenant_id long, document_version_id long, document_id long, chunk_no int, content string, content_hash string, token_count int, page_from int, page_to int, section_path string, embedding array<float>, embedded_at timestamp"


@dataclass(frozen=True)
class State:
    documents: DataFrame
    versions: DataFrame
    jobs: DataFrame
    chunks: DataFrame


def apply_deletions(state: State, ids: DataFrame, now: Column) -> State:
    """Fail the active jobs and drop all chunks of documents in ``ids`` (document_id); the documents stay as they are."""
    return replace(state, jobs=jobs.fail_jobs_for_deleted(state.jobs, ids, now), chunks=publication.delete_documents(state.chunks, ids))


def sweep(state: State, now: Column, limit: int = DEFAULT.sweep_limit) -> State:
    """Deletion again for deleted documents that still have chunks."""
    return apply_deletions(state, publication.sweep_candidates(state.documents, state.chunks, limit), now)


def publish(state: State, rows: DataFrame, done: DataFrame, now: Column) -> State:
    """All effects of publishing ``rows``, computed before any is stored."""
    chunks = publication.delete_trailing(publication.upsert_chunks(state.chunks, rows, state.documents), rows)
    return State(publication.promote(state.documents, state.versions, rows), publication.complete_versions(state.versions, rows, now), jobs.complete_jobs(state.jobs, done, now), chunks)


def run_ordered(state: State, decoded: DataFrame, sources, now: Column, *, config: Config = DEFAULT, keep=lambda df, name: df, **how) -> tuple[State, DataFrame]:
    """One micro-batch, each document's records in order of their offsets: ``run_batch`` for each round of ``events.ordered_rounds``.

    All records of a document have one key, hence one partition.  Jobs that are
    due for another try run in the first round.  There are as many rounds as one
    document has records that depend on each other; without any, one still runs.
    """
    rounds = keep(events.ordered_rounds(decoded), "rounds")
    last, dropped = rounds.agg(F.max("round")).first()[0] or 1, None
    for n in range(1, last + 1):
        named = lambda df, name, n=n: keep(df, f"{n}-{name}")
        state, some = run_batch(state, rounds.filter(F.col("round") == n).drop("round"), sources, now, config=config, keep=named, **how)
        dropped = some if dropped is None else dropped.unionByName(some)
        if n < last:
            state = State(*[named(getattr(state, x), f"out-{x}") for x in ("documents", "versions", "jobs", "chunks")])
    return state, dropped


def run_batch(state: State, decoded: DataFrame, sources, now: Column, *, config: Config = DEFAULT, registry=None, provider=None, processors=None, keep=lambda df, name: df) -> tuple[State, DataFrame]:
    """Deletions and index requests that don't depend on each other, and the requests that get no job, with ``verdict``.

    A request gets none while another event's job is active for its version
    (OTHER_ACTIVE), or if its event has one from another record (DUPLICATE).

    ``decoded``: rows of ``events.decode_events``; ``sources``: an ``ObjectStore``,
    or a table (source_object_key, content).  ``state`` may hold no more than what
    concerns the events' documents.  Its startable jobs run along.
    ``processors``: the plugs between chunking and publication (``operators.processing``), embedding by ``provider`` if none are given.
    ``keep(df, name)`` may store an intermediate result, so that it isn't
    computed for each of its uses.
    """
    registry = registry or parsing.ParserRegistry()
    processors = [processing.embedder(provider, dimensions=config.dimensions)] if processors is None else processors
    kind = events.route(F.col("event_type"), F.col("document_version_id"))
    routed = keep(decoded.withColumn("route", kind), "routed")
    deletions = keep(events.validate_deletions(routed.filter("route = 'delete'"), state.documents, config=config), "deletions")
    state = apply_deletions(state, deletions.filter("error_code is null").select("document_id").distinct(), now)

    wanted = routed.filter("route = 'index'").drop("route")
    new = keep(jobs.insert_jobs_if_absent(state.jobs, wanted, now), "new")
    dropped = keep(jobs.acquire_verdicts(wanted, state.jobs, new).filter(F.col("verdict").isin("OTHER_ACTIVE", "DUPLICATE")), "dropped")
    before = state.jobs.unionByName(new)
    mine = before.filter(jobs.startable(now, config.max_attempts)).select("source_event_id")
    table = keep(jobs.start_jobs(jobs.fail_exceeded(before, now, max_attempts=config.max_attempts), now, worker_id=config.worker_id, max_attempts=config.max_attempts), "started")
    started = table.join(mine, "source_event_id", "left_semi").filter("status = 'PROCESSING'")
    # Event fields that a job doesn't hold come from the batch; a job tried again passed those checks, or ended, before.
    extra = wanted.groupBy("source_event_id").agg(F.min("schema_version").alias("schema_version"), F.min("tenant_id").alias("tenant_id"))
    tenants = state.documents.select(F.col("id").alias("t_id"), F.col("tenant_id").alias("t_tenant"))
    work = started.join(extra, "source_event_id", "left").join(tenants, F.col("document_id") == F.col("t_id"), "left")
    work = work.select("source_event_id", "document_id", "document_version_id", F.coalesce("schema_version", F.lit(config.schema_versions[0])).alias("schema_version"), F.coalesce("tenant_id", "t_tenant").alias("tenant_id"))
    checked = events.validate_events(work, state.versions, state.documents, config=config)
    keys = state.versions.select(F.col("id").alias("k_id"), "source_object_key")
    fine = checked.filter("error_code is null").join(keys, F.col("document_version_id") == F.col("k_id"))
    loaded = (ContentTable(sources) if isinstance(sources, DataFrame) else sources).load(fine)
    code = F.coalesce("load_error", F.when(F.col("actual_hash") != F.col("content_hash"), "HASH_MISMATCH"))
    loaded = keep(loaded.withColumn("error_code", code).drop("load_error", "actual_hash"), "loaded")
    parsed = keep(parsing.parse_documents(loaded.filter("error_code is null"), registry, key="source_event_id", timeout=config.parse_timeout_seconds), "parsed")
    good = parsed.filter("parse_error is null")
    overlap = {"overlap": config.overlap} if config.strategy == "PARAGRAPH_OVERLAP" else {}
    cut = chunking.chunk(good, config.strategy, key="source_event_id", max_tokens=config.max_tokens, tokenizer=config.tokenizer, **overlap)
    guard = keep(chunking.guard_chunks(good, config.strategy, key="source_event_id", max_chunks=config.max_chunks, max_total_tokens=config.max_total_tokens, max_tokens=config.max_tokens, tokenizer=config.tokenizer, **overlap), "guard")
    passed = cut.join(guard.filter("error_code is null").select("source_event_id"), "source_event_id", "left_semi")
    about = started.select("source_event_id", "document_id", "document_version_id")
    context = about.join(state.versions.select(F.col("id").alias("document_version_id"), "version_no"), "document_version_id", "left")
    vectors = processing.run_all(passed.join(context, "source_event_id"), processors)
    vectors = keep(vectors.drop(*processing.CONTEXT[1:]), "vectors")
    # One error for a document: the provider's or a vector's, else what forbids publishing its version.
    wrong = publication.publication_errors(vectors.join(about, "source_event_id"), state.documents).filter("error_code is not null")
    wrong = about.join(wrong, "document_version_id").select("source_event_id", "error_code")
    odd = vectors.filter("embedding_error is not null").groupBy("source_event_id").agg(F.min(F.struct("embedding_error", "error_message")).alias("e"))
    odd = odd.select("source_event_id", F.col("e.embedding_error").alias("error_code"), F.col("e.error_message").alias("error_message"))
    odd = odd.unionByName(wrong.join(odd.select("source_event_id"), "source_event_id", "left_anti"), allowMissingColumns=True)
    failed = checked.filter("error_code is not null").select("source_event_id", "error_code", F.lit(None).cast("string").alias("error_message"))
    for some in (loaded.filter("error_code is not null").select("source_event_id", "error_code"), parsed.filter("parse_error is not null").select("source_event_id", F.col("parse_error").alias("error_code")), guard.filter("error_code is not null").select("source_event_id", "error_code"), odd):
        failed = failed.unionByName(some, allowMissingColumns=True)
    failed = keep(failed.withColumn("error_message", F.coalesce("error_message", "error_code")).withColumn("permanent", is_permanent(F.col("error_code"))), "failed")
    stages = F.create_map(*[F.lit(x) for name, (_, place) in ERRORS.items() for x in (name, place)])
    rows = vectors.join(failed, "source_event_id", "left_anti").join(about, "source_event_id").withColumn("embedded_at", now)
    done = rows.select("source_event_id").distinct()
    phases = failed.select("source_event_id", jobs.phase_of(stages[F.col("error_code")]).alias("p")).unionByName(done.withColumn("p", F.lit(jobs.PHASES[-1])))
    table = table.join(phases, "source_event_id", "left").withColumn("phase", F.coalesce("p", "phase")).select(*before.columns)
    table = jobs.record_failures(table, failed, now, max_attempts=config.max_attempts, base_delay=config.base_delay_seconds)
    out = publish(replace(state, jobs=table), keep(rows.drop("source_event_id", "embedding_error", "error_message"), "rows"), done, now)
    return out, dropped


def rejected_deletions(decoded: DataFrame, documents: DataFrame, *, config: Config = DEFAULT) -> DataFrame:
    """Deletion events that fail their checks, with ``error_code``."""
    kind = events.route(F.col("event_type"), F.col("document_version_id"))
    return events.validate_deletions(decoded.filter(kind == "delete"), documents, config=config).filter("error_code is not null")
