"""Meters: what a run did to jobs, by ``observe``; seconds by phase; a stream's starts, failures and batches, by a listener."""

from __future__ import annotations

import threading
import time
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..errors import ERRORS

STATUSES = ("PENDING", "PROCESSING", "RETRY_WAIT", "COMPLETED", "FAILED")
#: Codes that no stage raises, but a job may end with.
ENDINGS = ("MAX_ATTEMPTS_EXCEEDED", "DOCUMENT_DELETED")
#: The intermediate results whose making is a phase's work.
PHASE_OF = {"loaded": "downloading", "parsed": "parsing", "guard": "chunking", "vectors": "embedding", "rows": "publishing"}


def job_meters(max_attempts: int) -> list[Column]:
    """Aggregates over the jobs that a run has changed: by status, failed ones by code, those tried again by the attempt before."""
    meters = [F.count_if(F.col("status") == s).alias(f"jobs_{s.lower()}") for s in STATUSES]
    failed = F.col("status") == "FAILED"
    known = [*ERRORS, *ENDINGS]
    meters += [F.count_if(failed & (F.col("last_error_code") == c)).alias(f"failed_{c}") for c in known]
    meters.append(F.count_if(failed & ~F.coalesce(F.col("last_error_code").isin(known), F.lit(False))).alias("failed_other"))
    again = F.col("attempt_count") > 1
    meters += [F.count_if(again & (F.col("attempt_count") == n + 1) & (F.col("updated_at") == F.col("__now"))).alias(f"retry_attempt_{n}") for n in range(1, max_attempts)]
    return meters


class Clock:
    """Seconds by phase of one run."""

    def __init__(self):
        self.began, self.seconds = time.monotonic(), Counter()

    @contextmanager
    def during(self, result: str):
        """The making of an intermediate result, whatever round it is of."""
        phase, began = PHASE_OF.get(result.split("-")[-1]), time.monotonic()
        try:
            yield
        finally:
            if phase:
                self.seconds[f"seconds_{phase}"] += time.monotonic() - began

    def values(self) -> dict[str, float]:
        return dict(self.seconds) | {"batch_seconds": time.monotonic() - self.began}


class StreamMeters(StreamingQueryListener):
    """Counts over the streams of a session, by the stream's name or id.

    ``restarts``: starts after the first, in place of a broker's rebalances; ``failures``: streams that
    ended with an exception; ``batches``, ``rows``; and milliseconds by Spark's own step of a batch.
    Add it by ``spark.streams.addListener``.
    """

    def __init__(self):
        self._lock, self._names = threading.Lock(), {}
        self.starts, self.failures, self.batches, self.rows, self.millis = Counter(), Counter(), Counter(), Counter(), Counter()

    @property
    def restarts(self) -> dict[str, int]:
        return {k: n - 1 for k, n in self.starts.items()}

    def onQueryStarted(self, event):
        with self._lock:
            self._names[str(event.runId)] = event.name or str(event.id)
            self.starts[event.name or str(event.id)] += 1

    def onQueryProgress(self, event):
        p = event.progress
        with self._lock:
            name = p.name or str(p.id)
            self.batches[name] += 1
            self.rows[name] += p.numInputRows
            for step, took in p.durationMs.items():
                self.millis[name, step] += took

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            with self._lock:
                self.failures[self._names.get(str(event.runId), str(event.id))] += 1
