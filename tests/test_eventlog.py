"""The event log's stream: limits, order, headers, replay after a failure, restarts."""

import json
import time

import pytest

from quillmill.operators import events
from quillmill.sources import eventlog


def fill(root, sizes):
    for p, n in sizes.items():
        for first in range(0, n, 4):
            rows = []
            for i in range(first, min(first + 4, n)):
                value = json.dumps({"eventId": f"e{p}-{i}", "eventType": "X", "schemaVersion": 1, "tenantId": 1, "documentId": p, "occurredAt": "2026-08-16T09:14:22Z", "traceId": "payload"})
                rows.append({"key": str(p), "value": value, "headers": [("traceId", b"old"), ("traceId", f"t{p}-{i}".encode())] if i % 2 else [], "timestamp": 1000 * i})
            eventlog.append(root, "t", p, rows)


def run(spark, root, checkpoint, seen, want, *, limit=10, fail_at=None):
    """Run the stream until ``want`` rows have been seen in all batches; ``fail_at`` raises in that batch before it counts."""

    def handle(df, batch):
        rows = [(r["partition"], r["offset"]) for r in df.collect()]
        if batch == fail_at:
            seen.setdefault("failed", []).append((batch, sorted(rows)))
            raise OSError("the store is away")
        seen.setdefault("batches", []).append((batch, sorted(rows)))

    stream = eventlog.log_events(spark, root, "t", positions=f"{checkpoint}/positions", per_trigger=limit)
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    until = time.time() + 90
    try:
        while time.time() < until and query.isActive and sum(len(r) for _, r in seen.get("batches", [])) < want:
            time.sleep(0.1)
    finally:
        query.stop()
    return query


def test_limits_order_and_restarts(spark, tmp_path):
    root, checkpoint, seen = str(tmp_path / "log"), str(tmp_path / "check"), {}
    fill(root, {0: 17, 1: 3, 2: 9})
    every = {(p, i) for p, n in {0: 17, 1: 3, 2: 9}.items() for i in range(n)}
    query = run(spark, root, checkpoint, seen, 99, fail_at=1)
    assert "the store is away" in str(query.exception())
    # The batch that failed is replayed from the checkpoint, row by row the same.
    run(spark, root, checkpoint, seen, len(every))
    rows = [x for _, b in seen["batches"] for x in b]
    assert sorted(rows) == sorted(every) and len(set(rows)) == len(rows)
    assert all(len(b) <= 10 for _, b in seen["batches"]) and dict(seen["batches"])[1] == seen["failed"][0][1]
    for p in (0, 1, 2):
        assert [o for q, o in rows if q == p] == sorted(o for q, o in rows if q == p)
    # A new start goes on where the last one ended.
    fill_more = [{"key": "1", "value": "x"}] * 12
    assert eventlog.append(root, "t", 1, fill_more) == 3
    assert eventlog.append(root, "t", 5, fill_more[:2]) == 0
    run(spark, root, checkpoint, seen, len(every) + 14)
    rows = [x for _, b in seen["batches"] for x in b]
    assert len(rows) == len(set(rows)) == len(every) + 14 and all(len(b) <= 10 for _, b in seen["batches"])


def test_headers_reach_the_trace_id(spark, tmp_path):
    root, got = str(tmp_path / "log"), []
    fill(root, {0: 5})
    stream = eventlog.log_events(spark, root, "t", positions=str(tmp_path / "p"))
    query = stream.writeStream.foreachBatch(lambda df, _: got.extend(events.decode_events(df)[0].collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.time() + 60
    while len(got) < 5 and time.time() < until:
        time.sleep(0.1)
    query.stop()
    assert [(r["kafka_offset"], r["trace_id"]) for r in sorted(got, key=lambda r: r["kafka_offset"])] == [(0, "payload"), (1, "t0-1"), (2, "payload"), (3, "t0-3"), (4, "payload")]


@pytest.mark.parametrize("limit,backlog,want", [(10, {"0": 3, "1": 50, "2": 50}, [3, 3, 4]), (10, {"0": 0, "1": 4}, [0, 4]), (2, {"0": 9, "1": 9, "2": 9}, [1, 1, 0]), (10, {}, []), (7, {"0": 7}, [7])])
def test_shares(limit, backlog, want):
    got = eventlog.share(limit, backlog)
    assert sorted(got.values()) == sorted(want) and sum(got.values()) == min(limit, sum(backlog.values()))


def test_a_plan_survives_a_lost_query(tmp_path):
    """A reader that has planned, and whose query has written nothing of it, plans the same again."""
    root = str(tmp_path / "log")
    fill(root, {0: 30})
    options = {"path": root, "topic": "t", "positions": str(tmp_path / "p"), "maxOffsetsPerTrigger": "10"}
    first = eventlog.EventLogStream(options)
    assert first.latestOffset() == {"0": 10}
    again = eventlog.EventLogStream(options)
    assert again.latestOffset() == {"0": 10}
    assert [(p.start, p.end) for p in again.partitions({}, {"0": 10})] == [(0, 10)] and again.latestOffset() == {"0": 20}
    lost = eventlog.LogRange(0, 29, 33)
    with pytest.raises(OSError):
        list(again.read(lost))
