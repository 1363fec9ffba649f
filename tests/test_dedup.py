"""Duplicates of events across batches, by state alone."""

import json
import time

from quillmill.operators import events
from quillmill.sources import eventlog
from quillmill.streaming import dedup


def event(name, doc=1):
    return {"key": str(doc), "value": json.dumps({"eventId": name, "eventType": "X", "schemaVersion": 1, "tenantId": 1, "documentId": doc, "occurredAt": "2026-08-16T09:14:22Z"})}


def test_duplicates_across_batches(spark, tmp_path):
    """NEW, then DUPLICATE in a later batch and after a restart; the state's time runs out."""
    root, seen = str(tmp_path / "log"), {}
    spark.conf.set(*dedup.PROVIDER)

    def run(want, ttl, check):
        stream = dedup.dedup_stream(events.decode_events(eventlog.log_events(spark, root, "t", positions=f"{tmp_path}/{check}/p", per_trigger=3))[0], ttl_seconds=ttl)

        def handle(df, batch):
            seen.setdefault(check, {}).update({(r["kafka_partition"], r["kafka_offset"]): (r["source_event_id"], r["verdict"], batch) for r in df.collect()})

        query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{tmp_path}/{check}").outputMode("append").start()
        until = time.time() + 120
        while len(seen.get(check, {})) < want and query.isActive and time.time() < until:
            time.sleep(0.2)
        query.stop()
        assert query.exception() is None, query.exception()

    eventlog.append(root, "t", 0, [event("a"), event("b"), event("a"), event("c"), event("a")])
    run(5, None, "one")
    eventlog.append(root, "t", 1, [event("b", 2), event("d", 2)])
    run(7, None, "one")
    got = {k: v[:2] for k, v in seen["one"].items()}
    assert got == {(0, 0): ("a", "NEW"), (0, 1): ("b", "NEW"), (0, 2): ("a", "DUPLICATE"), (0, 3): ("c", "NEW"), (0, 4): ("a", "DUPLICATE"), (1, 0): ("b", "DUPLICATE"), (1, 1): ("d", "NEW")}
    assert len({v[2] for v in seen["one"].values()}) >= 3
    taken = []
    dedup.by_new_records(lambda df, batch: taken.extend(df.collect()))(spark.createDataFrame([("a", "NEW"), ("a", "DUPLICATE"), ("b", "REDELIVERY")], "e string, verdict string"), 1)
    assert [r["e"] for r in taken] == ["a", "b"] and taken[0].asDict() == {"e": "a"}


def test_redelivery_is_not_a_duplicate(spark, tmp_path):
    """The same record again, as after a producer's retry that a broker answered twice, is told by its place."""
    spark.conf.set(*dedup.PROVIDER)
    schema = "source_event_id string, kafka_topic string, kafka_partition int, kafka_offset long"
    for i, rows in enumerate(([("a", "t", 0, 7)], [("a", "t", 0, 7), ("a", "t", 0, 9), ("b", "t", 1, 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = dedup.dedup_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"), ttl_seconds=3600)
    got = []
    query = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["source_event_id"], r["kafka_offset"], r["verdict"]) for r in got) == [("a", 7, "NEW"), ("a", 7, "REDELIVERY"), ("a", 9, "DUPLICATE"), ("b", 1, "NEW")]
