"""Dedup of events across micro-batches, by keyed state and without the job table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

#: Setting of the state store that keyed state of this kind needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_PLACE = ["kafka_topic", "kafka_partition", "kafka_offset"]


class FirstRecord(StatefulProcessor):
    """Remembers the first record of each event, for ``ttl_ms`` of processing time (None: for ever)."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "kafka_topic string, kafka_partition int, kafka_offset long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: (r["kafka_offset"], r["kafka_partition"], r["kafka_topic"] or ""))
        held = tuple(self.first.get()) if self.first.exists() else None
        if held is None:
            self.first.update(tuple(rows[0][c] for c in _PLACE))
        first = tuple(rows[0][c] for c in _PLACE) if held is None else held
        for i, row in enumerate(rows):
            verdict = "NEW" if held is None and i == 0 else "REDELIVERY" if tuple(row[c] for c in _PLACE) == first else "DUPLICATE"
            yield Row(**row.asDict(), verdict=verdict)

    def close(self) -> None:
        pass


def dedup_stream(events: DataFrame, *, ttl_seconds: int | None = 7 * 24 * 3600) -> DataFrame:
    """A stream of decoded events with ``verdict``: NEW for an event's first record, REDELIVERY for that record again, DUPLICATE for another one.

    State is one small row for each event, kept by RocksDB (the session needs ``PROVIDER``) and
    forgotten after ``ttl_seconds``; an event that comes again later is NEW.  Within a batch the least offset is first.
    """
    schema = StructType([*events.schema.fields, StructField("verdict", StringType())])
    mode = "none" if ttl_seconds is None else "processingTime"
    processor = FirstRecord(None if ttl_seconds is None else 1000 * ttl_seconds)
    return events.groupBy("source_event_id").transformWithState(processor, outputStructType=schema, outputMode="append", timeMode=mode)


def by_new_records(handler):
    """A ``foreachBatch`` function for ``dedup_stream``: ``handler(decoded, batch)`` gets all but the duplicates, without their verdict."""

    def handle(rows: DataFrame, batch: int) -> None:
        handler(rows.filter(F.col("verdict") != "DUPLICATE").drop("verdict"), batch)

    return handle
