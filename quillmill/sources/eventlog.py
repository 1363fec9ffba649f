"""A partitioned event log in a folder, and its stream: offsets per partition, headers, a limit for each batch, replay.

Layout: ``<root>/<topic>/<partition>/<first offset>-<records>.jsonl``, both
numbers in the name, so that offsets are known from a listing alone.  A record is
a line of JSON: key, value, headers (pairs of name and base64) and timestamp in
milliseconds.  Segments are never changed; one producer appends to a partition.

The stream keeps what it has planned in ``positions``, a folder beside the
query's checkpoint, and moves that on only when the batch it planned has been
read: a query that is started again first takes what it had planned, so a batch
stays within its limit and no record is skipped.  A batch's rows follow from its
offsets alone, hence a replayed batch is the same.
"""

from __future__ import annotations

import base64
import json
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import names, open_fs, read_whole, write_whole

RECORDS = "topic string, partition int, offset long, timestamp timestamp, key string, value string, headers array<struct<key:string,value:binary>>"
_ARROW = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("timestamp", pa.timestamp("us", "UTC")), ("key", pa.string()), ("value", pa.string()), ("headers", pa.list_(pa.struct([("key", pa.string()), ("value", pa.binary())])))])
#: Rows of an Arrow batch.
BATCH = 1_000


def segments(root: str, topic: str, partition: int | str) -> list[tuple[int, int, str]]:
    """(first offset, records, name) of a partition's segments, in order."""
    found = [n for n in names(f"{root}/{topic}/{partition}") if n.endswith(".jsonl")]
    return sorted((int(a), int(b), n) for n in found for a, b in [n[: -len(".jsonl")].split("-")])


def ends(root: str, topic: str) -> dict[str, int]:
    """The offset after the last record of every partition."""
    out = {}
    for p in names(f"{root}/{topic}"):
        if p.isdigit():
            last = segments(root, topic, p)
            out[p] = last[-1][0] + last[-1][1] if last else 0
    return out


def append(root: str, topic: str, partition: int, records: list[dict]) -> int:
    """Add records ({key, value, headers, timestamp}; all but value may be missing) as one segment; returns its first offset."""
    first = ends(root, topic).get(str(partition), 0)
    lines = []
    for r in records:
        headers = [[k, None if v is None else base64.b64encode(v).decode()] for k, v in r.get("headers") or []]
        lines.append(json.dumps({"key": r.get("key"), "value": r.get("value"), "headers": headers, "timestamp": r.get("timestamp", int(time.time() * 1000))}))
    if records:
        write_whole(f"{root}/{topic}/{partition}/{first:020d}-{len(records):010d}.jsonl", ("\n".join(lines) + "\n").encode())
    return first


def share(limit: int, backlog: dict[str, int]) -> dict[str, int]:
    """How many of each partition's waiting records a batch of ``limit`` takes: evenly, what one can't use going to the others."""
    taken, left = dict.fromkeys(backlog, 0), limit
    open_ = sorted((p for p in backlog if backlog[p] > 0), key=lambda p: (backlog[p], p))
    for i, p in enumerate(open_):
        taken[p] = min(backlog[p], -(-left // (len(open_) - i)) if left < len(open_) - i else left // (len(open_) - i))
        left -= taken[p]
    return taken


class LogRange(InputPartition):
    """Records of one partition from ``start`` to ``end`` (excluded)."""

    def __init__(self, partition: int, start: int, end: int):
        self.partition, self.start, self.end = partition, start, end


class EventLogStream(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.topic = options["path"].rstrip("/"), options["topic"]
        self.limit = int(options.get("maxOffsetsPerTrigger", 10))
        self.file = f"{options['positions'].rstrip('/')}/planned.json" if options.get("positions") else None
        kept = read_whole(self.file) if self.file else None
        self.planned: dict[str, int] | None = json.loads(kept) if kept else None
        self.read_on = False  # whether what is planned has been asked for, so that the next batch may go beyond it

    def initialOffset(self):
        return {}

    def latestOffset(self):
        if self.planned is None:
            self.planned = {}
        elif not self.read_on and self.file:
            # First call after a start: what was planned before, which the query may have read or not.
            self.read_on = True
            return dict(self.planned)
        last = ends(self.root, self.topic)
        backlog = {p: n - self.planned.get(p, 0) for p, n in last.items()}
        step = share(self.limit, backlog)
        if any(step.values()):
            self.planned = {p: self.planned.get(p, 0) + step.get(p, 0) for p in sorted({*self.planned, *last}, key=int)}
            if self.file:
                write_whole(self.file, json.dumps(self.planned).encode())
        self.read_on = True
        return dict(self.planned)

    def partitions(self, start, end):
        self.read_on = True
        for p, n in end.items():  # offsets of the query's own log, if it is ahead
            if self.planned is None or n > self.planned.get(p, 0):
                self.planned = {**(self.planned or {}), p: n}
        return [LogRange(int(p), start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)]

    def read(self, partition):
        at, rows = partition.start, []
        for first, count, name in segments(self.root, self.topic, partition.partition):
            if first + count <= at or first >= partition.end:
                continue
            fs, path = open_fs(f"{self.root}/{self.topic}/{partition.partition}/{name}")
            with fs.open_input_stream(path) as src:
                for offset, line in enumerate(_lines(src), first):
                    if at <= offset < partition.end:
                        rows.append(_row(self.topic, partition.partition, offset, line))
                        if len(rows) == BATCH:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows = []
            at = max(at, first + count)
        if at < partition.end:
            raise OSError(f"{self.topic}/{partition.partition} has no records {at} to {partition.end}")
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def commit(self, end):
        """Every batch up to ``end`` is done: what a monitor may compare with the log's ends."""
        if self.file:
            write_whole(self.file.replace("planned.json", "committed.json"), json.dumps(end).encode())


def _lines(src):
    """Lines of a stream of bytes, read in pieces."""
    rest = b""
    while piece := src.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _row(topic: str, partition: int, offset: int, line: bytes) -> dict:
    r = json.loads(line)
    headers = [{"key": k, "value": None if v is None else base64.b64decode(v)} for k, v in r["headers"]]
    return {"topic": topic, "partition": partition, "offset": offset, "timestamp": r["timestamp"] * 1000, "key": r["key"], "value": r["value"], "headers": headers}


class EventLog(DataSource):
    """``spark.readStream.format("event_log")``; options path, topic, maxOffsetsPerTrigger (10), positions (a folder of the query's own)."""

    @classmethod
    def name(cls):
        return "event_log"

    def schema(self):
        return RECORDS

    def streamReader(self, schema):
        return EventLogStream(self.options)


def log_events(spark: SparkSession, root: str, topic: str, *, positions: str, per_trigger: int = 10) -> DataFrame:
    """The log's records from the earliest on, at most ``per_trigger`` a batch, as rows like the Kafka source's."""
    spark.dataSource.register(EventLog)
    reader = spark.readStream.format("event_log").option("path", root).option("topic", topic)
    return reader.option("positions", positions).option("maxOffsetsPerTrigger", per_trigger).load()
