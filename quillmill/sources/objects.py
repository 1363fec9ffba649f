"""Sources: Kafka-shaped event streams, and documents' objects read by key."""

from __future__ import annotations

import hashlib
import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from .files import open_fs

RECORDS = "topic string, partition int, offset long, key string, value string, headers array<struct<key:string,value:binary>>"
#: Bytes read at a time, and bytes of contents in one Arrow batch.
PIECE, BATCH_BYTES = 1 << 20, 32 << 20


def kafka_events(spark: SparkSession, servers: str, topic: str, per_trigger: int = 10) -> DataFrame:
    """The event topic as a stream (needs Spark's Kafka package on the class path)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).option("includeHeaders", "true").load()


def file_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The same rows from JSON files, for replays and tests."""
    return spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def load_sources(spark: SparkSession, root: str) -> DataFrame:
    """(source_object_key, content, content_length) of all objects below ``root``: for whole stores; a batch reads by key instead."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    key = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace("file:", "").replace(".", r"\.") + "/", "")
    return files.select(key.alias("source_object_key"), "content", F.col("length").alias("content_length"))


class TooLarge(Exception):
    """An object is larger than what is allowed."""


class Download:
    """One key's bytes: read in pieces, hashed on the way, tried again as a whole, given up at a deadline."""

    def __init__(self, open_: Callable, key: str, *, most: int, attempts: int, seconds: float, pause: float):
        self.open, self.key, self.most, self.attempts, self.seconds, self.pause = open_, key, most, attempts, seconds, pause
        self.data: bytes | None = None
        self.digest = self.code = None
        self.tries = 0

    def run(self) -> None:
        until = time.monotonic() + self.seconds
        for self.tries in range(1, self.attempts + 1):
            try:
                self._once(until)
                self.code = None
                return
            except TooLarge:
                self.code = "FILE_TOO_LARGE"
                return
            except Exception:  # whatever a store raises is this key's failure
                self.code = "DownloadException"
                if time.monotonic() + self.pause * 2**self.tries > until:
                    return
                time.sleep(self.pause * 2 ** (self.tries - 1))

    def _once(self, until: float) -> None:
        pieces, size, digest = [], 0, hashlib.sha256()
        with self.open(self.key) as src:
            while piece := src.read(PIECE):
                size += len(piece)
                if size > self.most:
                    raise TooLarge(self.key)
                if time.monotonic() > until:
                    raise TimeoutError(self.key)
                digest.update(piece)
                pieces.append(piece)
        self.data, self.digest = b"".join(pieces), "sha256:" + digest.hexdigest()


def _downloads(keys: list[str | None], make: Callable[[str], Download], at_once: int, seconds: float) -> Iterator[tuple[bytes | None, str | None, str | None, int]]:
    """(bytes, digest, code, tries) of each key in order, ``at_once`` on their way at a time.

    A worker that a store holds beyond its deadline is left to itself, as a daemon, and another takes its place.
    """
    waiting: list[tuple[Download | None, threading.Event | None]] = []
    todo = iter(keys)
    give = queue.SimpleQueue()

    def worker():
        while (job := give.get()) is not None:
            job[0].run()
            job[1].set()

    def add() -> None:
        for key in todo:
            job = (None, None) if key is None else (make(key), threading.Event())
            waiting.append(job)
            if key is not None:
                give.put(job)
            if len(waiting) >= at_once:
                return

    workers = at_once
    for _ in range(at_once):
        threading.Thread(target=worker, daemon=True).start()
    try:
        add()
        while waiting:
            job, done = waiting.pop(0)
            if job is None:
                yield None, None, "DownloadException", 0
            elif done.wait(seconds * 1.5 + 1):
                yield job.data, job.digest, job.code, job.tries
            else:
                workers += 1
                threading.Thread(target=worker, daemon=True).start()
                yield None, None, "DownloadException", job.tries
            add()
    finally:
        for _ in range(workers):
            give.put(None)


@dataclass(frozen=True)
class ObjectStore:
    """A store of documents' sources, read by key in the executors.

    ``open(key)`` gives a file to read from; without one, ``root/key`` is opened by its URI.  Only
    the keys of the rows given are opened: nothing is listed.
    """

    root: str = ""
    open: Callable | None = None
    at_once: int = 4
    attempts: int = 3
    seconds: float = DEFAULT.download_timeout_seconds
    pause: float = 0.1
    max_bytes: int = DEFAULT.max_file_bytes

    def _open(self, key: str):
        if self.open is not None:
            return self.open(key)
        fs, path = open_fs(f"{self.root.rstrip('/')}/{key}")
        return fs.open_input_stream(path)

    def load(self, rows: DataFrame, *, key: str = "source_object_key", size: str | None = "file_size") -> DataFrame:
        """``rows`` with ``content``, ``actual_hash`` (of the bytes as read) and ``load_error``.

        A row whose declared ``size`` is too large is never opened: FILE_TOO_LARGE, as for
        an object that turns out to be.  Null keys and whatever a store raises,
        after so many attempts or seconds: DownloadException, for that row alone.
        """
        names = rows.columns
        size_at = names.index(size) if size and size in names else None

        def work(batches):
            make = lambda k: Download(self._open, k, most=self.max_bytes, attempts=self.attempts, seconds=self.seconds, pause=self.pause)
            for batch in batches:
                keys = batch.column(names.index(key)).to_pylist()
                sizes = batch.column(size_at).to_pylist() if size_at is not None else [None] * len(keys)
                large = [s is not None and s > self.max_bytes for s in sizes]
                some = _downloads([k for k, x in zip(keys, large) if not x], make, self.at_once, self.seconds)
                rows_, held, first = [], 0, 0
                for i, x in enumerate(large):
                    data, digest, code, _ = (None, None, "FILE_TOO_LARGE", 0) if x else next(some)
                    rows_.append((data, digest, code))
                    held += len(data or b"")
                    if held >= BATCH_BYTES:
                        yield _loaded(batch.slice(first, i + 1 - first), rows_, names)
                        rows_, held, first = [], 0, i + 1
                if rows_:
                    yield _loaded(batch.slice(first), rows_, names)

        schema = rows.select("*", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("actual_hash"), F.lit(None).cast("string").alias("load_error")).schema
        return rows.mapInArrow(work, schema)


def _loaded(batch: pa.RecordBatch, rows: list, names: list[str]) -> pa.RecordBatch:
    data, digests, codes = zip(*rows)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary()), pa.array(digests, pa.string()), pa.array(codes, pa.string())], names=[*names, "content", "actual_hash", "load_error"])


@dataclass(frozen=True)
class ContentTable:
    """Sources that are rows already: (source_object_key, content)."""

    table: DataFrame

    def load(self, rows: DataFrame, *, key: str = "source_object_key", size: str | None = "file_size") -> DataFrame:
        """As ``ObjectStore.load``; a key without a row is DownloadException."""
        contents = self.table.select(F.col("source_object_key").alias(key), "content")
        error = F.when(F.col("content").isNull(), "DownloadException")
        return rows.join(contents, key, "left").select(*rows.columns, "content", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("actual_hash"), error.alias("load_error"))
