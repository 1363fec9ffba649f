"""State tables as snapshots with one pointer: all tables of a batch appear together or not at all.

A keyed table grows by deltas: a commit writes the changed groups of rows, by
bucket, and a reader takes of each group what the newest part has of it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a keyed table.
BUCKETS = 64
#: Parts of a bucket beyond which ``compact`` makes one of them.
PARTS = 8
#: Keys up to which a read gives the scan a list of them; more are joined.
LISTED = 200
_OWN = "__number long, __gone boolean"


def bucket_of(key):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class LostRace(OSError):
    """Another writer has committed since the tables were read."""


@dataclass(frozen=True)
class Key:
    """Rows lie in buckets by the column ``bucket``; those that agree on ``group`` are replaced together.  A group lies in one bucket."""

    bucket: str
    group: str


@dataclass(frozen=True)
class Delta:
    """Changed groups of a keyed table: all their rows, and in ``emptied`` (the bucket's and the group's column) groups without any."""

    rows: DataFrame
    emptied: DataFrame | None = None


class SnapshotStore:
    """Tables below ``root``: ``<table>/<part>``, and pointers ``_pointer.<number>`` naming each table's parts and the last batch.

    A pointer is written aside and renamed to the next number through
    Hadoop's file system, and the highest one counts: a crash at any point leaves the
    one before.  The rename fails where the number is taken, so of two writers one
    raises.  Tables in ``keyed`` take ``Delta``s, or a DataFrame as their new whole;
    those in ``appended`` only grow; others are replaced.  ``keep`` pointers, and
    what they name, are left for readers; older ones go.
    """

    def __init__(self, spark: SparkSession, root: str, *, keyed: dict[str, Key] | None = None, appended: tuple[str, ...] = (), keep: int = 3):
        self.spark, self.root, self.keyed, self.appended, self.keep = spark, root.rstrip("/"), keyed or {}, appended, keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _numbers(self) -> list[int]:
        root = self._path(self.root)
        names = [x.getPath().getName() for x in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n.split(".")[1]) for n in names if n.startswith("_pointer.") and n.split(".")[1].isdigit())

    def _pointer(self, number: int | None = None) -> dict:
        numbers = self._numbers() if number is None else [number]
        if not numbers:
            return {"batch": -1, "number": -1, "tables": {}}
        src = self._fs.open(self._path(f"{self.root}/_pointer.{numbers[-1]}"))
        try:
            return json.loads(self._io.toString(src, "UTF-8"))
        finally:
            src.close()

    def last_batch(self) -> int:
        return self._pointer()["batch"]

    def number(self) -> int:
        """The number of the last commit, -1 before the first."""
        return self._pointer()["number"]

    # -- reading

    def read(self, table: str, schema: str, keys: DataFrame | None = None) -> DataFrame:
        """Rows of a table.  Of a keyed one, with ``keys`` (one column, values of the bucket's column; null ones are ignored), only theirs: other buckets aren't read."""
        parts = self._pointer()["tables"].get(table)
        if not parts:
            return self.spark.createDataFrame([], schema)
        if table not in self.keyed:
            return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/{x}" for x in parts])
        key, wanted, some = self.keyed[table], None, None
        if keys is not None:
            name = keys.columns[0]
            some = keys.filter(F.col(f"`{name}`").isNotNull()).select(F.col(f"`{name}`").alias("__k")).distinct()
            few = [r[0] for r in some.limit(LISTED + 1).collect()]
            wanted = few if len(few) <= LISTED else None
            buckets = {str(r[0]) for r in some.select(bucket_of("__k")).distinct().collect()}
            parts = {b: x for b, x in parts.items() if b in buckets}
        rows = self._merged(table, schema, parts, wanted)
        if some is not None and wanted is None:
            rows = rows.join(some, F.col(key.bucket) == F.col("__k"), "left_semi")
        return rows

    def _merged(self, table: str, schema: str, parts: dict[str, list[str]], wanted: list | None = None, gone: bool = False) -> DataFrame:
        """The newest rows of each group in some buckets; ``gone`` keeps the marks and the numbers."""
        key, found = self.keyed[table], None
        for many in (False, True):
            paths = [f"{self.root}/{table}/{p}/__bucket={b}" for b, names in parts.items() if (len(names) > 1) == many for p in names]
            if not paths:
                continue
            rows = self.spark.read.schema(f"{schema}, {_OWN}").parquet(*paths)
            if wanted is not None:
                rows = rows.filter(F.col(key.bucket).isin(wanted))
            if many:
                newest = F.max("__number").over(Window.partitionBy(key.bucket, key.group))
                rows = rows.withColumn("__newest", newest).filter("__number = __newest").drop("__newest")
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            return self.spark.createDataFrame([], f"{schema}, {_OWN}" if gone else schema)
        return found if gone else found.filter("not __gone").drop("__number", "__gone")

    # -- writing

    def _write_keyed(self, table: str, rows: DataFrame, number: int) -> tuple[str, list[str]]:
        """A part's name and its buckets; ``rows`` carry their numbers and marks."""
        name = f"v{number:012d}-{uuid.uuid4().hex[:8]}"
        target = f"{self.root}/{table}/{name}"
        rows.withColumn("__bucket", bucket_of(self.keyed[table].bucket)).repartition("__bucket").write.partitionBy("__bucket").parquet(target)
        made = [x.getPath().getName() for x in self._fs.listStatus(self._path(target))]
        return name, [x.split("=", 1)[1] for x in made if x.startswith("__bucket=")]

    def commit(self, batch: int | None, tables: dict[str, DataFrame | Delta], *, since: int | None = None) -> bool:
        """Write ``tables`` and move the pointer; a batch already committed is left alone, None is work outside the stream.

        ``since``: the ``number`` that the tables were computed from; LostRace if it isn't the last one any more.
        """
        pointer = self._pointer()
        if batch is not None and batch <= pointer["batch"]:
            return False
        if since is not None and since != pointer["number"]:
            raise LostRace(f"number {pointer['number']} has been committed since {since}")
        number = pointer["number"] + 1
        for table, df in tables.items():
            if table in self.keyed:
                delta = df if isinstance(df, Delta) else Delta(df)
                rows = delta.rows.withColumn("__number", F.lit(number).cast("long")).withColumn("__gone", F.lit(False))
                if delta.emptied is not None:
                    marks = delta.emptied.withColumn("__number", F.lit(number).cast("long")).withColumn("__gone", F.lit(True))
                    rows = rows.unionByName(marks, allowMissingColumns=True)
                name, buckets = self._write_keyed(table, rows, number)
                parts = pointer["tables"].get(table, {}) if isinstance(df, Delta) else {}
                pointer["tables"][table] = parts | {b: [*parts.get(b, []), name] for b in buckets}
                continue
            if table in self.appended and not df.take(1):
                continue
            name = f"v{number:012d}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(f"{self.root}/{table}/{name}")
            pointer["tables"][table] = [*(pointer["tables"].get(table, []) if table in self.appended else []), name]
        self._move(pointer | {"batch": pointer["batch"] if batch is None else batch, "number": number})
        return True

    def compact(self, schemas: dict[str, str], most: int = PARTS) -> dict[str, int]:
        """One part for each bucket of a keyed table that has over ``most``; the number of such buckets by table."""
        pointer, done = self._pointer(), {}
        number = pointer["number"] + 1
        for table, schema in schemas.items():
            full = {b: names for b, names in pointer["tables"].get(table, {}).items() if len(names) > most} if table in self.keyed else {}
            if full:
                name, buckets = self._write_keyed(table, self._merged(table, schema, full, gone=True).filter("not __gone"), number)
                parts = {b: names for b, names in pointer["tables"][table].items() if b not in full}
                pointer["tables"][table] = parts | {b: [name] for b in buckets}
                done[table] = len(full)
        if done:
            self._move(pointer | {"number": number})
        return done

    def _move(self, pointer: dict) -> None:
        """Make ``pointer`` the newest one, or raise if its number is taken."""
        number = pointer["number"]
        aside, at = self._path(f"{self.root}/_aside.{uuid.uuid4().hex}"), self._path(f"{self.root}/_pointer.{number}")
        out = self._fs.create(aside)
        try:
            out.write(bytearray(json.dumps(pointer).encode()))
        finally:
            out.close()
        if self._fs.exists(at) or not self._fs.rename(aside, at):
            raise LostRace(f"another writer has committed number {number}")
        self._vacuum()

    def work_folder(self) -> str:
        """A fresh folder beside the tables for what a batch computes on its way."""
        return f"{self.root}/_work/{uuid.uuid4().hex}"

    def drop_folder(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def _vacuum(self) -> None:
        """Delete pointers but the last few, and parts that none of those names."""
        numbers = self._numbers()
        named: dict[str, set[str]] = {}
        for n in numbers[-self.keep :]:
            for table, parts in self._pointer(n)["tables"].items():
                named.setdefault(table, set()).update(*(parts.values() if isinstance(parts, dict) else [parts]))
        oldest = min(numbers[-self.keep :])
        for n in numbers[: -self.keep]:
            self._fs.delete(self._path(f"{self.root}/_pointer.{n}"), False)
        for table, names in named.items():
            for x in self._fs.listStatus(self._path(f"{self.root}/{table}")) if self._fs.exists(self._path(f"{self.root}/{table}")) else []:
                name = x.getPath().getName()
                if name not in names and int(name[1:13]) < oldest:
                    self._fs.delete(x.getPath(), True)
