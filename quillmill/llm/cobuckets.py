"""Co-bucketed table pair: two tables in any files become one file for each table and bucket, by a tagged-union reduce-side join.

``write_files`` puts a table into numbered, sorted Parquet files.  ``cobucket``
reads both tables' files as one union of tagged rows and shuffles it once, by
candidate bucket, a task for each; there the left rows of a key come before its
right rows, so one pass over the sorted stream, a batch at a time, knows for
each right row whether its key has a left row.  The pass multiplies the counts
of each key, writes the left rows and the matched right rows to their bucket's
two files, and the orphans to a sorted run.  The runs, whose keys are disjoint, are
merged by one streaming task into the one file that all orphans share.

A batch of rows, or one for each of at most ``buckets`` runs, is all that a task
holds; Spark's sort spills.  A hot key makes its own file long, which has to be
one file, but nothing else: no key goes into a broadcast, and what the driver gets is a
bounded row for each file.  Files carry an attempt's own name, and count once the
finished job has reported them: what a lost executor leaves is never read,
and goes at the end with everything else that isn't final.

Null keys have a bucket of their own and join nothing; repeated rows stay rows; a
table without rows has no file.  Columns may have any names, also clashing ones;
columns of map or variant type can't be ordered, and raise Spark's error.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import open_fs, shared_path

#: Rows of a row group: readers and the merge hold a few of these at a time.
GROUP = 1 << 16
#: Rows of a batch of an orphans' run; the merge holds one of each run.
RUN = 1 << 12
_FILE = "table_name string, number int, name string, n_rows long, buckets array<struct<b:int,n:long>>"
_FINAL = "kind string, table_name string, bucket int, name string, n_rows long, n_joined long, ids_sha256 string, lineage array<struct<s:int,n:long>>"


def bucket_of(key: Column, buckets: int, salt: str = "") -> Column:
    """Unsigned crc32 of ``salt`` and the key in decimal, modulo ``buckets``; null for a null key."""
    return (F.crc32(F.concat(F.lit(salt), key.cast("string")).cast("binary")) % buckets).cast("int")


class _Writer:
    """One Parquet file, begun with its first rows, its name its attempt's own."""

    suffix, group = ".parquet", GROUP

    def __init__(self, folder: str, stem: str):
        self.folder, self.name = folder, f"{stem}-{uuid.uuid4().hex}{self.suffix}"
        self.out, self.held, self.size, self.n = None, [], 0, 0

    def write(self, rows: pa.Table) -> None:
        self.held.append(rows)
        self.size += rows.num_rows
        self.n += rows.num_rows
        if self.size >= self.group:
            self._flush()

    def _flush(self) -> None:
        table = pa.concat_tables(self.held)
        if self.out is None:
            fs, path = open_fs(f"{self.folder}/{self.name}")
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.out = self._open(fs, path, table.schema)
        self.out.write_table(table, self.group)
        self.held, self.size = [], 0

    def _open(self, fs, path: str, schema: pa.Schema):
        return pq.ParquetWriter(path, schema, filesystem=fs, compression="zstd")

    def close(self) -> None:
        if self.held:
            self._flush()
        if self.out is not None:
            self.out.close()


class _Run(_Writer):
    """Orphans in order, as a stream of batches that needs no footer."""

    suffix, group = ".arrows", RUN

    def _open(self, fs, path, schema):
        self.sink = fs.open_output_stream(path)
        return pa.ipc.new_stream(self.sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))

    def close(self):
        super().close()
        if self.out is not None:
            self.sink.close()


class _Count:
    """Rows by small number: of a starting file, of a bucket."""

    def __init__(self):
        self.by: dict[int, int] = {}

    def add(self, numbers: np.ndarray) -> None:
        for s, n in zip(*np.unique(numbers, return_counts=True)):
            self.by[int(s)] = self.by.get(int(s), 0) + int(n)

    def rows(self, a: str, b: str) -> list[dict]:
        return [{a: s, b: n} for s, n in sorted(self.by.items())]


class _Ids:
    """sha256 of the keys in order, in decimal, null empty, joined by commas."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, keys: pa.Array) -> None:
        if len(keys):
            text = ",".join(x or "" for x in keys.cast(pa.string()).to_pylist())
            self.hash.update((("," if self.any else "") + text).encode())
            self.any = True


def _struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def _table(rows: pa.StructArray) -> pa.Table:
    return pa.Table.from_arrays(rows.flatten(), names=[rows.type.field(i).name for i in range(rows.type.num_fields)])


def write_files(table: DataFrame, number: Column, candidate: Column, folder: str, name: str, *, key: str, numbers: int) -> list:
    """``table`` as files ``name/file-<number>-...``, sorted by ``key``, then the other columns; a row of figures for each file.

    ``number`` is in 0 .. numbers - 1.  One shuffle, a task for each file, which it writes as it reads.
    """
    rest = [F.col(f"row.`{c}`").asc_nulls_first() for c in [key, *[c for c in table.columns if c != key]]]
    dealt = table.select(number.cast("int").alias("number"), candidate.cast("int").alias("b"), _struct(table).alias("row"))
    dealt = dealt.repartitionById(numbers, F.col("number")).sortWithinPartitions(*rest)

    def work(batches):
        out, seen, number = None, _Count(), None
        for batch in batches:
            if batch.num_rows:
                if out is None:
                    number = batch.column("number")[0].as_py()
                    out = _Writer(f"{folder}/{name}", f"file-{number:05d}")
                out.write(_table(batch.column("row")))
                seen.add(batch.column("b").to_numpy())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"table_name": name, "number": number, "name": out.name, "n_rows": out.n, "buckets": seen.rows("b", "n")}], _arrow(_FILE))

    return dealt.mapInArrow(work, _FILE).collect()  # a row for each of at most ``numbers`` files


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    pairs = lambda a, b: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int64())]))
    return pa.schema([(c.split()[0], kinds.get(c.split()[1]) or (pairs("s", "n") if "<s:" in c else pairs("b", "n"))) for c in ddl.replace(",n:", ";n:").split(", ")])


class _Bucket:
    """The pass over one candidate bucket's sorted rows: tag 0 is left, 1 right."""

    def __init__(self, bucket: int, nulls: int, folder: str, names: tuple[str, str], staying: frozenset[int]):
        self.bucket, self.nulls, self.joined = bucket, bucket == nulls, 0
        self.names, self.last, self.lefts = names, None, 0
        self.files = [_Writer(f"{folder}/{n}", f"bucket-{bucket:05d}") for n in names]
        self.run = _Run(f"{folder}/_runs", f"run-{bucket:05d}")
        self.skip = bucket in staying  # the left file is there already
        self.ids, self.lineage, self.n = [_Ids(), _Ids()], [_Count(), _Count()], [0, 0]

    def take(self, batch: pa.RecordBatch) -> None:
        tag, keys, s = batch.column("tag").to_numpy(), batch.column("k"), batch.column("s").to_numpy()
        matched = np.ones(len(tag), bool)
        if not self.nulls:
            matched = self._matched(tag, keys)
        for t, side in enumerate(("l", "r")):
            mine = np.flatnonzero((tag == t) & matched)
            if not len(mine):
                continue
            at = pa.array(mine)
            if not (t == 0 and self.skip):
                self.files[t].write(_table(batch.column(side).take(at)))
            self.ids[t].add(keys.take(at))
            self.lineage[t].add(s[mine])
            self.n[t] += len(mine)
        lost = np.flatnonzero(~matched)
        if len(lost):
            at = pa.array(lost)
            self.run.write(pa.Table.from_arrays([keys.take(at), batch.column("s").take(at), batch.column("r").take(at)], names=["k", "s", "r"]))

    def _matched(self, tag: np.ndarray, keys: pa.Array) -> np.ndarray:
        """Which rows are left, or right with a left row of their key; adds each key's product of counts."""
        k = keys.to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(begin, len(k)))
        left = np.add.reduceat((tag == 0).astype(np.int64), begin)
        right = size - left
        if self.last is not None and k[0] == self.last:  # the key goes on from the batch before
            left[0] += self.lefts
        self.joined += int((left * right).sum())
        self.last, self.lefts = k[-1], int(left[-1])
        return (tag == 0) | np.repeat(left > 0, size)

    def close(self):
        for f in [*self.files, self.run]:
            f.close()
        for t in (0, 1):
            if self.n[t]:
                yield {"kind": "final", "table_name": self.names[t], "bucket": self.bucket, "name": None if t == 0 and self.skip else self.files[t].name, "n_rows": self.n[t], "n_joined": self.joined, "ids_sha256": self.ids[t].hash.hexdigest(), "lineage": self.lineage[t].rows("s", "n")}
        if self.run.n:
            yield {"kind": "run", "table_name": self.names[1], "bucket": self.bucket, "name": self.run.name, "n_rows": self.run.n, "n_joined": 0, "ids_sha256": None, "lineage": []}


def _scan(spark: SparkSession, folder: str, sides, key: str, salt: str, buckets: int, staying: frozenset[int]) -> list:
    nulls = buckets + 1
    number = F.regexp_extract(F.col("_metadata.file_name"), r"file-(\d+)", 1).cast("int")
    both = []
    for tag, (name, files, columns) in enumerate(sides):
        if files:
            df = spark.read.parquet(*[f"{folder}/{name}/{f['name']}" for f in files])
            both.append(df.select(F.lit(tag).alias("tag"), number.alias("s"), F.col(f"`{key}`").alias("k"), F.coalesce(bucket_of(F.col(f"`{key}`"), buckets, salt), F.lit(nulls)).alias("b"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("lr"[tag])))
    if not both:
        return []
    union = both[0] if len(both) == 1 else both[0].unionByName(both[1], allowMissingColumns=True)
    order = [F.col("k").asc_nulls_first(), F.col("tag")]
    order += [F.col(f"{side}.`{c}`").asc_nulls_first() for side, (_, files, columns) in zip("lr", sides) if files for c in columns if c != key]
    dealt = union.repartitionById(nulls + 1, F.col("b")).sortWithinPartitions(*order)
    names = (sides[0][0], sides[1][0])

    def work(batches):
        state = None
        for batch in batches:
            if batch.num_rows:
                state = state or _Bucket(batch.column("b")[0].as_py(), nulls, folder, names, staying)
                state.take(batch)
        if state is not None:
            yield pa.RecordBatch.from_pylist(list(state.close()), _arrow(_FINAL))

    return dealt.mapInArrow(work, _FINAL).collect()  # two or three rows for each of at most buckets + 2 tasks


def merged(runs: list):
    """Rows of sorted runs whose keys are disjoint, merged: tables of k, s, r.  ``runs`` are iterators of record batches."""
    held: list[pa.Table | None] = [None] * len(runs)
    live = list(range(len(runs)))
    while live:
        for i in list(live):
            while held[i] is None or not held[i].num_rows:
                batch = next(runs[i], None)
                if batch is None:
                    live.remove(i)
                    held[i] = None
                    break
                held[i] = pa.Table.from_batches([batch])
        if not live:
            return
        # No run's later rows come before the least of the runs' last rows in hand.
        bound = min(held[i].column("k")[-1].as_py() for i in live)
        parts = []
        for i in live:
            upto = int(np.searchsorted(held[i].column("k").to_numpy(), bound, "right"))
            if upto:
                parts.append(held[i].slice(0, upto))
                held[i] = held[i].slice(upto)
        table = pa.concat_tables(parts).combine_chunks()
        order = np.argsort(table.column("k").to_numpy(), kind="stable")
        yield table.take(pa.array(order))


def _merge(spark: SparkSession, folder: str, name: str, bucket: int, runs: list) -> list:
    """One task writes the orphans' one file, streaming over the runs."""
    paths = [f"{folder}/_runs/{r['name']}" for r in runs]
    given = spark.createDataFrame([(paths,)], "paths array<string>").coalesce(1)

    def work(batches):
        for batch in batches:
            for paths in batch.column("paths").to_pylist():
                streams = [pa.ipc.open_stream(fs.open_input_stream(path)) for fs, path in map(open_fs, paths)]
                out, ids, lineage = _Writer(f"{folder}/{name}", f"bucket-{bucket:05d}"), _Ids(), _Count()
                for rows in merged([iter(x) for x in streams]):
                    out.write(_table(rows.column("r").combine_chunks()))
                    ids.add(rows.column("k").combine_chunks())
                    lineage.add(rows.column("s").to_numpy())
                out.close()
                yield pa.RecordBatch.from_pylist([{"kind": "final", "table_name": name, "bucket": bucket, "name": out.name, "n_rows": out.n, "n_joined": 0, "ids_sha256": ids.hash.hexdigest(), "lineage": lineage.rows("s", "n")}], _arrow(_FINAL))

    return given.mapInArrow(work, _FINAL).collect()


def cobucket(left: DataFrame, right: DataFrame, *, key: str, left_number: Column, right_number: Column, left_name: str, right_name: str, buckets: int = 300, salt: str = "line", folder: str | None = None) -> DataFrame:
    """Write both tables into numbered files, then rewrite those: one file for each table and bucket; a row for each final file.

    Bucket ``buckets`` is for right rows whose key has no left row, ``buckets + 1`` for null keys.
    ``left_number`` and ``right_number`` give each row's starting file, 0 to buckets + 1.
    A starting file with exactly a final file's rows stays; in the end only final data files are left.
    """
    spark = left.sparkSession
    folder = folder or shared_path(spark, "cobuckets")
    nulls = buckets + 1
    started = {}
    for name, table, number in ((left_name, left, left_number), (right_name, right, right_number)):
        candidate = F.coalesce(bucket_of(F.col(f"`{key}`"), buckets, salt), F.lit(nulls))
        started[name] = write_files(table, number, candidate, folder, name, key=key, numbers=buckets + 2)
    # Left rows' buckets are their candidates: files that can stay are known before the pass, and aren't written again.
    where: dict[int, list] = {}
    for f in started[left_name]:
        for x in f["buckets"]:
            where.setdefault(x["b"], []).append(f)
    staying = frozenset(b for b, files in where.items() if len(files) == 1 and len(files[0]["buckets"]) == 1)
    made = _scan(spark, folder, [(n, started[n], t.columns) for n, t in ((left_name, left), (right_name, right))], key, salt, buckets, staying)
    runs, finals = [r for r in made if r["kind"] == "run"], [r.asDict(recursive=True) for r in made if r["kind"] == "final"]
    if runs:
        finals += [r.asDict(recursive=True) for r in _merge(spark, folder, right_name, buckets, runs)]
    columns = {left_name: ",".join(left.columns), right_name: ",".join(right.columns)}
    begun = {(n, f["number"]): f for n in started for f in started[n]}
    rows = []
    for f in finals:
        (only, n), *more = [(x["s"], x["n"]) for x in f["lineage"]]
        same = not more and n == f["n_rows"] == begun[f["table_name"], only]["n_rows"]
        name = begun[f["table_name"], only]["name"] if same else f["name"]
        joined = f["n_joined"] if f["bucket"] < buckets else 0
        lineage = hashlib.sha256(",".join(f"{x['s']}:{x['n']}" for x in f["lineage"]).encode()).hexdigest()
        rows.append((f["table_name"], f"{folder}/{f['table_name']}/{name}", columns[f["table_name"]], f["ids_sha256"], lineage, f["bucket"], f["n_rows"], joined, not same))
    _keep_only(folder, {r[1] for r in rows})
    return spark.createDataFrame(rows, "table_name string, path string, columns string, ids_sha256 string, lineage_sha256 string, bucket long, n_rows long, n_joined long, rewritten boolean")


def _keep_only(folder: str, paths: set[str]) -> None:
    """Delete all files below ``folder`` but these, and folders left empty."""
    fs, base = open_fs(folder)
    kept = {open_fs(p)[1] for p in paths}
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    for x in found:
        if x.type == pafs.FileType.File and x.path not in kept:
            fs.delete_file(x.path)
    for x in found:
        if x.type == pafs.FileType.Directory and not any(k.startswith(x.path + "/") for k in kept):
            fs.delete_dir(x.path)


def starting_numbers(buckets: int = 300, salt: str = "line") -> tuple[Column, Column]:
    """Starting files of the query: sales by bucket, every third bucket in the file before; lines by item, without salt."""
    b = F.coalesce(bucket_of(F.col("sale_id"), buckets, salt), F.lit(buckets + 1))
    return F.when(b % 3 == 1, b - 1).otherwise(b), F.coalesce(bucket_of(F.col("item_id"), buckets), F.lit(0))
