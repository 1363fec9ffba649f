"""Objects read by key: only a batch's keys are opened, failures stay with their rows, sizes and digests are checked on the way."""

import hashlib
import io
import os
import time

from pyspark.sql import functions as F

from quillmill.sources.objects import ObjectStore, load_sources

SCHEMA = "id int, source_object_key string, file_size long"


def counted(root, fails=()):
    """An opener of files below ``root`` that leaves a mark for each; its classes are local, so that workers get them by value."""

    class Slow(io.RawIOBase):
        def read(self, n=-1):
            time.sleep(0.5)
            return b"x"

    class Counted:
        def __init__(self):
            self.root, self.fails = str(root), dict(fails)

        def __call__(self, key):
            with open(f"{self.root}/opened-{os.getpid()}-{time.time_ns()}", "w") as mark:
                mark.write(key)
            if key == "slow":
                return Slow()
            if key in self.fails and sum(k == key for k in self.opened()) <= self.fails[key]:
                raise ConnectionError("away")
            return open(f"{self.root}/objects/{key}", "rb")

        def opened(self):
            return [open(f"{self.root}/{x}").read() for x in os.listdir(self.root) if x.startswith("opened-")]

    return Counted()


def objects(tmp_path, n):
    os.makedirs(tmp_path / "objects")
    for i in range(n):
        (tmp_path / "objects" / f"k{i}").write_bytes(b"text %d " % i * 50)


def test_only_the_keys_given_are_opened(spark, tmp_path):
    objects(tmp_path, 200)
    store = counted(tmp_path, fails={"k5": 9, "k6": 1})
    rows = [(1, "k3", 400), (2, "k5", 400), (3, "k6", 400), (4, "missing", 400), (5, None, 1), (6, "k7", 10**12), (7, "k8", None), (8, "k3", 400)]
    got = {r["id"]: r for r in ObjectStore(open=store, pause=0.01).load(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    assert {i: r["load_error"] for i, r in got.items()} == {1: None, 2: "DownloadException", 3: None, 4: "DownloadException", 5: "DownloadException", 6: "FILE_TOO_LARGE", 7: None, 8: None}
    for i, k in ((1, 3), (3, 6), (7, 8), (8, 3)):
        data = b"text %d " % k * 50
        assert bytes(got[i]["content"]) == data and got[i]["actual_hash"] == "sha256:" + hashlib.sha256(data).hexdigest()
    opened = store.opened()
    assert {k: opened.count(k) for k in set(opened)} == {"k3": 2, "k5": 3, "k6": 2, "missing": 3, "k8": 1}


def test_limits_of_size_and_time(spark, tmp_path):
    objects(tmp_path, 20)
    store = counted(tmp_path)
    rows = spark.createDataFrame([(1, "k1", 1), (2, "slow", 1), (3, "k2", 1)], SCHEMA).coalesce(1)
    began = time.time()
    got = {r["id"]: r["load_error"] for r in ObjectStore(open=store, max_bytes=10_000, seconds=1.0, attempts=2).load(rows).collect()}
    assert got == {1: None, 2: "DownloadException", 3: None} and time.time() - began < 30
    assert {r["load_error"] for r in ObjectStore(open=store, max_bytes=100).load(rows.filter("id <> 2")).collect()} == {"FILE_TOO_LARGE"}


def test_keys_below_a_root(spark, tmp_path):
    objects(tmp_path, 30)
    rows = spark.range(30).select(F.col("id").cast("int"), F.concat(F.lit("k"), "id").alias("source_object_key"), F.lit(1).cast("long").alias("file_size"))
    got = ObjectStore(f"file://{tmp_path}/objects").load(rows).select("source_object_key", "content").collect()
    assert sorted((r[0], bytes(r[1])) for r in got) == sorted((r[0], bytes(r[1])) for r in load_sources(spark, f"{tmp_path}/objects").select("source_object_key", "content").collect())
    assert ObjectStore("/nowhere").load(rows.limit(0)).count() == 0
