"""Appended CSV, signalled folders, keyed updates, binary points, and streams that come late."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tracklane.sources import stores
from tracklane.streaming import folds, timed

TRACKS = "Frame long, ID long, BBox_X double, BBox_Y double"


def test_three_appends_and_a_failed_one(spark, tmp_path):
    spark.dataSource.register(stores.AppendedCsv)
    path = str(tmp_path / "t")
    rows = lambda a, b: spark.createDataFrame([(k, 1, k / 2, None if k % 5 == 0 else 1.0) for k in range(a, b)], TRACKS)
    rows(100, 120).write.format("appended_csv").mode("append").save(path)
    rows(0, 25).repartition(2).write.format("appended_csv").option("flush_rows", 10).mode("overwrite").save(path)
    rows(25, 26).write.format("appended_csv").mode("append").save(path)
    rows(26, 40).write.format("appended_csv").option("flush_rows", 3).mode("append").save(path)
    before = sorted(os.listdir(path))
    broken = rows(40, 60).withColumn("ID", F.when(F.col("Frame") == 55, F.raise_error("broken")).otherwise(F.col("ID")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        broken.repartition(3).write.format("appended_csv").option("flush_rows", 2).mode("append").save(path)
    assert sorted(os.listdir(path)) == before
    got = spark.read.schema(TRACKS).csv(path).orderBy("Frame").collect()
    assert [(r["Frame"], r["BBox_Y"]) for r in got] == [(k, None if k % 5 == 0 else 1.0) for k in range(40)]


def test_folders_are_told_once_when_they_are_stable(spark, tmp_path):
    spark.dataSource.register(stores.SignalledFolders)
    root = tmp_path / "root"
    for name in ("a", "b", "c"):
        (root / name).mkdir(parents=True)
    (root / "a" / "_READY").write_text("x")
    (root / "b" / "_READY").write_text("yy")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def start():
        s = spark.readStream.format("signalled_folders").option("path", str(root)).option("checks", "3").load()
        return s.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="200 milliseconds").start()

    def wait(names):
        end = time.time() + 60
        while time.time() < end:
            got = sorted(r["folder"] for r in spark.read.schema("folder string").parquet(out).collect()) if os.path.isdir(f"{out}/_spark_metadata") else []
            if got == names:
                return
            time.sleep(0.3)
        raise AssertionError(got)

    q = start()
    wait(["a", "b"])
    q.stop()
    (root / "c" / "_READY").write_text("")
    q = start()
    wait(["a", "b", "c"])
    time.sleep(1.5)
    wait(["a", "b", "c"])
    q.stop()


JOBS = "id long, day string, job string, folder string, status string, finished long"


def test_updates_by_job_then_by_folder(spark, tmp_path):
    path = str(tmp_path / "jobs")
    spark.createDataFrame([(1, "d1", "j1", "f1", "new", None), (2, "d2", None, "f2", "new", None), (3, "d2", "j3", "f2", "new", 5), (4, "d3", "j4", "f4", "new", None)], JOBS).write.partitionBy("day").parquet(path)
    old = {d: os.listdir(f"{path}/day={d}") for d in ("d1", "d2", "d3")}
    updates = [(1, "j1", "zzz", "run", None, "d9"), (2, None, "f2", "run", None, "d9"), (3, "j1", "f1", "done", 9, "d9"), (4, "j1", "f1", "shown", None, "d9"), (5, "j7", "f7", "run", None, "d9"), (6, None, "f7", "done", 8, "d9"), (7, "jx", "f6", "run", None, "d8")]
    df = spark.createDataFrame(updates, "ord long, job string, folder string, status string, finished long, day string")
    target = spark.read.parquet(path)
    stores.upsert(spark, path, df, "day", "job", "folder", "id", "ord", ("status",), ("finished",))
    got = sorted(tuple(r[c] for c in ("id", "day", "job", "folder", "status", "finished")) for r in spark.read.schema(target.schema).parquet(path).collect())
    assert got == [(1, "d1", "j1", "f1", "shown", 9), (2, "d2", None, "f2", "new", None), (3, "d2", "j3", "f2", "run", 5), (4, "d3", "j4", "f4", "new", None), (5, "d8", "jx", "f6", "run", None), (6, "d9", "j7", "f7", "done", 8)]
    assert os.listdir(f"{path}/day=d3") == old["d3"] and os.listdir(f"{path}/day=d1") != old["d1"]
    assert not [f for f in os.listdir(path) if f.startswith("_staged")]


def test_points_are_read_by_splits(spark, tmp_path):
    spark.dataSource.register(stores.PointFiles)
    rows = [(k, [k + 0.5, float(-k), 0.25]) for k in range(25_003)]
    path = str(tmp_path / "points")
    spark.createDataFrame(rows, "k int, point array<float>").coalesce(1).write.format("point_files").mode("append").save(path)
    (name,) = os.listdir(path)
    assert os.path.getsize(f"{path}/{name}") == 8 + 12 * len(rows)
    for where in (path, f"{path}/{name}"):
        df = spark.read.format("point_files").option("split", 12_000).load(where)
        assert df.rdd.getNumPartitions() == 3
        assert [(r["number"], r["point"]) for r in df.orderBy("number").collect()] == [(k, p) for k, p in rows]
    with open(f"{path}/{name}", "r+b") as f:
        f.truncate(8 + 12 * 20_000)
    with pytest.raises(Exception, match="ends before"):
        spark.read.format("point_files").load(path).count()


def test_late_rows_of_a_stream_give_the_rows_of_a_batch(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng, start = random.Random(1), dt.datetime(2024, 1, 1)
        rows = [(k, start + dt.timedelta(seconds=f), f, rng.randint(1, 99), rng.random()) for k in (1, 2, 3) for f in range(40)]
        late = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.random() * 8))
        schema = "game long, ts timestamp, frame long, number int, score double"
        parts = [late[k : k + 40] for k in range(0, 120, 40)] + [[(9, dt.datetime(2024, 1, 2), 0, 1, 1.0)], [(1, start, 0, 5, 1.0)]]  # the last is dropped
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            for f in (tmp_path / "in").glob("*.parquet"):
                if f.stat().st_mtime > 2_000_000_000 or k == 0 or f.name not in seen:
                    os.utime(f, (1_700_000_000 + k * 10,) * 2)
            seen = {f.name for f in (tmp_path / "in").glob("*.parquet")}
        machine = folds.EvidenceVoter()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = timed.fold_late(stream, machine, "game", "10 seconds").writeStream.format("memory").queryName("voted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        got = sorted(map(tuple, spark.sql("select * from voted where game < 9").collect()))
        q.stop()
        assert got == sorted(map(tuple, folds.fold(spark.createDataFrame(rows, schema), machine, "game").collect()))
    finally:
        spark.conf.set(name, before)
