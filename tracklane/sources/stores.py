"""Stored tables that grow: appended CSV parts that appear all or not at all, folders told once they are ready, keyed updates of
touched partitions only, and binary point files read by splits.

Paths are URIs that pyarrow's file systems know (plain local or shared paths, file://, hdfs://, s3://).
"""

from __future__ import annotations

import csv
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators import ranks


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.rstrip("/"))


def _names(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return sorted(store.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda f: f.path)


@dataclass
class _Written(WriterCommitMessage):
    parts: list[str]


class AppendedCsv(DataSource):
    """A folder of headerless CSV parts, to which each write adds: `df.write.format("appended_csv").mode("append").save(folder)`.

    A task flushes each `flush_rows` rows into a part of its own under a hidden folder; a commit moves all parts into place behind the
    earlier ones, an abort removes them. Mode overwrite begins anew. Option header: whether parts have one.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_csv"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _CsvWriter({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


class _CsvWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.path, self.rows, self.overwrite = options["path"], int(options.get("flush_rows", 10_000)), overwrite
        self.header, self.names, self.run = options.get("header", "false") == "true", schema.names, uuid.uuid4().hex

    @property
    def _staging(self) -> str:
        return f"{_at(self.path)[1]}/_staging-{self.run}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, _ = _at(self.path)
        store.create_dir(self._staging, recursive=True)
        parts, held = [], []
        try:
            for row in rows:
                held.append(row)
                if len(held) >= self.rows:
                    parts.append(self._flush(store, held, f"{task.partitionId():05d}-{task.attemptNumber()}-{len(parts):05d}"))
                    held = []
            if held:
                parts.append(self._flush(store, held, f"{task.partitionId():05d}-{task.attemptNumber()}-{len(parts):05d}"))
        except BaseException:
            for p in parts:
                store.delete_file(p)
            raise
        return _Written(parts)

    def _flush(self, store: fs.FileSystem, rows: list, name: str) -> str:
        text = io.StringIO()
        out = csv.writer(text, lineterminator="\n")
        if self.header:
            out.writerow(self.names)
        out.writerows(["" if v is None else v for v in row] for row in rows)
        path = f"{self._staging}/{name}.csv"
        with store.open_output_stream(path) as f:
            f.write(text.getvalue().encode())
        return path

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _at(self.path)
        store.create_dir(folder, recursive=True)
        there = [f for f in _names(store, folder) if f.is_file and f.base_name.startswith("append-")]
        number = 1 + max((int(f.base_name.split("-")[1]) for f in there), default=-1)
        for m in messages:
            for p in sorted(m.parts if m else []):
                store.move(p, f"{folder}/append-{number:06d}-{p.rsplit('/', 1)[1]}")
        if self.overwrite:  # the new parts stand before the old ones go
            for f in there:
                store.delete_file(f.path)
        self._clean(store)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(_at(self.path)[0])

    def _clean(self, store: fs.FileSystem) -> None:
        if store.get_file_info(self._staging).type != fs.FileType.NotFound:
            store.delete_dir(self._staging)


class SignalledFolders(DataSource):
    """A stream of folders: folder, size, modified (of the marker in microseconds), each told once, when its marker file has been the same in `checks` listings.

    Options: path (the root), marker, checks. An offset holds the folders told so far, so a restarted stream tells none again;
    the count of equal listings then starts anew. A marker that changes later is not told again.
    """

    @classmethod
    def name(cls) -> str:
        return "signalled_folders"

    def schema(self) -> str:
        return "folder string, size bigint, modified bigint"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _FolderReader({k.lower(): v for k, v in self.options.items()})


class _FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.marker, self.checks = options["path"], options.get("marker", "_READY"), int(options.get("checks", 2))
        self.seen: dict[str, tuple[tuple[int, int], int]] = {}
        self.told: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"told": {}}

    def latestOffset(self) -> dict:
        store, root = _at(self.root)
        now = {}
        for d in _names(store, root):
            if d.type == fs.FileType.Directory and d.base_name not in self.told:
                f = store.get_file_info(f"{d.path}/{self.marker}")
                if f.is_file:
                    stat = (f.size, f.mtime_ns // 1000)
                    before, times = self.seen.get(d.base_name, (None, 0))
                    now[d.base_name] = (stat, times + 1 if stat == before else 1)
        self.seen = {k: v for k, v in now.items() if v[1] < self.checks}
        self.told = {**self.told, **{k: list(v[0]) for k, v in now.items() if v[1] >= self.checks}}
        return {"told": self.told}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.told = {**start["told"], **self.told}  # what a stream told before it was started again
        new = sorted(set(end["told"]) - set(start["told"]))
        return [InputPartition((k, *end["told"][k])) for k in new] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return iter(() if partition.value is None else [tuple(partition.value)])

    def commit(self, end: dict) -> None:
        pass


def merged(target: DataFrame, updates: DataFrame, first: str, second: str, row_id: str, order: str, values: tuple[str, ...], fixed: tuple[str, ...] = (), born: tuple[str, ...] = ()) -> DataFrame:
    """The target with updates merged in, and `_changed`: whether a row is new or changed.

    An update belongs to the row of its `first` key, if it has one that is there, else to the latest row (greatest `row_id`) of its `second` key, else
    it is a new row. Of several updates for one row the last by `order` gives the `values`; the last that is not null gives the first key and each of `fixed`
    (a null there keeps what stands). New rows are numbered behind the greatest id in the order of their second keys; only they get the first values of `born`.
    """
    keep = (first, *fixed)
    by_first = target.filter(F.col(first).isNotNull()).groupBy(first).agg(F.min(row_id).alias("_a"))
    by_second = target.groupBy(second).agg(F.max(row_id).alias("_b"))
    hit = updates.join(by_first, first, "left").join(by_second, second, "left").withColumn("_id", F.coalesce("_a", "_b"))
    last = lambda c: F.max_by(c, order).alias(c)
    known = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    one = hit.groupBy("_id", F.when(F.col("_id").isNull(), F.col(second)).alias("_new")).agg(*[last(c) for c in (*values, second)], *[known(c) for c in keep], *[F.min_by(c, order).alias(c) for c in born])
    changed = target.join(one.filter("_id is not null").select(F.col("_id").alias(row_id), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in (*values, *keep)]), row_id, "left")
    fresh = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in values} | {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in keep}
    old = changed.select(*[fresh.get(c, F.col(c)).alias(c) for c in target.columns], F.coalesce("_hit", F.lit(False)).alias("_changed"))
    new = one.filter("_id is null")
    top = target.agg(F.coalesce(F.max(row_id), F.lit(0)).alias("_top"))
    numbered = ranks.numbered(new, "_n", second).join(F.broadcast(top), how="cross")  # one row
    made = {row_id: F.col("_top") + F.col("_n")} | {c: F.col(c) for c in (second, *values, *keep, *born)}
    return old.unionByName(numbered.select(*[made.get(c, F.lit(None)).cast(target.schema[c].dataType).alias(c) for c in target.columns], F.lit(True).alias("_changed")))


def upsert(spark: SparkSession, path: str, updates: DataFrame, by: str, first: str, second: str, row_id: str, order: str, values: tuple[str, ...], fixed: tuple[str, ...] = ()) -> None:
    """Merges updates into the Parquet table at `path`, partitioned by `by`, which updates have for new rows; only partitions with a changed row are written again.

    The new partitions are written beside the table first, so a failed run leaves it as it was.
    """
    target = spark.read.parquet(path)
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    rows = merged(target, updates, first, second, row_id, order, values, fixed, (by,))
    touched = rows.groupBy(by).agg(F.max("_changed").alias("_t")).filter("_t").select(F.col(by).alias("_by"))
    rows.join(touched, F.col(by).eqNullSafe(F.col("_by")), "left_semi").drop("_changed").write.partitionBy(by).parquet(staged)
    spark.read.schema(target.schema).parquet(staged).write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    jvm = spark.sparkContext._jvm
    gone = jvm.org.apache.hadoop.fs.Path(staged)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


class PointFiles(DataSource):
    """Binary point files: two 4-byte numbers (points, coordinates), then 4-byte floats point by point; a file or a folder of such.

    Reading gives file, number, point (an array), in splits of `split` points. Writing takes a column `point` and makes a file a task in a new folder.
    """

    @classmethod
    def name(cls) -> str:
        return "point_files"

    def schema(self) -> str:
        return "file string, number bigint, point array<float>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PointReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _PointWriter(self.options["path"], schema.names.index("point"), overwrite)


class _PointReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split", 1 << 20))

    def partitions(self) -> list[InputPartition]:
        store, path = _at(self.path)
        info = store.get_file_info(path)
        files = [path] if info.is_file else [f.path for f in _names(store, path) if f.is_file and not f.base_name.startswith(("_", "."))]
        out = []
        for f in files:
            with store.open_input_file(f) as raw:
                n, size = struct.unpack("<ii", raw.read(8))
            out += [InputPartition((f, a, min(a + self.split, n), size)) for a in range(0, n, self.split)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        file, lo, hi, size = partition.value
        with _at(self.path)[0].open_input_file(file) as raw:
            for a in range(lo, hi, 10_000):
                b = min(a + 10_000, hi)
                raw.seek(8 + 4 * size * a)
                data = raw.read(4 * size * (b - a))
                if len(data) < 4 * size * (b - a):
                    raise ValueError(f"{file} ends before its last point")
                points = pa.ListArray.from_arrays(pa.array(np.arange(0, size * (b - a) + 1, size), pa.int32()) if size else pa.array([0] * (b - a + 1), pa.int32()), pa.array(np.frombuffer(data, "<f4")))
                yield pa.RecordBatch.from_arrays([pa.array([file.rsplit("/", 1)[-1]] * (b - a)), pa.array(np.arange(a, b)), points], ["file", "number", "point"])


class _PointWriter(DataSourceWriter):
    def __init__(self, path: str, column: int, overwrite: bool):
        self.path, self.column, self.overwrite, self.run = path, column, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = _at(self.path)
        store.create_dir(f"{folder}/_staging-{self.run}", recursive=True)
        name = f"{folder}/_staging-{self.run}/part-{task.partitionId():05d}-{task.attemptNumber()}.bin"
        body, n, size = f"{name}.body", 0, None
        with store.open_output_stream(body) as out:
            for row in rows:
                p = np.asarray(row[self.column], "<f4")
                if size is not None and len(p) != size:
                    raise ValueError("points of one file have one number of coordinates")
                size, n = len(p), n + 1
                out.write(p.tobytes())
        with store.open_output_stream(name) as out, store.open_input_stream(body) as held:
            out.write(struct.pack("<ii", n, size or 0))
            while piece := held.read(1 << 22):
                out.write(piece)
        store.delete_file(body)
        return _Written([name] if n else [])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _at(self.path)
        old = [f.path for f in _names(store, folder) if f.is_file]
        for m in messages:
            for p in m.parts if m else []:
                store.move(p, f"{folder}/{self.run}-{p.rsplit('/', 1)[1]}")
        for p in old if self.overwrite else ():
            store.delete_file(p)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _at(self.path)
        if store.get_file_info(f"{folder}/_staging-{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{folder}/_staging-{self.run}")
