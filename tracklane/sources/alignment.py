"""Frames of several files and sources: numbering, steps, lock-step joins, chapters, and what is known of files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text
from .tables import latest_version

PROBE = "format struct<duration: string>, streams array<struct<codec_type: string, width: int, height: int, avg_frame_rate: string, r_frame_rate: string, pix_fmt: string, bit_rate: string, sample_rate: string, channels: int, channel_layout: string>>"


def video_frames(files: DataFrame, step: int = 1, keys: tuple[str, ...] = ("game",), start: int = 1, most: int | None = None) -> DataFrame:
    """keys, frame (from 1, over a key's files in order), file, at (the frame in it); every `step`-th from `start`, at most `most`.

    `files` holds keys, ord, file and n_frames.
    """
    before = F.coalesce(F.sum("n_frames").over(W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = files.withColumn("_b", before).filter("n_frames > 0").select(*keys, "file", "_b", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_frames").cast("long"))).alias("at"))
    rows = rows.withColumn("_all", F.col("_b") + F.col("at")).filter((F.col("_all") >= start) & ((F.col("_all") - start) % step == 0))
    rows = rows.withColumn("frame", F.expr(f"(_all - {start}) div {step} + 1"))
    return (rows if most is None else rows.filter(F.col("frame") <= most)).select(*keys, "frame", "file", "at")


def batched(rows: DataFrame, size: int, keys: tuple[str, ...] = ("game",), order: str = "frame") -> DataFrame:
    """Rows with batch and place in it (both from 0), by their order."""
    k = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("_k", k).withColumns({"batch": F.expr(f"_k div {size}"), "place": F.col("_k") % size}).drop("_k")


def lock_step(sources: dict[str, DataFrame], keys: tuple[str, ...] = ("game",), order: str = "frame") -> DataFrame:
    """keys, step (from 0), and each source's value column by its name, as long as all sources last; each holds keys, order, value."""
    out = None
    for name, rows in sources.items():
        one = rows.withColumn("step", F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).select(*keys, "step", F.col("value").alias(name))
        out = one if out is None else out.join(one, [*keys, "step"])
    return out


def rate_step(own: Column, other: Column) -> Column:
    """The step that brings a rate down to the other's where it is a whole multiple of it, else 1."""
    ratio = own / other
    return F.when((F.floor(ratio) > 1) & (F.abs(ratio - F.floor(ratio)) <= 1e-8 + 1e-5 * ratio), F.floor(ratio)).otherwise(F.lit(1)).cast("long")


def align_rates(left: DataFrame, right: DataFrame, rates: DataFrame, keys: tuple[str, ...] = ("game",)) -> DataFrame:
    """keys, step, left, right: frames of two cameras beside each other; `rates` holds keys, left_fps, right_fps, left_start, right_start."""
    r = rates.withColumns({"_ls": rate_step(F.col("left_fps"), F.col("right_fps")), "_rs": rate_step(F.col("right_fps"), F.col("left_fps"))})

    def side(rows: DataFrame, name: str, start: str, step: str) -> DataFrame:
        got = rows.join(F.broadcast(r.select(*keys, F.col(start).alias("_from"), F.col(step).alias("_step"))), list(keys))  # a row a game
        got = got.filter((F.col("frame") >= F.col("_from")) & ((F.col("frame") - F.col("_from")) % F.col("_step") == 0))
        return got.select(*keys, "frame", F.col("frame").alias("value"))

    return lock_step({"left": side(left, "left", "left_start", "_ls"), "right": side(right, "right", "right_start", "_rs")}, keys)


def chapters(files: DataFrame, path: str = "path") -> DataFrame:
    """camera, chapter, path of video files by their paths: folders cam1, cam2 ... are cameras, whose chapters count from 1.

    In a game with such folders only those count. In a camera's folder vendor names come first, by video and chapter;
    else the left, else the right files. Without camera folders, vendor videos keep their own chapters, and left and right
    files their part numbers.
    """
    p = F.col(path)
    name, folder = F.regexp_extract(p, r"([^/]+)$", 1), F.regexp_extract(p, r"^(.*)/[^/]+$", 1)
    cam = F.nullif(F.lower(F.regexp_extract(folder, r"(?i)(?:^|/)(cam\d+)$", 1)), F.lit(""))
    c = text.chapter(name)
    lr = F.nullif(F.lower(F.regexp_extract(name, r"(?i)^(left|right)(?:-\d+)?\.(?:mp4|mkv|avi|mov)$", 1)), F.lit(""))
    part = F.coalesce(F.regexp_extract(name, r"-(\d+)\.", 1).try_cast("int"), F.lit(1))
    kind = F.when(c["video"].isNotNull(), 0).when(lr == "left", 1).when(lr == "right", 2)
    game = F.when(cam.isNotNull(), F.regexp_extract(folder, r"^(.*?)/?[^/]+$", 1)).otherwise(folder)
    rows = files.select(game.alias("game"), cam.alias("_cam"), kind.alias("_kind"), c["video"].alias("_video"), F.coalesce(c["chapter"], part).alias("_chapter"), lr.alias("_lr"), p.alias("path")).filter("_kind is not null")
    rows = rows.withColumn("_cams", F.max(F.col("_cam").isNotNull()).over(W.partitionBy("game"))).filter(~F.col("_cams") | F.col("_cam").isNotNull())
    rows = rows.withColumn("_best", F.min("_kind").over(W.partitionBy("game", "_cam"))).filter(F.col("_cam").isNull() | (F.col("_kind") == F.col("_best")))
    linear = F.row_number().over(W.partitionBy("game", "_cam").orderBy(F.lpad(F.coalesce("_video", F.lit("")), 20, "0"), "_chapter", "path"))
    camera = F.coalesce(F.col("_cam"), F.col("_video"), F.col("_lr"))
    return rows.select("game", camera.alias("camera"), F.when(F.col("_cam").isNotNull(), linear).otherwise(F.col("_chapter")).alias("chapter"), "path")


def probed(rows: DataFrame, column: str = "probe", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """keys, duration, width, height, fps, pixels, sample_rate, channels of a prober's JSON: its first video and first audio stream."""
    j = F.from_json(column, PROBE)
    first = lambda kind: F.try_element_at(F.filter(j["streams"], lambda s: s["codec_type"] == kind), F.lit(1))
    v, a = first("video"), first("audio")
    rate = F.coalesce(F.nullif(v["avg_frame_rate"], F.lit("")), v["r_frame_rate"], F.lit("0/1"))
    return rows.select(
        *keys, F.coalesce(j["format"]["duration"].try_cast("double"), F.lit(0.0)).alias("duration"), F.coalesce(v["width"], F.lit(0)).alias("width"), F.coalesce(v["height"], F.lit(0)).alias("height"),
        F.when(v.isNotNull(), text.parse_rate(rate)).alias("fps"), F.when(v.isNotNull(), F.coalesce(v["pix_fmt"], F.lit("yuv420p"))).alias("pixels"), a["sample_rate"].try_cast("int").alias("sample_rate"), a["channels"].alias("channels"),
    )


def ready_folders(listings: DataFrame, marker: str, checks: int) -> DataFrame:
    """folder: those whose marker file has one size and time in the last `checks` listings; rows hold at (the listing), path, size, modified."""
    rows = listings.filter(F.regexp_extract("path", r"([^/]+)$", 1) == marker).withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    recent = rows.withColumn("_k", F.row_number().over(W.partitionBy("folder").orderBy(F.desc("at")))).filter(F.col("_k") <= checks)
    kinds = recent.groupBy("folder").agg(F.count("*").alias("n"), F.count_distinct("size", "modified").alias("k"))
    return kinds.filter((F.col("n") == checks) & (F.col("k") == 1)).select("folder")


def listing(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that the session can read; empty where there is none."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def game_bundle(spark: SparkSession, folder: str, **names: str) -> dict[str, str | None] | None:
    """Paths of a game's tracking, camera, camera_fast and pose tables, the latest of each, or of the given names; None unless the first two exist."""
    have, out = listing(spark, folder), {}
    for stem in ("tracking", "camera", "camera_fast", "pose"):
        name = names.get(stem)
        name = (name if name in have else None) if name else latest_version(have, stem)
        out[stem] = f"{folder.rstrip('/')}/{name}" if name else None
    return out if out["tracking"] and out["camera"] else None


def free_name(have: list[str], name: str, most: int = 1000) -> str:
    """`name`, or the first of name-1, name-2 ... that is not among those there."""
    stem, dot, ext = name.rpartition(".")
    stem, ext = (stem, dot + ext) if dot else (name, "")
    for k in range(most + 1):
        tried = f"{stem}-{k}{ext}" if k else name
        if tried not in have:
            return tried
    raise ValueError(f"no free name for {name}")


def numbered(files: DataFrame, prefix: str, ext: str, column: str = "name") -> DataFrame:
    """number, name of files `prefix_N.ext` with digits only."""
    n = F.regexp_extract(column, rf"^{re.escape(prefix)}_(\d+)\.{re.escape(ext)}$", 1)
    return files.select(n.try_cast("long").alias("number"), F.col(column).alias("name")).filter("number is not null")


class Rows(DataSource):
    """Rows of any Python iterable as a Spark source: `make(part, parts)` gives a part's rows.

    Options: parts, repeat (times each part is read), batch_size (rows a batch, for the column batch), and strict (true: a
    row that is no dict is an error, else it is the column `value`). Subclasses set `columns` and `make`.
    """

    columns = "value string"
    make: Callable[[int, int], Iterator] = staticmethod(lambda part, parts: iter(()))

    @classmethod
    def name(cls) -> str:
        return cls.__name__.lower()

    def schema(self) -> str:
        return f"part int, batch bigint, {self.columns}"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _RowsReader(self, schema)


class _RowsReader(DataSourceReader):
    def __init__(self, source: Rows, schema: T.StructType):
        o = {k.lower(): v for k, v in source.options.items()}
        self.make, self.names = type(source).make, schema.names[2:]
        self.parts, self.repeat, self.batch, self.strict = int(o.get("parts", 1)), int(o.get("repeat", 1)), int(o.get("batch_size", 1)), o.get("strict", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n = 0
        for _ in range(self.repeat):
            for row in self.make(partition.value, self.parts):
                if not isinstance(row, dict):
                    if self.strict:
                        raise TypeError("a strict source gives dicts")
                    row = {"value": row}
                yield (partition.value, n // self.batch, *(row.get(c) for c in self.names))
                n += 1
