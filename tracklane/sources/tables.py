"""Readers and writers of frame-keyed tables: headerless CSV by schema, MOT text, TSV, Parquet and streams."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def _schema(**fields: str) -> T.StructType:
    kinds = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([T.StructField(k, kinds[v]) for k, v in fields.items()])


_BOX = {"BBox_X": "double", "BBox_Y": "double", "BBox_W": "double", "BBox_H": "double"}
_TRACK = {"Frame": "long", "ID": "long"} | _BOX | {"Scores": "double", "Labels": "long", "Visibility": "long", "JerseyInfo": "string"}
_ACTION = {"ActionLabel": "string", "ActionScore": "double", "ActionIndex": "long"}
DETECTIONS = _schema(Frame="long", BBox_X1="double", BBox_Y1="double", BBox_X2="double", BBox_Y2="double", Scores="double", Labels="long")
TRACKING = _schema(**_TRACK, **_ACTION)
CAMERA = _schema(Frame="long", **_BOX)
POSE = _schema(Frame="long", PoseJSON="string")
ACTIONS = _schema(Frame="long", ActionJSON="string")
JERSEY_INFO = "tracking_id bigint, number int, score double"
POSE_JSON = "predictions array<struct<bboxes: array<array<double>>, scores: array<double>, bbox_scores: array<double>, labels: array<bigint>, keypoints: array<array<array<double>>>, keypoint_scores: array<array<double>>>>"
ACTION_JSON = "array<struct<tracking_id: bigint, label: string, label_index: bigint, score: double, topk_indices: array<bigint>, topk_scores: array<double>>>"
DEFAULTS = {"Visibility": -1, "JerseyInfo": "{}", "ActionLabel": "", "ActionScore": 0.0, "ActionIndex": -1}


def layout(kind: str, n: int) -> list[str]:
    """Names of a file's columns by their number; names that the table lacks are dropped after reading."""
    if kind == "detections":
        return (DETECTIONS.names + ["PoseIndex"] + [f"_x{i}" for i in range(n)])[:n]
    base, rest = list(_TRACK), list(_ACTION)
    if n in (11, 14) or n > 14:
        base = [*base, "PoseIndex"]
    return (base + rest + [f"_x{i}" for i in range(n)])[:n]


def training_layout(n: int) -> list[str]:
    """Names of a tracking file's columns as the training side reads them: with or without a pose index and actions; narrower files lack the last base columns."""
    base, rest = list(_TRACK), list(_ACTION)
    names = [*base, "PoseIndex", *rest] if n >= 14 else [*base, "PoseIndex"] if n == 11 else [*base, *rest] if n >= 13 else base
    if len(names) < n < 13:
        raise ValueError(f"a tracking table of {n} columns")
    return names


def read_training_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A tracking CSV by `training_layout`: columns beyond it are left out, the pose index too; base columns that it lacks are null."""
    raw = spark.read.options(header=False, quote='"', escape='"', nanValue="nan").csv(path)
    names = training_layout(len(raw.columns))
    kinds = {f.name: f.dataType for f in TRACKING}
    at = dict(zip(names, raw.columns, strict=False))
    value = lambda n: F.col(at[n]).try_cast(kinds[n]) if n in at else F.lit(None).cast(kinds[n])
    return raw.select(*[value(n).alias(n) for n in names if n != "PoseIndex"])


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A detections, tracking, camera, pose or actions CSV; missing columns are null, NaN becomes null."""
    want = {"detections": DETECTIONS, "tracking": TRACKING, "camera": CAMERA, "pose": POSE, "actions": ACTIONS}[kind]
    options = {"header": False, "quote": '"', "escape": '"', "nanValue": "nan"}
    if kind in ("detections", "tracking"):
        first = spark.read.options(**options).csv(path)
        names = layout(kind, len(first.columns))
        raw = first.toDF(*names)
    else:
        raw = spark.read.options(**options).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in want])).csv(path)
    out = []
    for f in want:
        value = F.col(f.name).try_cast("double") if f.name in raw.columns and not isinstance(f.dataType, T.StringType) else F.col(f.name) if f.name in raw.columns else F.lit(None)
        if not isinstance(f.dataType, T.StringType) and f.name in raw.columns:
            value = F.when(~F.isnan(value), value)
        out.append(value.cast(f.dataType).alias(f.name))
    return raw.select(out)


def latest_version(names: list[str], stem: str, ext: str = "csv") -> str | None:
    """stem.ext is version 0, stem-N.ext version N; the highest."""
    found = [(int(m[1] or 0), n) for n in names if (m := re.fullmatch(rf"{re.escape(stem)}(?:-(\d+))?\.{ext}", PurePosixPath(n).name))]
    return max(found)[1] if found else None


def pose_rows(pose: DataFrame) -> DataFrame:
    """Frame and the first prediction; bad JSON counts as none."""
    parsed = F.from_json("PoseJSON", POSE_JSON, {"mode": "PERMISSIVE"})
    return pose.select("Frame", F.try_element_at(parsed["predictions"], F.lit(1)).alias("pose"))


def action_rows(actions: DataFrame) -> DataFrame:
    """One row for each frame and track."""
    return actions.select("Frame", F.inline(F.coalesce(F.from_json("ActionJSON", ACTION_JSON, {"mode": "PERMISSIVE"}), F.array().cast(ACTION_JSON))))


def jersey_info(tracking: DataFrame) -> DataFrame:
    """Tracking with JerseyInfo parsed; empty or bad JSON is null."""
    info = F.from_json(F.nullif("JerseyInfo", F.lit("{}")), JERSEY_INFO, {"mode": "PERMISSIVE"})
    return tracking.withColumn("jersey", F.when(info["number"].isNotNull(), info))


def with_defaults(tracking: DataFrame) -> DataFrame:
    """The columns of the tracking table in order, the missing ones with their defaults."""
    have = {f.name: F.coalesce(F.col(f.name), F.lit(DEFAULTS[f.name])) if f.name in DEFAULTS else F.col(f.name) for f in TRACKING if f.name in tracking.columns}
    return tracking.select([have.get(f.name, F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in TRACKING])


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).options(header=False, quote='"', escape='"').csv(path)


def read_mot(spark: SparkSession, path: str, truth: bool = False) -> DataFrame:
    """frame, id, x, y, w, h, score of MOT text; short lines and frames before 1 are skipped; truth keeps marked rows of class 1."""
    part = F.split("value", ",")
    at = lambda i: F.try_element_at(part, F.lit(i + 1)).try_cast("double")
    rows = spark.read.text(path).filter(F.size(part) >= 7).select(at(0).cast("long").alias("frame"), at(1).cast("long").alias("id"), *[at(i + 2).alias(c) for i, c in enumerate("xywh")], at(6).alias("score"), at(7).alias("label"))
    rows = rows.filter("frame >= 1")
    return (rows.filter("score <> 0 and label = 1") if truth else rows).drop("label")


def mot_line():
    """A row's line of MOT text; null for ids below 0."""
    return F.when(F.col("id") >= 0, F.format_string("%d,%d,%.6f,%.6f,%.6f,%.6f,%.6f,-1,-1,-1", "frame", "id", "x", "y", "w", "h", "score"))


def kitti_line():
    """A row's line of KITTI text: frames from 0, edges for sizes; null for ids below 0."""
    form = "%d %d pedestrian 0 0 -10 %.6f %.6f %.6f %.6f -10 -10 -10 -1000 -1000 -1000 -10"
    return F.when(F.col("id") >= 0, F.format_string(form, F.col("frame") - 1, "id", "x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")))


def write_mot(rows: DataFrame, path: str, kitti: bool = False) -> None:
    line = (kitti_line() if kitti else mot_line()).alias("value")
    rows.select(line).filter("value is not null").write.mode("overwrite").text(path)


def write_points(rows: DataFrame, path: str) -> None:
    rows.select("x", "y").write.mode("overwrite").csv(path, header=True)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text with a header; ragged rows are padded with empty texts."""
    return spark.read.options(sep="\t", header=True, mode="PERMISSIVE").csv(path).na.fill("")


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor begin with #."""
    return spark.read.text(path).filter(~F.trim("value").rlike("^(#.*)?$")).agg(F.count("*").alias("n"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """x, y of a tolerant CSV: header, comments and short rows are skipped."""
    part = F.split("value", ",")
    xy = [F.trim(F.try_element_at(part, F.lit(i))).try_cast("double").alias(c) for i, c in ((1, "x"), (2, "y"))]
    return spark.read.text(path).filter(~F.trim("value").startswith("#")).select(xy).na.drop()
