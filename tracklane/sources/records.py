"""Rows of the stored tables from per-frame samples, sources that attach stored rows to frames, and named writers.

A sample is one row for each frame with arrays side by side (boxes, scores, labels ...). Stored tables are those of
`tables`; each writer takes a run label, which leads the file's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import tables

NO_POSE = '{"predictions":[]}'


def repaired(values: Column, n: Column, default: Column) -> Column:
    """An array of n values: as it is if it has n, a single one repeated, else the default n times."""
    size = F.coalesce(F.size(values), F.lit(0))
    return F.when(size == n, values).when((size == 1) & (n > 1), F.array_repeat(values[0], n)).otherwise(F.array_repeat(default, n))


def trimmed(values: Column, valid: Column) -> Column:
    """The first `valid` values of a padded array; all where that is null."""
    return F.when(valid.isNull(), values).otherwise(F.slice(values, 1, F.greatest(valid, F.lit(0))))


def detection_records(samples: DataFrame) -> DataFrame:
    """(frame, bboxes TLBR, scores, labels) as rows of the detections table; scores are repaired by 1, labels by 0."""
    n = F.size("bboxes")
    zipped = F.arrays_zip(F.col("bboxes").alias("b"), repaired(F.col("scores"), n, F.lit(1.0)).alias("s"), repaired(F.col("labels"), n, F.lit(0).cast("long")).alias("l"))
    rows = samples.select("frame", F.explode(zipped).alias("z"))
    box = [F.col("z.b")[i].cast("double").alias(f"BBox_{c}") for i, c in enumerate(("X1", "Y1", "X2", "Y2"))]
    return rows.select(F.col("frame").cast("long").alias("Frame"), *box, F.col("z.s").cast("double").alias("Scores"), F.col("z.l").cast("long").alias("Labels"))


def tracking_records(samples: DataFrame, jerseys: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """(frame, ids, bboxes TLBR, scores, labels, mask) as rows of the tracking table; only tracks that the mask (null: all) holds.

    `jerseys` (frame, tracking_id, number, score; ord) gives JerseyInfo, the last of a track's frame; `actions` (frame,
    tracking_id, label, score, label_index) the action columns; tracks without one keep the defaults, ids below 0 match none.
    """
    zipped = F.arrays_zip(F.col("ids").alias("i"), F.col("bboxes").alias("b"), F.col("scores").alias("s"), F.col("labels").alias("l"), F.coalesce("mask", F.transform("ids", lambda i: F.lit(True))).alias("m"))
    rows = samples.select("frame", F.explode(zipped).alias("z")).filter("z.m")
    b = F.col("z.b")
    tlwh = [b[0].alias("BBox_X"), b[1].alias("BBox_Y"), (b[2] - b[0]).alias("BBox_W"), (b[3] - b[1]).alias("BBox_H")]
    out = rows.select(F.col("frame").alias("Frame"), F.col("z.i").alias("ID"), *tlwh, F.col("z.s").alias("Scores"), F.col("z.l").alias("Labels"))
    keys = ["Frame", "ID"]
    if jerseys is not None:
        info = F.to_json(F.struct("tracking_id", "number", "score"))
        last = jerseys.groupBy(F.col("frame").alias("Frame"), F.col("tracking_id").alias("ID")).agg(F.max_by(info, "ord").alias("JerseyInfo"))
        out = out.join(last, keys, "left")
    if actions is not None:
        found = actions.filter("tracking_id >= 0").groupBy(F.col("frame").alias("Frame"), F.col("tracking_id").alias("ID")).agg(F.max(F.struct("score", "label", "label_index")).alias("_a"))
        out = out.join(found, keys, "left").withColumns({"ActionLabel": F.col("_a.label"), "ActionScore": F.col("_a.score"), "ActionIndex": F.col("_a.label_index")}).drop("_a")
    return tables.with_defaults(out)


def pose_records(samples: DataFrame) -> DataFrame:
    """(frame, predictions: array of structs) as rows of the pose table; a frame without any has an empty list."""
    return samples.select(F.col("frame").cast("long").alias("Frame"), F.coalesce(F.to_json(F.struct("predictions")), F.lit(NO_POSE)).alias("PoseJSON")).withColumn("PoseJSON", F.when(F.col("PoseJSON") == "{}", NO_POSE).otherwise(F.col("PoseJSON")))


def action_records(samples: DataFrame) -> DataFrame:
    """(frame, actions: array of structs) as rows of the actions table."""
    return samples.select(F.col("frame").cast("long").alias("Frame"), F.coalesce(F.to_json("actions"), F.lit("[]")).alias("ActionJSON"))


def camera_records(samples: DataFrame) -> DataFrame:
    """(frame, box TLBR) as rows of the camera table."""
    b = F.col("box")
    return samples.select(F.col("frame").cast("long").alias("Frame"), *[v.cast("double").alias(f"BBox_{c}") for v, c in zip((b[0], b[1], b[2] - b[0], b[3] - b[1]), "XYWH", strict=True)])


def batch_records(batches: DataFrame, size: Column) -> DataFrame:
    """Rows (frame, value) of batches (frame: the first one, values): the i-th value belongs to the i-th frame of the batch, as far as the batch goes."""
    return batches.select("frame", F.posexplode(F.slice("values", 1, size)).alias("_i", "value")).select((F.col("frame") + F.col("_i")).alias("frame"), "value")


def camera_baseline(frames: DataFrame, annotated: DataFrame | None = None) -> DataFrame:
    """A camera table of all `frames` (frame): a box of -1 where nothing is `annotated` (Frame, BBox_X, BBox_Y, BBox_W, BBox_H) yet."""
    every = frames.select(F.col("frame").cast("long").alias("Frame")).distinct()
    names = [f"BBox_{c}" for c in "XYWH"]
    if annotated is None:
        return every.select("Frame", *[F.lit(-1.0).alias(n) for n in names])
    return every.join(annotated.select("Frame", *names), "Frame", "left").fillna(-1.0, names)


def _file(folder: str, stem: str, label: str | None) -> str:
    label = (label or "").strip()
    return f"{folder.rstrip('/')}/{label + ('' if label.endswith(('_', '-')) else '-') if label else ''}{stem}.csv"


def save_detections(samples: DataFrame, folder: str, label: str | None = None) -> str:
    path = _file(folder, "detections", label)
    tables.write_table(detection_records(samples), path)
    return path


def save_tracking(samples: DataFrame, folder: str, label: str | None = None, jerseys: DataFrame | None = None, actions: DataFrame | None = None) -> str:
    path = _file(folder, "tracking", label)
    tables.write_table(tracking_records(samples, jerseys, actions), path)
    return path


def save_pose(frames: DataFrame, poses: DataFrame, folder: str, label: str | None = None) -> str:
    """Every frame gets a row, without a pose an empty one."""
    path = _file(folder, "pose", label)
    tables.write_table(pose_records(frames.select("frame").distinct().join(poses, "frame", "left")), path)
    return path


def save_actions(samples: DataFrame, folder: str, label: str | None = None) -> str:
    path = _file(folder, "actions", label)
    tables.write_table(action_records(samples), path)
    return path


def save_camera(slow: DataFrame, fast: DataFrame, folder: str, label: str | None = None) -> tuple[str, str]:
    paths = _file(folder, "camera", label), _file(folder, "camera_fast", label)
    for rows, path in zip((slow, fast), paths, strict=True):
        tables.write_table(camera_records(rows), path)
    return paths


def append_stream(rows: DataFrame, path: str, checkpoint: str, form: str = "parquet"):
    """A stream's rows appended to a table, each once; the started query."""
    return rows.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


# Sources that attach stored rows to frames.


def attach_detections(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """frames with detections: an array of (box, score, label) by x, empty where none is stored."""
    entry = F.struct(F.array("BBox_X1", "BBox_Y1", "BBox_X2", "BBox_Y2").alias("box"), F.col("Scores").alias("score"), F.col("Labels").alias("label"))
    held = detections.groupBy(F.col("Frame").alias("frame")).agg(F.array_sort(F.collect_list(entry)).alias("detections"))
    return frames.join(held, "frame", "left").withColumn("detections", F.coalesce("detections", F.array().cast(held.schema["detections"].dataType)))


def attach_tracks(frames: DataFrame, tracking: DataFrame) -> DataFrame:
    """frames (batch, frame) with their tracks, how many, and the batch's most tracks of a frame and greatest id (0 where none)."""
    entry = F.struct(F.col("ID").alias("id"), F.array("BBox_X", "BBox_Y", "BBox_W", "BBox_H").alias("box"))
    held = tracking.groupBy(F.col("Frame").alias("frame")).agg(F.array_sort(F.collect_list(entry)).alias("tracks"), F.max("ID").alias("_id"))
    out = frames.join(held, "frame", "left").withColumn("tracks", F.coalesce("tracks", F.array().cast(held.schema["tracks"].dataType))).withColumn("n", F.size("tracks"))
    by = W.partitionBy("batch")
    return out.withColumns({"nr_tracks": F.max("n").over(by), "max_tracking_id": F.coalesce(F.max("_id").over(by), F.lit(0))}).drop("_id")


def attach_poses(frames: DataFrame, pose: DataFrame) -> DataFrame:
    return frames.join(pose.select(F.col("Frame").alias("frame"), "PoseJSON"), "frame", "left").withColumn("PoseJSON", F.coalesce("PoseJSON", F.lit(NO_POSE)))


def attach_camera(frames: DataFrame, camera: DataFrame, fast: DataFrame | None = None) -> DataFrame:
    """The first frame of each batch with its camera box; with a fast camera, its box too, else the slow one again."""
    box = lambda d, p: d.select(F.col("Frame").alias("frame"), F.array("BBox_X", "BBox_Y", "BBox_W", "BBox_H").alias(p))
    first = frames.groupBy("batch").agg(F.min("frame").alias("frame")).join(box(camera, "slow"), "frame", "left")
    return first if fast is None else first.join(box(fast, "fast"), "frame", "left").withColumn("fast", F.coalesce("fast", "slow"))
