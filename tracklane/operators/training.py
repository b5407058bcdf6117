"""Inputs and targets of models that steer a camera: pose features, layouts, targets of the frame before, even samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import boxes


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def _deviation(values: Column) -> Column:
    """Population deviation in one pass, with running means."""

    def add(a: Column, v: Column) -> Column:
        mean = a["m"] + (v - a["m"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("m"), (a["s"] + (v - a["m"]) * (v - mean)).alias("s"))

    start = F.struct(*[F.lit(0.0).alias(c) for c in "nms"])
    return F.when(F.size(values) > 0, F.aggregate(values, start, add, lambda a: F.sqrt(a["s"] / a["n"])))


def _share(value: Column) -> Column:
    return F.coalesce(boxes.clamp(value, F.lit(0.0), F.lit(1.0)), F.lit(0.0))


def pose_features(poses: DataFrame, scale_x: float, scale_y: float, max_players: int, pose: str = "pose") -> DataFrame:
    """Eight features of each row's pose struct (bboxes, keypoint_scores, bbox_scores, scores), from 0 to 1; 0 where there is none.

    They are the count, mean and population deviation of centres, mean height, mean score (of keypoints, else boxes, else
    `scores`) and the share of keypoint scores over a half. All is worked out inside a row.
    """
    p = F.col(pose)
    found = p["bboxes"]
    cx = F.transform(found, lambda b: (b[0] + b[2]) / 2 / scale_x)
    cy = F.transform(found, lambda b: (b[1] + b[3]) / 2 / scale_y)
    high = F.transform(found, lambda b: (b[3] - b[1]) / scale_y)
    points = F.flatten(p["keypoint_scores"])
    score = F.coalesce(_mean(points), _mean(p["bbox_scores"]), _mean(p["scores"]))
    sure = _mean(F.transform(points, lambda v: (v > 0.5).cast("double")))
    made = {"count": F.size(found) / max_players, "mean_cx": _mean(cx), "mean_cy": _mean(cy), "std_cx": _deviation(cx), "std_cy": _deviation(cy), "mean_h": _mean(high), "mean_score": score, "sure": sure}
    return poses.select(*[c for c in poses.columns if c != pose], *[_share(c).alias(n) for n, c in made.items()])


def player_layout(rows: DataFrame, scale_x: float, scale_y: float, slots: int, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """keys, boxes: TLWH of the first `slots` finite boxes by centre x (then id), scaled to 0..1, padded with zeros to four a slot."""
    part = lambda c, k: _share(F.col(c) / k)
    fine = rows.withColumn("_ok", boxes.finite(*(F.col(c) for c in "xywh")))
    entry = F.struct((F.col("x") + F.col("w") / 2).alias("c"), "id", F.array(part("x", scale_x), part("y", scale_y), part("w", scale_x), part("h", scale_y)).alias("b"))
    lists = fine.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_ok"), entry))).alias("_l"))
    flat = F.flatten(F.transform(F.slice("_l", 1, slots), lambda e: e["b"]))
    return lists.select(*keys, F.slice(F.concat(flat, F.array_repeat(F.lit(0.0), 4 * slots)), 1, 4 * slots).alias("boxes"))


def previous_target(camera: DataFrame, game: tuple[str, ...], default: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> DataFrame:
    """The camera's TLWH with that of the game's frame before (by order, not by number) as px, py, pw, ph."""
    w = W.partitionBy(*game).orderBy("frame")
    return camera.withColumns({f"p{c}": F.lag(c, 1, d).over(w) for c, d in zip("xywh", default, strict=True)})


def center_height(camera: DataFrame, scale_x: float, scale_y: float) -> DataFrame:
    """frame-keyed targets cx, cy, height, from 0 to 1."""
    return camera.withColumns({"cx": _share((F.col("x") + F.col("w") / 2) / scale_x), "cy": _share((F.col("y") + F.col("h") / 2) / scale_y), "height": _share(F.col("h") / scale_y)}).drop(*"xywh")


def evenly_spaced(points: DataFrame, samples: int, by: str, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """keys, sample, id: `samples` ids at even steps down the order; a frame of fewer points repeats some."""
    lists = points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(by, "id"))), lambda s: s["id"]).alias("_l"))
    at = lambda i: F.lit(1) + F.floor(i * (F.size("_l") - 1) / max(1, samples - 1)).cast("int")
    return lists.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.element_at("_l", at(i)))).alias("sample", "id"))


def top_classes(scores: DataFrame, k: int, floor: float, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, label, score, labels: the best class of rows (keys, label, score) and the best k, where the best reaches the floor."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "label")
    best = scores.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    out = best.groupBy(*keys).agg(F.min_by("label", "_r").alias("label"), F.max("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("_r", "label"))), lambda s: s["label"]).alias("labels"))
    return out.filter(F.col("score") >= floor)


def with_model(rows: DataFrame, window: str, model, schema: str) -> DataFrame:
    """Rows with what `model(array of shape (n, length, features))` gives for their windows (arrays of arrays): one array of numbers each, as struct columns of `schema`."""
    import numpy as np
    import pandas as pd

    out = rows.schema
    made = T.StructType.fromDDL(schema)

    def run(batches):
        for pdf in batches:
            values = np.asarray(model(np.array([np.stack(w) for w in pdf[window]], float))) if len(pdf) else np.zeros((0, len(made)))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(values, columns=made.names)], axis=1)

    return rows.mapInPandas(run, T.StructType(out.fields + made.fields))


def with_windows(rows: DataFrame, window: str, model, outputs: int) -> DataFrame:
    """Rows with `outputs`: what `model(list of arrays of shape (length, features))` gives for windows of any lengths."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            y = [np.asarray(v, float).tolist() for v in model([np.array(w, float) for w in b[window].to_pylist()])] if len(b) else []
            if any(len(v) != outputs for v in y):
                raise ValueError(f"the model has to give {outputs} numbers for each window")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(y, pa.list_(pa.float64()))], [*b.schema.names, "outputs"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("outputs", T.ArrayType(T.DoubleType()))]))


def autoregressive(rows: DataFrame, model, outputs: int, window: int, first: tuple[float, ...] | None = None, residual: float | None = None, keys: tuple[str, ...] = ("game",), features: str = "features") -> DataFrame:
    """keys, frame, outputs: what `model` gives frame by frame, its outputs of the frame before fed back behind the frame's features.

    All the games of a task advance together: `model(array of shape (n, length, features + outputs))` gets the last `window` frames (fewer at
    the start, one length at a time) of each and returns shape (n, outputs). `first` stands for the outputs before the first frame (default 0.5 each). With
    `residual` the model gives changes around 0.5, up to so much either way, which are added to the outputs before and kept in 0 to 1. A task holds one window a game.
    """
    import numpy as np

    start = np.full(outputs, 0.5) if first is None else np.asarray(first, float)
    step = F.row_number().over(W.partitionBy(*keys).orderBy("frame"))
    ordered = rows.select(*keys, "frame", F.col(features).alias("_x"), step.alias("_step")).repartition(*keys).sortWithinPartitions("_step", *keys)

    def answer(held: dict, now: list, k: int):
        windows = []
        for key, _, x in now:
            past, before = held.get(key, ([], start))
            past = [*past[-(window - 1) :], np.r_[np.asarray(x, float), before]] if window > 1 else [np.r_[np.asarray(x, float), before]]
            windows.append(past)
        y = np.asarray(model(np.array(windows)), float).reshape(len(now), outputs)
        if residual is not None:
            y = np.clip(np.array([w[-1][-outputs:] for w in windows]) + (y - 0.5) * 2 * residual, 0.0, 1.0)
        held.update({key: (w, v) for (key, _, _), w, v in zip(now, windows, y, strict=True)})
        return y

    def run(batches):
        import pyarrow as pa

        held: dict = {}
        now: list = []
        step = None
        names = [*keys, "frame", "outputs"]

        def told():
            y = answer(held, now, step)
            cols = [*zip(*[k for k, _, _ in now], strict=True), [f for _, f, _ in now], [v.tolist() for v in y]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for b in batches:
            kinds = [*(b.schema.field(k).type for k in keys), pa.int64(), pa.list_(pa.float64())]
            for *key, frame, x, k in zip(*(b[c].to_pylist() for c in (*keys, "frame", "_x", "_step")), strict=True):
                if step is not None and k != step:
                    yield told()
                    now.clear()
                step = k
                now.append((tuple(key), frame, x))
        if now:
            yield told()

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return ordered.mapInArrow(run, f"{kinds}, frame bigint, outputs array<double>")


def transformed(rows: DataFrame, change, schema: T.StructType | None = None) -> DataFrame:
    """Rows through a function of pandas batches."""
    return rows.mapInPandas(lambda batches: (change(b) for b in batches), schema or rows.schema)


def crop(camera: DataFrame, width: int, height: int, aspect: float) -> DataFrame:
    """l, t, w, h of the picture that a camera box (TLWH) shows: grown to the aspect, fitted into and moved inside the frame, in whole pixels."""
    wide = boxes.with_aspect(boxes.tlwh_to_tlbr(boxes.cols(*"xywh")), aspect)
    inside = boxes.tlbr_to_tlwh(boxes.fit_inside(wide, F.lit(float(width)), F.lit(float(height))))
    return camera.withColumns({n: F.round(F.round(v, 6)).cast("int") for n, v in zip(("l", "t", "cw", "ch"), inside, strict=True)})
