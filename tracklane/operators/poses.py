"""Boxes, scores and regions of poses, as columns over arrays of (x, y) key points and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import boxes

#: The padding of a region, the least score of a sure point, and the numbers (from 0) of a person's points.
PADDING, SURE = 5, 0.4
LEFT_SHOULDER, RIGHT_SHOULDER, LEFT_HIP, RIGHT_HIP = 5, 6, 11, 12
ARMS = {"left": (5, 7, 9), "right": (6, 8, 10)}


def points_box(points: Column) -> boxes.Box:
    """TLBR around key points."""
    at = lambda i: F.transform(points, lambda p: p[i])
    return F.array_min(at(0)), F.array_min(at(1)), F.array_max(at(0)), F.array_max(at(1))


def detection_score(box_score: Column, point_scores: Column, adder: float = 0.25) -> Column:
    """The box's own score, else the mean of its points', else 1; the adder on it, and clamped to 0..1."""
    mean = F.when(F.size(point_scores) > 0, F.aggregate(point_scores, F.lit(0.0), lambda a, v: a + v) / F.size(point_scores))
    score = F.coalesce(box_score, mean, F.lit(1.0)) + adder
    return boxes.clamp(score, F.lit(0.0), F.lit(1.0)) if adder else score


def detections(poses: DataFrame, pose: str = "pose", label: int = 0, adder: float = 0.25) -> DataFrame:
    """One row for each person of a row's pose struct: number, TLBR (of the box, else of the points), score, label."""
    p = F.col(pose)
    n = F.greatest(F.size(p["bboxes"]), F.size(p["keypoints"]))
    rows = poses.withColumn("_i", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))))
    own, points = F.try_element_at(p["bboxes"], F.col("_i")), F.try_element_at(p["keypoints"], F.col("_i"))
    around = points_box(points)
    side = [F.coalesce(own[i], around[i]).alias(c) for i, c in enumerate(("l", "t", "r", "b"))]
    score = detection_score(F.try_element_at(p["bbox_scores"], F.col("_i")), F.try_element_at(p["keypoint_scores"], F.col("_i")), adder)
    return rows.select(*[c for c in poses.columns if c != pose], (F.col("_i") - 1).alias("person"), *side, score.alias("score"), F.lit(label).alias("label"))


def torso_fallback(b: boxes.Box, width: int, height: int) -> boxes.Box:
    """The middle of a box: a fifth less at each side, from a quarter down to nineteen twentieths; whole numbers, cut toward zero."""
    cut = lambda v: v.cast("int")
    l, t, r, o = (cut(v) for v in b)
    w, h = r - l, o - t
    inner = F.greatest(l + cut(0.2 * w), F.lit(0)), F.greatest(t + cut(0.25 * h), F.lit(0)), F.least(r - cut(0.2 * w), F.lit(width - 1)), F.least(t + cut(0.95 * h), F.lit(height - 1))
    empty = (inner[2] <= inner[0]) | (inner[3] <= inner[1])
    return tuple(F.when(empty, whole).otherwise(part) for whole, part in zip((l, t, r, o), inner, strict=True))


def _region(xs: list[Column], ys: list[Column], left, above, below, width: int, height: int, least: int = 1) -> Column:
    """Struct (l, t, r, b) of whole numbers around the points, inside the picture; null where it is smaller than `least`."""
    l, r = F.greatest(F.least(*xs) - left, F.lit(0.0)).cast("int"), F.least(F.greatest(*xs) + left, F.lit(width - 1.0)).cast("int")
    t, b = F.greatest(F.least(*ys) - above, F.lit(0.0)).cast("int"), F.least(F.greatest(*ys) + below, F.lit(height - 1.0)).cast("int")
    return F.when((r - l >= least) & (b - t >= least), F.struct(l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b")))


def _point(points: Column, scores: Column, i: int) -> tuple[Column, Column, Column]:
    p = F.try_element_at(points, F.lit(i + 1))
    return p[0], p[1], F.coalesce(F.try_element_at(scores, F.lit(i + 1)), F.when(scores.isNull(), F.lit(1.0)))


def torso_region(points: Column, scores: Column, width: int, height: int) -> Column:
    """The region of shoulders and hips, padded but below; null where one of them is not sure."""
    p = [_point(points, scores, i) for i in (RIGHT_SHOULDER, LEFT_SHOULDER, LEFT_HIP, RIGHT_HIP)]
    sure = (p[0][2] >= SURE) & (p[1][2] >= SURE) & (p[2][2] >= SURE) & (p[3][2] >= SURE)
    return F.when(sure, _region([q[0] for q in p], [q[1] for q in p], PADDING, PADDING, F.lit(0), width, height))


def side_view(points: Column, scores: Column, box_width: Column, ratio: float) -> Column:
    """`left` or `right` for a person seen from the side: the shoulders near each other in the box's width, or just one sure; else null."""
    (lx, ly, ls), (rx, ry, rs) = (_point(points, scores, i) for i in (LEFT_SHOULDER, RIGHT_SHOULDER))
    side = F.when(ls >= rs, "left").otherwise("right")
    both, one = (ls >= SURE) & (rs >= SURE), (ls >= SURE) != (rs >= SURE)
    return F.when((box_width > 1) & ((both & (boxes.distance(lx, ly, rx, ry) / box_width < ratio)) | one), side)


def arm_region(points: Column, scores: Column, width: int, height: int, side: str) -> Column:
    """The region of the upper arm of a side, with the wrist where that is sure; null without a sure shoulder and elbow or below 4 pixels."""
    a, b, c = (_point(points, scores, i) for i in ARMS[side])
    use = c[2] >= SURE
    xs, ys = [a[0], b[0], F.when(use, c[0])], [a[1], b[1], F.when(use, c[1])]
    pad = F.greatest(F.lit(float(PADDING)), 0.45 * boxes.distance(a[0], a[1], b[0], b[1])).cast("int")
    region = _region(xs, ys, pad, (0.25 * pad).cast("int"), (0.75 * pad).cast("int"), width, height, 4)
    return F.when((a[2] >= SURE) & (b[2] >= SURE), region)


def region_for_track(points: Column, scores: Column, b: boxes.Box, width: int, height: int, ratio: float) -> Column:
    """The arm of a person seen from the side, else the torso, else the middle of the box."""
    seen = side_view(points, scores, b[2] - b[0], ratio)
    arm = F.when(seen == "left", arm_region(points, scores, width, height, "left")).when(seen == "right", arm_region(points, scores, width, height, "right"))
    rest = torso_fallback(b, width, height)
    return F.coalesce(arm, torso_region(points, scores, width, height), F.struct(*[c.alias(n) for c, n in zip(rest, "ltrb", strict=True)]))


def box_of(points: Column) -> boxes.Box:
    """TLBR about all points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def matched(tracks: DataFrame, poses: DataFrame, least: float = 0.3) -> DataFrame:
    """tracks (frame, id, x, y, w, h and more) with the points and scores of the pose (frame, pose, points, scores) whose box overlaps theirs most, by `least` or more; else null."""
    from .frames import best_match

    l, t, r, b = box_of(F.col("points"))
    held = poses.select("frame", F.col("pose").alias("id"), l.alias("x"), t.alias("y"), (r - l).alias("w"), (b - t).alias("h"))
    best = best_match(tracks, held, least, at_least=True).select("frame", "id", F.col("id_").alias("pose"))
    return tracks.join(best, ["frame", "id"], "left").join(poses.select("frame", "pose", "points", "scores"), ["frame", "pose"], "left").drop("pose")


def action_windows(tracks: DataFrame, point: int = 0, keys: tuple[str, ...] = ("clip", "id")) -> DataFrame:
    """keys, window: a clip's matched poses of each track in the order of frames, one point (x, y) of each; tracks without any pose are left out."""
    entry = F.when(F.col("points").isNotNull(), F.struct("frame", F.col("points")[point].alias("p")))
    return tracks.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["p"]).alias("window")).filter(F.size("window") > 0)


def chosen_action(scores: Column, labels: list[str] | None = None, k: int = 1, floor: float = 0.0) -> Column:
    """Struct (label, label_index, score, topk_indices, topk_scores) of an array of class scores, the first of equals; null if the best is below the floor. Classes without a label are called by their number."""
    ranked = F.slice(F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))), 1, max(1, k))
    first = F.try_element_at(ranked, F.lit(1))
    name = first["i"].cast("string")
    if labels:
        name = F.coalesce(F.try_element_at(F.array(*map(F.lit, labels)), first["i"] + 1), name)
    out = F.struct(name.alias("label"), first["i"].cast("bigint").alias("label_index"), (-first["s"]).alias("score"), F.transform(ranked, lambda r: r["i"].cast("bigint")).alias("topk_indices"), F.transform(ranked, lambda r: -r["s"]).alias("topk_scores"))
    return F.when(-first["s"] >= floor, out)


def detection_scales(frames: DataFrame, scale: str = "scale", batch: tuple[str, ...] = ("batch",)) -> DataFrame:
    """frames with `factors` (x, y, x, y) of a scale of one, two or four numbers; null in a batch in which any frame lacks one that is finite and above 0."""
    s = F.col(scale)
    four = F.when(F.size(s) == 1, F.array_repeat(s[0], 4)).when(F.size(s) == 2, F.concat(s, s)).when(F.size(s) == 4, s)
    good = F.coalesce(F.forall(four, lambda v: (v > 0) & (v < float("inf"))), F.lit(False))
    return frames.withColumn("_f", four).withColumn("factors", F.when(F.min(good).over(W.partitionBy(*batch)), F.col("_f"))).drop("_f")


def scaled_box(b: boxes.Box, factors: Column) -> boxes.Box:
    """A box in the picture that the detector saw; unchanged without factors."""
    return tuple(F.coalesce(v * factors[i], v) for i, v in enumerate(b))


def restored_points(points: Column, factors: Column) -> Column:
    """Points found in the detector's picture, back in the frame's."""
    return F.when(factors.isNull(), points).otherwise(F.transform(points, lambda p: F.array(p[0] / factors[0], p[1] / factors[1])))


def fan_out_actions(actions: DataFrame, tracks: DataFrame, keys: tuple[str, ...] = ("clip", "id")) -> DataFrame:
    """The action found for a clip's track on each of the clip's frames that hold the track."""
    return tracks.join(actions, list(keys))
