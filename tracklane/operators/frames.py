"""Filters, joins, aggregates and features of boxes grouped by frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import boxes, numbers
from . import ranks


def top_k(rows: DataFrame, k: int, by: list[Column], keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).filter(F.col("_r") <= k).drop("_r")


def drop_largest(rows: DataFrame, min_boxes: int) -> DataFrame:
    """Without each frame's largest box, where the frame holds at least `min_boxes`."""
    w = W.partitionBy("frame")
    ranked = rows.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(F.col("w") * F.col("h")), "id")), "_n": F.count("*").over(w)})
    return ranked.filter((F.col("_r") > 1) | (F.col("_n") < min_boxes)).drop("_r", "_n")


def min_height(rows: DataFrame, least: float) -> DataFrame:
    """Boxes at least so high; a frame without any keeps all."""
    return rows.withColumn("_m", F.max("h").over(W.partitionBy("frame"))).filter((F.col("h") >= least) | (F.col("_m") < least)).drop("_m")


def below_borders(rows: DataFrame, upper, lower) -> DataFrame:
    """Boxes whose centre lies neither above an upper nor below a lower border segment (x1, y1, x2, y2) over its own x range."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    line = lambda s: s[1] + (s[3] - s[1]) * (cx - s[0]) / (s[2] - s[0])
    keep = F.lit(True)
    for s in upper:
        keep &= ~(cx.between(s[0], s[2]) & (cy < line(s)))
    for s in lower:
        keep &= ~(cx.between(s[0], s[2]) & (cy > line(s)))
    return rows.filter(keep)


def in_mask(rows: DataFrame, mask: DataFrame, threshold: float | None = None) -> DataFrame:
    """Boxes whose centre, or foot where the centre is not beyond the threshold, lies in runs (y, x0, x1) of a mask."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    py = cy if threshold is None else F.when(cy > threshold, cy).otherwise(F.col("y") + F.col("h"))
    spot = rows.withColumns({"_x": F.floor(cx), "_y": F.floor(py)})
    runs = mask.select(F.col("y").alias("_my"), "x0", "x1")
    return spot.join(runs, (F.col("_y") == F.col("_my")) & F.col("_x").between(F.col("x0"), F.col("x1")), "left_semi").drop("_x", "_y")


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one frame beside each other; the columns of b carry an underscore."""
    right = b.select("frame", *[F.col(c).alias(f"{c}_") for c in ("id", "x", "y", "w", "h")])
    return a.join(right, "frame")


_A, _B = ("x", "y", "w", "h"), ("x_", "y_", "w_", "h_")


def non_overlapping(rows: DataFrame) -> DataFrame:
    """Boxes that intersect no other of their frame; touching edges may."""
    hit = _pairs(rows, rows).filter("id <> id_").filter(boxes.intersection(boxes.tlwh_to_tlbr(boxes.cols(*_A)), boxes.tlwh_to_tlbr(boxes.cols(*_B))) > 0)
    return rows.join(hit.select("frame", "id").distinct(), ["frame", "id"], "left_anti")


def best_match(a: DataFrame, b: DataFrame, threshold: float, at_least: bool = False) -> DataFrame:
    """frame, id, id_, iou: for each box of a the box of b with the largest IoU over the threshold (or `at_least` that), the first of equals."""
    iou = boxes.iou(boxes.tlwh_to_tlbr(boxes.cols(*_A)), boxes.tlwh_to_tlbr(boxes.cols(*_B)))
    found = _pairs(a, b).withColumn("iou", iou).filter(F.col("iou") >= threshold if at_least else F.col("iou") > threshold)
    return top_k(found, 1, [F.desc("iou"), F.col("id_")], ("frame", "id")).select("frame", "id", "id_", "iou")


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """frames, mean_iou, mean_distance of two runs' boxes (one a frame) where both have one."""
    right = b.select("frame", *[F.col(c).alias(f"{c}_") for c in _A])
    p, q = boxes.tlwh_to_tlbr(boxes.cols(*_A)), boxes.tlwh_to_tlbr(boxes.cols(*_B))
    away = boxes.distance(*boxes.center(p), *boxes.center(q))
    return a.join(right, "frame").agg(F.count("*").alias("frames"), F.avg(boxes.iou(p, q)).alias("mean_iou"), F.avg(away).alias("mean_distance"))


def last_of(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    return top_k(rows, 1, [F.desc(order)], keys)


def attach(frames: DataFrame, side: DataFrame, keys: tuple[str, ...], defaults: dict) -> DataFrame:
    """Left join with the defaults where nothing is found."""
    return frames.join(side, list(keys), "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def common_frames(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("frame").distinct()
    for t in tables[1:]:
        out = out.join(t.select("frame"), "frame", "left_semi")
    return out


def frame_features(rows: DataFrame, scale_x: float, scale_y: float, max_players: int) -> DataFrame:
    """n, mean and deviation of centres, their x range and the group's width, clipped to 0..1."""
    clip = lambda c: boxes.clamp(c, F.lit(0.0), F.lit(1.0))
    cx, cy = clip((F.col("x") + F.col("w") / 2) / scale_x), clip((F.col("y") + F.col("h") / 2) / scale_y)
    return (
        rows.select("frame", cx.alias("cx"), cy.alias("cy")).groupBy("frame")
        .agg(F.least(F.count("*") / max_players, F.lit(1.0)).alias("n"), F.avg("cx").alias("mean_cx"), F.avg("cy").alias("mean_cy"), F.stddev_pop("cx").alias("std_cx"), F.stddev_pop("cy").alias("std_cy"), F.min("cx").alias("min_cx"), F.max("cx").alias("max_cx"))
        .withColumn("width", F.col("max_cx") - F.col("min_cx"))
    )


def max_extents(rows: DataFrame, default_w: float = 1920.0, default_h: float = 1080.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, max_x, max_y: how far boxes reach right and down; a default where none reaches a positive, finite place."""
    fine = lambda c, d: F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c).otherwise(F.lit(d))
    got = rows.groupBy(*keys).agg(F.max(F.nanvl(F.col("x") + F.col("w"), F.lit(None))).alias("a"), F.max(F.nanvl(F.col("y") + F.col("h"), F.lit(None))).alias("b"))
    return got.select(*keys, fine(F.col("a"), default_w).alias("max_x"), fine(F.col("b"), default_h).alias("max_y"))


def extents_over(games: DataFrame) -> DataFrame:
    """max_x, max_y over games' own extents (max_x, max_y): what all of them are normalised by."""
    return games.agg(*[F.coalesce(F.greatest(F.max(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in ("max_x", "max_y")])


def beyond_scale(games: DataFrame, scale_x: float, scale_y: float) -> DataFrame:
    """Games that reach beyond a scale learnt from others, by more than a millionth: theirs would be clipped."""
    over = lambda c, s: F.col(c) > s + max(1.0, s) * 1e-6
    return games.filter(over("max_x", scale_x) | over("max_y", scale_y))


def enclosing(rows: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    good = rows.filter((F.col("w") > 0) & (F.col("h") > 0))
    return good.groupBy(*keys).agg(F.min("x").alias("l"), F.min("y").alias("t"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))


def group_velocity(rows: DataFrame, threshold: float, ratio: float, min_tracks: int, strict: bool) -> DataFrame:
    """frame, direction, edge_x where more than the ratio of a frame's tracks move one way; rows hold frame, id, cx, vx.

    Strict compares with > and wants more than `min_tracks`; else >= and at least so many.
    """
    right, left = (F.col("vx") > threshold, F.col("vx") < -threshold) if strict else (F.col("vx") >= threshold, F.col("vx") <= -threshold)
    g = rows.groupBy("frame").agg(F.count("*").alias("n"), F.count_if(right).alias("r"), F.count_if(left).alias("l"), F.max(F.when(right, F.col("cx"))).alias("edge_r"), F.min(F.when(left, F.col("cx"))).alias("edge_l"))
    g = g.filter(F.col("n") > min_tracks if strict else F.col("n") >= min_tracks)
    return g.select("frame", F.when(F.col("r") / F.col("n") > ratio, 1).when(F.col("l") / F.col("n") > ratio, -1).alias("direction"), "edge_r", "edge_l").filter("direction is not null").select("frame", "direction", F.when(F.col("direction") == 1, F.col("edge_r")).otherwise(F.col("edge_l")).alias("edge_x"))


def _curve(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, _bin, ord, hit, seen, total, tp of rows, counted inside ranges of the confidence and behind the ranges before."""
    binned = ranks.score_bins(rows, "conf", keys)
    totals = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    before = ranks.bins_before(totals, keys, "n", "h").withColumn("total", F.sum("h").over(W.partitionBy(*keys))).drop("n", "h")
    w = W.partitionBy(*keys, "_bin").orderBy(F.desc("conf"), "ord").rowsBetween(W.unboundedPreceding, 0)
    inside = binned.withColumns({"_n": F.count("*").over(w), "_h": F.sum("hit").over(w)}).join(before, [*keys, "_bin"])
    return inside.select(*keys, "_bin", "ord", "hit", "total", (F.col("_n") + F.col("_before_n")).alias("seen"), (F.col("_h") + F.col("_before_h")).alias("tp"))


def precision_recall(rows: DataFrame, keys: tuple[str, ...] = ("cls",)) -> DataFrame:
    """Cumulative recall and precision down the confidence; rows hold keys, ord, conf, hit (0 or 1)."""
    return _curve(rows, keys).select(*keys, "ord", "seen", F.try_divide("tp", "total").alias("recall"), (F.col("tp") / F.col("seen")).alias("precision"))


def average_precision(rows: DataFrame, keys: tuple[str, ...] = ("cls",)) -> DataFrame:
    """Area under the precision envelope: at each hit, whose share of all is the step of recall, the best precision from there on."""
    curve = _curve(rows, keys).withColumn("precision", F.col("tp") / F.col("seen"))
    later = W.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, -1)
    behind = curve.groupBy(*keys, "_bin").agg(F.max("precision").alias("_m")).select(*keys, "_bin", F.max("_m").over(later).alias("_behind"))
    best = F.greatest(F.max("precision").over(W.partitionBy(*keys, "_bin").orderBy(F.desc("seen")).rowsBetween(W.unboundedPreceding, 0)), "_behind")
    steps = curve.join(behind, [*keys, "_bin"]).withColumns({"_p": best, "_d": F.try_divide("hit", "total")})
    return steps.groupBy(*keys).agg(F.sum(F.col("_p") * F.col("_d")).alias("ap"))


def pivot_sides(rows: DataFrame, key: str, side: str, value: str) -> DataFrame:
    """One row for each key with its home and away value and their difference where both are whole numbers."""
    wide = rows.groupBy(key).pivot(side, ["home", "away"]).agg(F.max(value))
    return wide.withColumn("delta", F.col("home").try_cast("int") - F.col("away").try_cast("int"))


def fingerprint(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """keys, hash: SHA-256 of the rows' values, in the order of the values."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return rows.groupBy(*keys).agg(F.sha2(F.concat_ws(";", F.array_sort(F.collect_list(line))).cast("binary"), 256).alias("hash"))


def weighted_means(batches: DataFrame, keys: tuple[str, ...], n: str, metrics: tuple[str, ...]) -> DataFrame:
    """keys, n and each metric's mean over batches, weighted by their rows."""
    return batches.groupBy(*keys).agg(F.sum(n).alias(n), *[F.try_divide(F.sum(F.col(m) * F.col(n)), F.sum(n)).alias(m) for m in metrics])


def rushes(moving: DataFrame, threshold: float, ratio: float, min_tracks: int, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """keys, v, ex, ey where more than the ratio of a frame's tracks (at least `min_tracks`) rush one way: their mean speed and the centre of the foremost, the least id of equals.

    `moving` holds keys, id, cx, cy, vx.
    """
    right, left = F.col("vx") >= threshold, F.col("vx") <= -threshold
    front = lambda way, key: F.max(F.when(way, F.struct(key.alias("k"), (-F.col("id")).alias("i"), "cx", "cy")))
    g = moving.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(right).alias("r"), F.count_if(left).alias("f"), numbers.steady_mean(F.when(right, F.col("vx"))).alias("vr"), numbers.steady_mean(F.when(left, F.col("vx"))).alias("vl"), front(right, F.col("cx")).alias("er"), front(left, -F.col("cx")).alias("el"))
    to_right, to_left = (F.col(c) / F.col("n") > ratio for c in "rf")
    g = g.filter((F.col("n") >= min_tracks) & (to_right | to_left))
    return g.select(*keys, F.when(to_right, F.col("vr")).otherwise(F.col("vl")).alias("v"), F.when(to_right, F.col("er")).otherwise(F.col("el")).alias("_e")).select(*keys, "v", F.col("_e.cx").alias("ex"), F.col("_e.cy").alias("ey"))


def breakaway(moving: DataFrame, targets: DataFrame, threshold: float, ratio: float, min_tracks: int, speed_ratio: float = 0.3, average: bool = True, view: DataFrame | None = None) -> DataFrame:
    """frame, target box (l, t, r, b), speeds, push where more than the ratio of a frame's tracks rush one way.

    The target (frame, l, t, r, b) is moved to the foremost of them, or half way. Where that lies ahead of the centre of the
    camera's box (`view`: frame, cx; else the target's own), `speeds` is true and `push` a share of the group's mean speed; else the box has overshot and should
    brake. `moving` holds frame, id, cx, cy, vx. `movers.PlayTick` does the same with the box that it moves.
    """
    rows = targets.join(rushes(moving, threshold, ratio, min_tracks), "frame")
    b = boxes.cols(*"ltrb")
    (cx, cy), (w, h) = boxes.center(b), boxes.size(b)
    at = ((F.col("ex") + cx) / 2, (F.col("ey") + cy) / 2) if average else (F.col("ex"), F.col("ey"))
    rows = rows.join(view.select("frame", F.col("cx").alias("_from")), "frame") if view is not None else rows.withColumn("_from", cx)
    ahead = ((F.col("v") > 0) & (F.col("_from") < F.col("ex"))) | ((F.col("v") < 0) & (F.col("_from") > F.col("ex")))
    return rows.select("frame", *[v.alias(n) for v, n in zip(boxes.box_at(*at, w, h), "ltrb", strict=True)], ahead.alias("speeds"), F.when(ahead, F.col("v") * speed_ratio).otherwise(F.lit(0.0)).alias("push"))


def between(rows: DataFrame, first: int | None = None, last: int | None = None, stride: int = 1, at: str = "frame", start: str | None = None) -> DataFrame:
    """Rows from the first to the last place, both included (None: no bound), every `stride`-th of them; places are counted from 1 behind the column `start`, if given, else as they stand."""
    place = F.col(at) - F.col(start) if start else F.col(at)
    keep = F.lit(True)
    if first is not None:
        keep = keep & (place >= first)
    if last is not None:
        keep = keep & (place <= last)
    return rows.filter(keep & ((place - (first or 0)) % stride == 0))


def selected(rows: DataFrame, value: str, over: float | None = None, under: float | None = None, keys: tuple[str, ...] = ("frame",), order: str = "id") -> DataFrame:
    """rows, with their index (from 0 by the order) among their keys' rows, whose value is over and under the bounds: what threshold selectors give."""
    indexed = rows.withColumn("index", F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1)
    if over is not None:
        indexed = indexed.filter(F.col(value) > over)
    return indexed if under is None else indexed.filter(F.col(value) < under)


def extreme(rows: DataFrame, value: str, least: bool = True, keys: tuple[str, ...] = ("frame",), order: str = "id") -> DataFrame:
    """keys, index, id, value: a frame's least (or greatest) value, the first of equals by the order, and where it stands."""
    indexed = rows.withColumn("index", F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1)
    best = (F.min_by if least else F.max_by)(F.struct("index", "id", value), F.struct(F.col(value), F.col("index") if least else -F.col("index")))
    return indexed.groupBy(*keys).agg(best.alias("_m")).select(*keys, "_m.index", "_m.id", F.col(f"_m.{value}").alias(value))
