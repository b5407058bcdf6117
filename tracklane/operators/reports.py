"""Reports, lists and comparisons: player reports, highlights, run checks, label accuracy, target building, suppression, sets."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import boxes, text
from . import ranks
from .frames import top_k, weighted_means


def combined_stats(tables: dict[str, DataFrame], first: str, key: str = "player") -> DataFrame:
    """Rows of all sides with the columns of the first table and side; missing ones are empty texts; by player and side."""
    names = tables[first].columns
    out = None
    for side, rows in tables.items():
        one = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in names], F.lit(side).alias("side"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(key, "side")


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(sep="\t", header=True).csv(path)


def highlights(shifts: DataFrame, lead: float = 3.0) -> DataFrame:
    """game, number, shift, line of a player's text: from `lead` seconds before a shift, not before 0, to its end, blank if it has none."""
    stop = F.col("start") + F.col("duration")
    line = F.concat(text.format_hms(F.greatest(F.col("start") - lead, F.lit(0.0))), F.lit("    "), F.when(stop < float("inf"), text.format_hms(stop)).otherwise(F.lit("")))
    return shifts.select("game", "number", "shift", line.alias("line"))


def write_highlights(shifts: DataFrame, path: str) -> None:
    """One folder of text for each number."""
    highlights(shifts).repartition("number").sortWithinPartitions("number", "game", "shift").select("number", "line").write.mode("overwrite").partitionBy("number").text(path)


def ids_of_intervals(assigned: DataFrame, keys: tuple[str, ...] = ("game", "interval")) -> DataFrame:
    """The distinct track ids over each interval's frames."""
    return assigned.groupBy(*keys).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def first_of_lines(lines: DataFrame, order: str = "ord", column: str = "line") -> DataFrame:
    """The first of equal lines; blank ones and comments with # are left out."""
    t = F.trim(column)
    return lines.withColumn(column, t).filter((t != "") & ~t.startswith("#")).groupBy(column).agg(F.min(order).alias(order))


def label_accuracy(rows: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """keys, n, accuracy, ned, confidence, length (all but the last in hundredths) of rows (keys, predicted, truth, confidence), then a row `Combined` weighted by n."""
    per = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), (100 * F.avg((F.col("predicted") == F.col("truth")).cast("double"))).alias("accuracy"), (100 * F.avg(text.edit_similarity(F.col("predicted"), F.col("truth")))).alias("ned"),
        (100 * F.avg("confidence")).alias("confidence"), F.avg(F.length("predicted")).alias("length"),
    )
    whole = weighted_means(per.withColumn("_all", F.lit("Combined")), ("_all",), "n", ("accuracy", "ned", "confidence", "length"))
    return per.unionByName(whole.withColumnRenamed("_all", keys[0]))


def changed_keys(target: DataFrame, source: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Keys of the target whose value differs in the source, or that it lacks."""
    return target.join(source.select(key, F.col(value).alias("_v"), F.lit(True).alias("_has")), key, "left").filter(F.col("_has").isNull() | ~F.col(value).eqNullSafe(F.col("_v"))).select(key)


def hash_graph(nodes: dict[str, tuple[str, list[str]]]) -> dict[str, str]:
    """A hash for each node of (content, inputs), which covers all it depends on; inputs that are no nodes count by name."""
    import hashlib

    done: dict[str, str] = {}
    for start in nodes:
        stack = [start]
        while stack:
            n = stack[-1]
            waiting = [i for i in nodes[n][1] if i in nodes and i not in done]
            if waiting and len(stack) <= len(nodes):
                stack.extend(waiting)
                continue
            if waiting:
                raise ValueError("the graph has a cycle")
            done[n] = hashlib.sha256("\0".join([nodes[n][0], *(done.get(i, i) for i in nodes[n][1])]).encode()).hexdigest()
            stack.pop()
    return done


def kept_and_renumbered(stores: dict[str, DataFrame], least: int) -> DataFrame:
    """number (from 1), store, key, width, height: rows of all stores, in their order, of at least `least` pixels each way."""
    out = None
    for k, (name, rows) in enumerate(stores.items()):
        one = rows.filter((F.col("width") >= least) & (F.col("height") >= least)).select(F.lit(k).alias("_k"), F.lit(name).alias("store"), "key", "width", "height")
        out = one if out is None else out.unionByName(one)
    return ranks.numbered(out, "number", "_k", "key").select("number", "store", "key", "width", "height")


def split_points(n: Column, parts: int) -> Column:
    """The inner cuts of n rows into equal parts."""
    return F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: i * F.floor(n / parts))


def with_variants(run, variants: dict[str, dict]) -> DataFrame:
    """The rows of run(settings) for each named settings, in one table with the column variant."""
    out = None
    for name, settings in variants.items():
        one = run(settings).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def sequence_frames(files: DataFrame, width: int, height: int, column: str = "name") -> DataFrame:
    """sequence, action, frames: file names `<action>_<number>_<frame>.<ext>` grouped, in the order of frames, with points cut to the picture."""
    at = lambda i: F.regexp_extract(column, r"^([A-Za-z]+)_(\d+)_(\d+)\.[A-Za-z]+$", i)
    cut = F.transform("points", lambda p: F.array(boxes.clamp(p[0], F.lit(0.0), F.lit(width - 1.0)), boxes.clamp(p[1], F.lit(0.0), F.lit(height - 1.0))))
    rows = files.select(at(1).alias("action"), F.concat_ws("_", at(1), at(2)).alias("sequence"), at(3).try_cast("int").alias("frame"), cut.alias("points")).filter("action <> ''")
    return rows.groupBy("sequence", "action").agg(F.array_sort(F.collect_list(F.struct("frame", "points"))).alias("frames"))


def camera_losses(pred: DataFrame, truth: DataFrame, weights: tuple[float, float, float, float], keys: tuple[str, ...] = ("game",), aspect: float | None = None) -> DataFrame:
    """l1, iou, velocity, acceleration and their weighted loss of predicted TLWH (0 to 1) against true ones, over all games' frames.

    With an aspect the predicted box keeps its centre and height only. Differences are those between a game's neighbouring rows.
    """
    p = pred.select(*keys, "frame", *[F.col(c).alias(f"p{c}") for c in "xywh"])
    if aspect is not None:
        p = p.select(*keys, "frame", *[v.alias(f"p{c}") for v, c in zip(boxes.slow_aspect(*(F.col(f"p{c}") for c in "xywh"), aspect), "xywh", strict=True)])
    rows = p.join(truth.select(*keys, "frame", *"xywh"), [*keys, "frame"])
    w = W.partitionBy(*keys).orderBy("frame")
    away = {c: F.col(f"p{c}") - F.col(c) for c in "xywh"}
    rows = rows.withColumns({f"_{c}": v for c, v in away.items()})
    one = {c: F.abs(F.col(f"_{c}") - F.lag(f"_{c}").over(w)) for c in "xywh"}
    two = {c: F.abs(F.col(f"_{c}") - 2 * F.lag(f"_{c}").over(w) + F.lag(f"_{c}", 2).over(w)) for c in "xywh"}
    mean = lambda d: sum(d.values()) / 4
    a, b = boxes.tlwh_to_tlbr(boxes.cols("px", "py", "pw", "ph")), boxes.tlwh_to_tlbr(boxes.cols(*"xywh"))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - boxes.intersection(a, b)
    rows = rows.select(mean({c: F.abs(f"_{c}") for c in "xywh"}).alias("l1"), (boxes.intersection(a, b) / F.greatest(union, F.lit(1e-6))).alias("iou"), mean(one).alias("velocity"), mean(two).alias("acceleration"))
    got = rows.agg(F.avg("l1").alias("l1"), F.avg("iou").alias("iou"), F.coalesce(F.avg("velocity"), F.lit(0.0)).alias("velocity"), F.coalesce(F.avg("acceleration"), F.lit(0.0)).alias("acceleration"))
    return got.withColumn("loss", weights[0] * F.col("l1") + weights[1] * (1 - F.col("iou")) + weights[2] * F.col("velocity") + weights[3] * F.col("acceleration"))


def rule_camera(rows: DataFrame, width: float, height: float, aspect: float, keys: tuple[str, ...] = ("frame",), bounds: tuple[float, float, float, float] | None = None, every: DataFrame | None = None) -> DataFrame:
    """keys, l, t, r, b: the union of a frame's boxes (TLWH), its height times 1.4 between 35 and 95 hundredths of the picture's, the width from the aspect, cut to the picture.

    The box is then scaled down and moved into the play `bounds` (TLBR), if given. Frames of `every` (keys) without boxes have the whole picture as their union.
    """
    g = rows.groupBy(*keys).agg(F.min("x").alias("_l"), F.min("y").alias("_t"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"))
    if every is not None:
        g = every.join(g, list(keys), "left").fillna({"_l": 0.0, "_t": 0.0, "_r": width, "_b": height})
    h = boxes.clamp((F.col("_b") - F.col("_t")) * 1.4, F.lit(height * 0.35), F.lit(height * 0.95))
    box = boxes.box_at((F.col("_l") + F.col("_r")) / 2, (F.col("_t") + F.col("_b")) / 2, h * aspect, h)
    box = boxes.clamp_box(box, tuple(F.lit(v) for v in (0.0, 0.0, width, height)))
    if bounds:
        g = g.select(*keys, *[v.alias(n) for v, n in zip(box, "ltrb", strict=True)])
        box = boxes.scaled_into(boxes.cols(*"ltrb"), tuple(F.lit(float(v)) for v in bounds))
    return g.select(*keys, *[v.alias(n) for v, n in zip(box, "ltrb", strict=True)])


def anchor_targets(targets: DataFrame, anchors: DataFrame, grid_w: int, grid_h: int, least: float = 0.6, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """keys, anchor, gj, gi, id, cls, tx, ty, tw, th: each target (cx, cy, w, h in 0..1) at its grid cell and best anchor (w, h in cells).

    Of targets of one cell and anchor the best fitting stays, the smallest id of equals; an overlap of `least` or less is no target.
    """
    cell = targets.withColumns({"_x": F.col("cx") * grid_w, "_y": F.col("cy") * grid_h, "_w": F.col("w") * grid_w, "_h": F.col("h") * grid_h})
    cell = cell.withColumns({"gi": F.floor(boxes.clamp(F.col("_x"), F.lit(0.0), F.lit(grid_w - 1.0))), "gj": F.floor(boxes.clamp(F.col("_y"), F.lit(0.0), F.lit(grid_h - 1.0)))})
    a = anchors.select("anchor", F.col("w").alias("aw"), F.col("h").alias("ah"))
    inter = F.least("_w", "aw") * F.least("_h", "ah")
    pairs = cell.crossJoin(F.broadcast(a)).withColumn("iou", inter / (F.col("_w") * F.col("_h") + F.col("aw") * F.col("ah") - inter + 1e-16))  # a dozen anchors
    best = top_k(pairs, 1, [F.desc("iou"), F.col("anchor")], (*keys, "id")).filter(F.col("iou") > least)
    one = top_k(best, 1, [F.desc("iou"), F.col("id")], (*keys, "gi", "gj", "anchor"))
    return one.select(*keys, "anchor", "gj", "gi", "id", "cls", (F.col("_x") - F.floor("_x")).alias("tx"), (F.col("_y") - F.floor("_y")).alias("ty"), F.log(F.col("_w") / F.col("aw")).alias("tw"), F.log(F.col("_h") / F.col("ah")).alias("th"))


def rescaled_detections(rows: DataFrame, matrix: Column) -> DataFrame:
    """Boxes (l, t, r, b) through an affine map (a, b, c, d, e, f), the class counted from 1."""
    at = lambda x, y: (matrix[0] * x + matrix[1] * y + matrix[2], matrix[3] * x + matrix[4] * y + matrix[5])
    (l, t), (r, b) = at(F.col("l"), F.col("t")), at(F.col("r"), F.col("b"))
    return rows.withColumns({"_l": l, "_t": t, "_r": r, "_b": b, "cls": F.col("cls") + 1}).drop(*"ltrb").withColumnsRenamed({f"_{c}": c for c in "ltrb"})


def suppressed(rows: DataFrame, threshold: float, most: int | None = None, keys: tuple[str, ...] = ("frame", "label")) -> DataFrame:
    """Rows that stay of overlapping boxes of one frame and class: down the scores (then ids), each drops those it covers by more than the threshold.

    Rows are sorted by Spark; a task goes through whole batches of frames at once, in as many rounds as one of them keeps boxes.
    """
    score = F.when(~F.isnan("score"), F.col("score"))
    sorted_ = rows.repartition(*keys).sortWithinPartitions(*keys, score.desc_nulls_last(), F.col("id").asc_nulls_last())

    def starts(t: pa.Table) -> np.ndarray:
        """Whether a row is the first of its keys."""
        first = np.arange(t.num_rows) == 0
        for k in keys:
            code = t[k].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            first[1:] |= code[1:] != code[:-1]
        return first

    def kept(t: pa.Table, first: np.ndarray) -> pa.Table:
        x, y, w, h = (t[c].cast(pa.float64()).to_numpy() for c in "xywh")
        group, rest, rounds, out = np.cumsum(first), np.arange(t.num_rows), 0, [np.zeros(0, np.int64)]
        while rest.size and (most is None or rounds < most):
            lead = np.r_[True, group[rest[1:]] != group[rest[:-1]]]
            i = rest[lead][np.cumsum(lead) - 1]  # the best box left of each row's group
            with np.errstate(invalid="ignore", over="ignore"):
                wide, high = np.minimum(x[i] + w[i], x[rest] + w[rest]) - np.maximum(x[i], x[rest]), np.minimum(y[i] + h[i], y[rest] + h[rest]) - np.maximum(y[i], y[rest])
                inter = np.clip(wide, 0, None) * np.clip(high, 0, None)
                union = w[i] * h[i] + w[rest] * h[rest] - inter
                over = np.where(union > 0, inter / np.where(union > 0, union, 1), 0) > threshold
            out.append(rest[lead])
            rest, rounds = rest[~(lead | over)], rounds + 1
        return t.take(np.sort(np.concatenate(out)))

    def run(batches):
        held = []  # rows whose keys may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([*held, b])
            first = starts(t)
            cut = int(np.flatnonzero(first)[-1]) if len(first) else 0
            yield from kept(t[:cut], first[:cut]).to_batches()
            held = t[cut:].to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield from kept(t, starts(t)).to_batches()

    return sorted_.mapInArrow(run, rows.schema)


def track_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tracks of a, and those of b that a lacks."""
    return a.unionByName(b.join(a.select("frame", "id"), ["frame", "id"], "left_anti"))


def track_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("frame", "id"), ["frame", "id"], "left_anti")


def without_duplicates(a: DataFrame, b: DataFrame, most: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Both lists (frame, id, x, y, w, h, age) without tracks that the other holds too (distance below `most`): the older stays, of equals that of b."""
    right = b.select("frame", *[F.col(c).alias(f"{c}_") for c in ("id", "x", "y", "w", "h", "age")])
    iou = boxes.iou(boxes.tlwh_to_tlbr(boxes.cols(*"xywh")), boxes.tlwh_to_tlbr(boxes.cols("x_", "y_", "w_", "h_")))
    pairs = a.join(right, "frame").filter(1 - iou < most)
    gone_b = pairs.filter(F.col("age") > F.col("age_")).select("frame", F.col("id_").alias("id")).distinct()
    gone_a = pairs.filter(F.col("age") <= F.col("age_")).select("frame", "id").distinct()
    return a.join(gone_a, ["frame", "id"], "left_anti"), b.join(gone_b, ["frame", "id"], "left_anti")


def frame_values(rows: DataFrame, value: str, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """A check value of each frame: the mean of a fractional column, the sum of a whole one."""
    whole = rows.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")
    return rows.groupBy(*keys).agg((F.sum(value).cast("double") if whole else F.avg(value)).alias("check"))


def differing(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("frame",), absolute: float = 1e-6, relative: float = 1e-5) -> DataFrame:
    """keys, check, expected where they are apart by more than the tolerances, or one is missing."""
    both = a.join(b.select(*keys, F.col("check").alias("expected")), list(keys), "full")
    close = F.abs(F.col("check") - F.col("expected")) <= absolute + relative * F.abs("expected")
    return both.filter(~F.coalesce(close, F.lit(False)))


def color_stats(pixels: DataFrame, keys: tuple[str, ...] = ("frame", "channel"), value: str = "value") -> DataFrame:
    """keys, low, high, mean of a picture's channels, for checks against those of a run before."""
    return pixels.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))


def changed_stats(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("frame", "channel"), absolute: float = 1e-3, relative: float = 1e-5) -> DataFrame:
    """keys and whether low, high or mean have changed beyond the tolerances."""
    both = a.join(b.select(*keys, *[F.col(c).alias(f"{c}_") for c in ("low", "high", "mean")]), list(keys))
    off = lambda c: F.abs(F.col(c) - F.col(f"{c}_")) > absolute + relative * F.abs(f"{c}_")
    return both.select(*keys, (off("low") | off("high") | off("mean")).alias("changed"))


def time_shares(timings: DataFrame, key: str = "name", least: float = 1.0) -> DataFrame:
    """key, share: each step's hundredths of all time, from `least` on."""
    per = timings.groupBy(key).agg(F.sum("seconds").alias("_s"))
    total = timings.agg(F.sum("seconds").alias("_t"))
    return per.crossJoin(F.broadcast(total)).filter("_t > 0").select(key, (100 * F.col("_s") / F.col("_t")).alias("share")).filter(F.col("share") >= least)  # one row


def text_in_boxes(points: DataFrame, tiles: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """keys, text, id: found texts at (px, py) with the tile (id, l, t, r, b) that holds the point; right and bottom edges are outside."""
    inside = (F.col("px") >= F.col("l")) & (F.col("px") < F.col("r")) & (F.col("py") >= F.col("t")) & (F.col("py") < F.col("b"))
    return points.join(tiles, list(keys)).filter(inside).select(*keys, "text", "id")


def matched_points(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("match",)) -> DataFrame:
    """keys, lx, ly, rx, ry: points of two pictures with one match id."""
    return left.select(*keys, F.col("x").alias("lx"), F.col("y").alias("ly")).join(right.select(*keys, F.col("x").alias("rx"), F.col("y").alias("ry")), list(keys))


def least_x(points: DataFrame, n: int, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    return top_k(points, n, [F.col("x"), F.col("id")], keys)


def ascii_label(labels: pd.Series) -> pd.Series:
    """Unicode letters decomposed, what is not ASCII dropped; for labels beyond the fixed list of text.normal_label."""
    return labels.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def cluster_snapshot(labels: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """keys, label, n, cx, cy, largest: each cluster's size and mean point, and whether it is the first of the greatest; rows hold keys, id, label, px, py."""
    g = labels.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.avg("px").alias("cx"), F.avg("py").alias("cy"))
    return g.withColumn("largest", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "label")) == 1)


def scaled_frames(n: Column, scale: float) -> Column:
    """A count of frames tuned for one rate, at another: rounded, at least 1; 0 and less stay."""
    return n if scale <= 0 else F.when(n <= 0, n).otherwise(F.greatest(F.bround(n * scale), F.lit(1))).cast("long")


def scaled_speed(v: Column, scale: float) -> Column:
    """Pixels a frame tuned for one rate, at another."""
    return v if scale <= 0 else F.when(F.abs(v) <= 1e-12, v).otherwise(v / scale)
