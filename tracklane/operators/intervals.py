"""Velocities, islands, intervals and ordered windows over frame-keyed rows.

`game` columns, where given, lead every window, so games spread over tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import boxes


def track_velocity(tracks: DataFrame, image_width: float, faithful: bool = True, max_gap: int = 2, game: tuple[str, ...] = ()) -> DataFrame:
    """frame, id, v: centre movement since the track's row before, in image widths, where 1 to `max_gap` frames lie between."""
    cx, cy = boxes.track_center(F.col("x"), F.col("y"), F.col("w"), F.col("h"), faithful)
    w = W.partitionBy(*game, "id").orderBy("frame", "row_ord")
    rows = tracks.withColumns({"cx": cx, "cy": cy})
    before = rows.withColumns({k: F.lag(c).over(w) for k, c in (("_f", "frame"), ("_x", "cx"), ("_y", "cy"))})
    dx, dy = (F.col("cx") - F.col("_x")) / image_width, (F.col("cy") - F.col("_y")) / image_width
    return before.filter((F.col("frame") - F.col("_f")).between(1, max_gap)).select(*game, "frame", "id", F.sqrt(dx * dx + dy * dy).alias("v"))


def slow_frames(velocities: DataFrame, threshold: float, ratio: float, min_tracks: int, game: tuple[str, ...] = ()) -> DataFrame:
    """Frames with at least `min_tracks` velocities of which at least the ratio lie below the threshold."""
    counts = velocities.groupBy(*game, "frame").agg(F.count("*").alias("n"), F.count_if(F.col("v") < threshold).alias("slow"))
    return counts.filter((F.col("n") >= min_tracks) & (F.col("slow") / F.col("n") >= ratio))


def islands(rows: DataFrame, at: str, gap: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """start, end, n of runs whose neighbours lie at most `gap` apart."""
    w = W.partitionBy(*keys).orderBy(at)
    marked = rows.withColumn("_new", F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1))
    return marked.withColumn("_k", F.sum("_new").over(w)).groupBy(*keys, "_k").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("_k")


def low_activity(velocities: DataFrame, threshold: float, ratio: float, min_tracks: int, min_frames: int, gap: int = 2, game: tuple[str, ...] = ()) -> DataFrame:
    """(start, end) of runs of slow frames of at least `min_frames`."""
    found = islands(slow_frames(velocities, threshold, ratio, min_tracks, game), "frame", gap, game)
    return found.filter(F.col("end") - F.col("start") + 1 >= min_frames).select(*game, "start", "end")


def merge_intervals(rows: DataFrame, gap: float, keys: tuple[str, ...] = (), start: str = "start", duration: str = "duration") -> DataFrame:
    """(start, duration) after joining intervals that begin at most `gap` after all before have ended."""
    w = W.partitionBy(*keys).orderBy(start, duration)
    ended = F.max(F.col(start) + F.col(duration)).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col(start) <= ended + gap, 0).otherwise(1))
    out = marked.withColumn("_k", F.sum("_new").over(w)).groupBy(*keys, "_k").agg(F.min(start).alias("start"), F.max(F.col(start) + F.col(duration)).alias("_end"))
    return out.select(*keys, "start", (F.col("_end") - F.col("start")).alias("duration"))


def assign_intervals(frames: DataFrame, starts: DataFrame, trim: float = 0.1, game: tuple[str, ...] = ()) -> DataFrame:
    """interval, frame, id for rows inside each interval less the trimmed share of its ends; a game's last interval holds every frame.

    Intervals follow each other, so a frame's interval is that of the last start at or before it: starts and frames are
    ordered together, once, and each frame looks at one interval. Only the last ones, one a game, are joined to all frames.
    """
    w = W.partitionBy(*game).orderBy("start")
    size = F.lead("start").over(w) - 1 - F.col("start")
    bounds = starts.select(*game, "start").distinct().withColumns({"interval": F.row_number().over(w), "_size": size})
    b = F.struct("interval", (F.col("start") + trim * F.col("_size")).alias("lo"), (F.col("start") + F.col("_size") - trim * F.col("_size")).alias("hi"))
    inner = bounds.filter("_size is not null").select(*game, F.col("start").cast("double").alias("_at"), F.lit(0).alias("_k"), F.lit(None).cast("bigint").alias("frame"), F.lit(None).cast("bigint").alias("id"), b.alias("_b"))
    rows = frames.select(*game, F.col("frame").cast("bigint").alias("frame"), F.col("id").cast("bigint").alias("id")).distinct()
    both = inner.unionByName(rows.withColumns({"_at": F.col("frame").cast("double"), "_k": F.lit(1), "_b": F.lit(None).cast(inner.schema["_b"].dataType)}))
    found = both.withColumn("_b", F.last("_b", ignorenulls=True).over(W.partitionBy(*game).orderBy("_at", "_k"))).filter("_k = 1").filter(F.col("frame").between(F.col("_b.lo"), F.col("_b.hi")))
    last = bounds.filter("_size is null").select(*game, "interval")
    every = rows.join(F.broadcast(last), list(game)) if game else rows.crossJoin(F.broadcast(last))  # one row a game
    return found.select(*game, F.col("_b.interval").alias("interval"), "frame", "id").unionByName(every.select(*game, "interval", "frame", "id"))


def crowded_periods(occupancy: DataFrame, fps: float, min_tracks: int, min_duration: float, ratio: float = 0.9, game: str = "game") -> DataFrame:
    """game, start_s, end_s, tracks: greedy periods, the ratio of whose frames hold `min_tracks` or more, with their mean count.

    Frames count from 0 to a game's last, missing ones hold none. A period starts as long as `min_duration`, grows while
    the ratio holds, ends one frame earlier, and the next is sought from there. Prefix sums make each test constant; a
    game's frames are one group.
    """
    least = int(min_duration * fps)
    if least <= 0:
        raise ValueError("a period needs at least one frame")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["frame"].max()) + 1
        counts = [0] * n
        for f, c in zip(pdf["frame"].tolist(), pdf["n"].tolist(), strict=True):
            counts[f] = c
        full, total = [0], [0]
        for c in counts:
            full.append(full[-1] + (c >= min_tracks))
            total.append(total[-1] + c)
        out, at = [], 0
        while at < n - least:
            end = at + least
            if (full[end] - full[at]) / least < ratio:
                at += 1
                continue
            while end < n and (full[end] - full[at]) / (end - at) >= ratio:
                end += 1
            end -= 1
            out.append((pdf[game].iloc[0], at / fps, end / fps, (total[end] - total[at]) / (end - at)))
            at = end
        return pd.DataFrame(out, columns=[game, "start_s", "end_s", "tracks"])

    return occupancy.select(game, "frame", "n").groupBy(game).applyInPandas(scan, f"{game} {occupancy.schema[game].dataType.simpleString()}, start_s double, end_s double, tracks double")


def busy_time(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Total length of the union of (start, end) intervals and of all of them."""
    merged = merge_intervals(rows.select(*keys, "start", (F.col("end") - F.col("start")).alias("duration")), 0, keys)
    both = merged.select(*keys, "duration", F.lit(0.0).alias("all")).unionByName(rows.select(*keys, F.lit(0.0).alias("duration"), (F.col("end") - F.col("start")).cast("double").alias("all")))
    return both.groupBy(*keys).agg(F.sum("duration").alias("busy"), F.sum("all").alias("total"))


def differences(rows: DataFrame, value: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """First and second differences along the order."""
    w = W.partitionBy(*keys).orderBy(order)
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return rows.withColumns({"d1": F.col(value) - one, "d2": F.col(value) - 2 * one + two})


def sequences(rows: DataFrame, value: Column, order: str, length: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the array of the `length` values before them; rows with fewer are left out."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-length, -1)
    return rows.withColumn("window", F.collect_list(value).over(w)).filter(F.size("window") == length)


def rolling_speed(tracks: DataFrame, depth: int = 25, game: tuple[str, ...] = ()) -> DataFrame:
    """Mean movement of the box's centre over the last rows of an unbroken run of frames."""
    w = W.partitionBy(*game, "id").orderBy("frame")
    run = tracks.withColumn("_new", F.when(F.col("frame") - F.lag("frame").over(w) == 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    inner = W.partitionBy(*game, "id", "_run").orderBy("frame")
    step = boxes.distance(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.lag(F.col("x") + F.col("w") / 2).over(inner), F.lag(F.col("y") + F.col("h") / 2).over(inner))
    return run.withColumn("_step", step).withColumn("speed", F.avg("_step").over(inner.rowsBetween(1 - depth, 0))).select(*game, "frame", "id", "speed")


def ema(rows: DataFrame, value: str, order: str, alpha: float, keys: tuple[str, ...]) -> DataFrame:
    """keys, order, ema: exponential average from the first value on, down each key's order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf[[*keys, order]].assign(ema=pdf[value].astype(float).ewm(alpha=alpha, adjust=False).mean())

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*keys, order))
    return rows.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{kinds}, ema double")


def mean_step(tracks: DataFrame, depth: int = 10, least: int = 2, keys: tuple[str, ...] = ("game", "id")) -> DataFrame:
    """keys, frame, vx, vy: mean movement of the foot point over the last `depth` steps of an unbroken run of frames; 0 with fewer than `least`."""
    w = W.partitionBy(*keys).orderBy("frame")
    run = tracks.withColumn("_new", F.when(F.col("frame") - F.lag("frame").over(w) == 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    inner = W.partitionBy(*keys, "_run").orderBy("frame")
    px, py = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h")
    last = inner.rowsBetween(1 - depth, 0)
    run = run.withColumns({"_dx": px - F.lag(px).over(inner), "_dy": py - F.lag(py).over(inner)})
    run = run.withColumns({"_n": F.count("_dx").over(last), "_x": F.avg("_dx").over(last), "_y": F.avg("_dy").over(last)})
    enough = lambda c: F.when(F.col("_n") >= least, F.col(c)).otherwise(F.lit(0.0))
    return run.select(*keys, "frame", enough("_x").alias("vx"), enough("_y").alias("vy"))


def history_speed(tracks: DataFrame, depth: int = 25, x_depth: int = 10, keys: tuple[str, ...] = ("game", "id")) -> DataFrame:
    """keys, frame, speed, x_speed: mean change of the whole box (left, top, width, height) between the rows kept, at most
    `depth` - 1, and the left edge's over the last `x_depth`; a track that misses a frame starts anew."""
    w = W.partitionBy(*keys).orderBy("frame")
    run = tracks.withColumn("_new", F.when(F.col("frame") - F.lag("frame").over(w) == 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    inner = W.partitionBy(*keys, "_run").orderBy("frame")
    step = F.sqrt(sum((F.col(c) - F.lag(c).over(inner)) * (F.col(c) - F.lag(c).over(inner)) for c in "xywh"))
    run = run.withColumns({"_step": step, "_k": F.row_number().over(inner), "_before": F.lag("x", x_depth - 1).over(inner)})
    speed = F.coalesce(F.avg("_step").over(inner.rowsBetween(3 - depth, 0)), F.lit(0.0))
    x_speed = F.when(F.col("_k") >= x_depth, (F.col("x") - F.col("_before")) / x_depth).otherwise(F.lit(0.0))
    return run.select(*keys, "frame", speed.alias("speed"), x_speed.alias("x_speed"))


def stale(tracks: DataFrame, now: DataFrame, most: int = 30, keys: tuple[str, ...] = ("game", "id")) -> DataFrame:
    """keys, age: tracks last seen `most` or more frames before their game's `now` (game, now)."""
    seen = tracks.groupBy(*keys).agg(F.max("frame").alias("_last"))
    return seen.join(F.broadcast(now), list(keys[:-1])).withColumn("age", F.col("now") - F.col("_last")).filter(F.col("age") >= most).select(*keys, "age")


def contiguous(frames: DataFrame, batch: int, keys: tuple[str, ...] = ("game",)) -> DataFrame:
    """keys, frame, before: batches' first frames that do not follow the one before by the batch's size."""
    w = W.partitionBy(*keys).orderBy("frame")
    return frames.select(*keys, "frame").distinct().withColumn("before", F.lag("frame").over(w)).filter(F.col("frame") - F.col("before") != batch)


def subsequence(rows: DataFrame, length: int, seed: int, keys: tuple[str, ...] = ("game",)) -> DataFrame:
    """Rows of one run of `length` rows of each key, from a start that a seeded hash of the key chooses evenly; shorter keys stay whole."""
    w = W.partitionBy(*keys)
    ranked = rows.withColumns({"_k": F.row_number().over(w.orderBy("frame")) - 1, "_n": F.count("*").over(w)})
    first = F.pmod(F.xxhash64(F.lit(seed), *keys), F.greatest(F.col("_n") - length + 1, F.lit(1)))
    return ranked.filter((F.col("_k") >= first) & (F.col("_k") < first + length)).drop("_k", "_n")
