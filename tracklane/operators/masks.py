"""Masks as runs of set pixels (y, x0, x1), ends included: summaries, edges, borders, orientation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import boxes


def _wide():
    return (F.col("x1") - F.col("x0") + 1).cast("double")


def mask_features(mask: DataFrame, width: int, height: int, scale_x: float, scale_y: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and seven features from 0 to 1: the mask's bounds, its mean pixel, and its share of the picture; an empty mask gives no row."""
    n = F.sum(_wide())
    share = lambda v: boxes.clamp(v, F.lit(0.0), F.lit(1.0))
    made = {
        "x1": F.min("x0") / scale_x, "y1": F.min("y") / scale_y, "x2": F.max("x1") / scale_x, "y2": F.max("y") / scale_y,
        "cx": F.sum(_wide() * (F.col("x0") + F.col("x1")) / 2) / n / scale_x, "cy": F.sum(_wide() * F.col("y")) / n / scale_y, "area": n / (width * height),
    }
    return mask.groupBy(*keys).agg(*[share(v).alias(k) for k, v in made.items()]) if keys else mask.agg(*[share(v).alias(k) for k, v in made.items()]).filter("area is not null")


def edge_distances(points: DataFrame, mask: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points (x, y) inside the mask with their distances above, below, left and right to the column's and row's first and last pixels."""
    rows = mask.groupBy(*keys, "y").agg(F.min("x0").alias("_l"), F.max("x1").alias("_r"))
    columns = mask.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x")).groupBy(*keys, "x").agg(F.min("y").alias("_t"), F.max("y").alias("_b"))
    inside = points.join(mask.select(*keys, "y", F.col("x0").alias("_x0"), F.col("x1").alias("_x1")), [*keys, "y"]).filter(F.col("x").between(F.col("_x0"), F.col("_x1"))).drop("_x0", "_x1")
    found = inside.join(rows, [*keys, "y"]).join(columns, [*keys, "x"])
    made = {"above": F.col("y") - F.col("_t"), "below": F.col("_b") - F.col("y"), "left": F.col("x") - F.col("_l"), "right": F.col("_r") - F.col("x")}
    return found.withColumns(made).drop("_l", "_r", "_t", "_b")


def extreme_points(mask: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first set pixels, in rows, at the least and greatest x and y, each as (y, x)."""
    aggs = [
        F.min(F.struct("x0", "y")).alias("_l"), F.min(F.struct((-F.col("x1")).alias("x"), "y")).alias("_r"),
        F.min(F.struct("y", "x0")).alias("_t"), F.min(F.struct((-F.col("y")).alias("y"), "x0")).alias("_b"),
    ]
    found = mask.groupBy(*keys).agg(*aggs)
    pair = lambda y, x, n: [y.alias(f"{n}_y"), x.alias(f"{n}_x")]
    return found.select(*keys, *pair(F.col("_l.y"), F.col("_l.x0"), "left"), *pair(F.col("_r.y"), -F.col("_r.x"), "right"), *pair(F.col("_t.y"), F.col("_t.x0"), "top"), *pair(-F.col("_b.y"), F.col("_b.x0"), "bottom"))


def edge_occupancy(mask: DataFrame, width: int, height: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pixels in the left and right eighth, above the top eighth, and (as in the system being rebuilt) in all below that; the orientation they tell."""
    part = lambda lo, hi: F.greatest(F.least(F.col("x1"), F.lit(hi)) - F.greatest(F.col("x0"), F.lit(lo)) + 1, F.lit(0))
    made = {
        "left": F.sum(part(0, width // 8 - 1)), "right": F.sum(part(width - width // 8, width - 1)),
        "top": F.sum(F.when(F.col("y") < height // 8, part(0, width - 1)).otherwise(0)), "bottom": F.sum(F.when(F.col("y") >= height // 8, part(0, width - 1)).otherwise(0)),
    }
    out = mask.groupBy(*keys).agg(*[v.cast("long").alias(k) for k, v in made.items()])
    return out.withColumn("orientation", F.when(F.col("left") > F.col("right"), "right").when(F.col("right") > F.col("left"), "left").otherwise("UNKNOWN"))


def probe_points(rows: DataFrame, raise_by: float, lower_by: float, threshold: float | None = None) -> DataFrame:
    """Rows with px, py: the centre raised by a share of the height where it lies beyond the threshold, else the foot so lowered."""
    cy, foot = F.col("y") + F.col("h") / 2, F.col("y") + F.col("h")
    high, low = cy - F.col("h") * raise_by, foot - F.col("h") * lower_by
    return rows.withColumns({"px": F.col("x") + F.col("w") / 2, "py": high if threshold is None else F.when(cy > threshold, high).otherwise(low)})


def in_mask_slots(rows: DataFrame, mask: DataFrame, slots: int, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """keys, slot, valid, id, score: of the rows whose (px, py) the mask holds the best `slots` by score, then empty slots; each frame fills all."""
    inside = rows.withColumns({"_x": F.floor("px"), "_y": F.floor("py")}).join(mask.select(F.col("y").alias("_my"), "x0", "x1"), (F.col("_y") == F.col("_my")) & F.col("_x").between(F.col("x0"), F.col("x1")), "left_semi")
    best = inside.withColumn("slot", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "id")) - 1).filter(F.col("slot") < slots)
    all_ = rows.select(*keys).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    found = all_.join(best.select(*keys, "slot", "id", "score"), [*keys, "slot"], "left")
    return found.select(*keys, "slot", F.col("id").isNotNull().alias("valid"), F.coalesce("id", F.lit(0)).alias("id"), F.coalesce("score", F.lit(0.0)).alias("score"))
