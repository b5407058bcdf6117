"""Boxes of a frame packed side by side into one picture, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def readable_size(w: Column, h: Column, least: int = 128, most: int = 256) -> tuple[Column, Column]:
    """Whole-pixel sizes brought to a height between the bounds, the width in proportion; widened ones are at least 1 wide."""
    scaled = lambda to: F.floor(w * to / F.greatest(F.lit(1), h)).cast("long")
    width = F.when(h > most, scaled(float(most))).when(h < least, F.floor(F.greatest(F.lit(1.0), w * float(least) / F.greatest(F.lit(1), h))).cast("long")).otherwise(w)
    return width, F.greatest(F.least(h, F.lit(most)), F.lit(least)).cast("long")


def packed(rows: DataFrame, keys: tuple[str, ...] = ("frame",), aspect: float = 16 / 9) -> DataFrame:
    """keys, id, l, t, r, b, width, height: where each box of a frame (keys, ord, id, w, h in whole pixels) stands in the frame's picture.

    In the order of ord boxes fill a row from the left; one that does not fit begins the next row, below the highest of the row before. The
    picture is at least as wide and high as the largest box, of about the aspect by the boxes' area, no wider than all boxes together, and grows downwards.
    """
    box = F.array_sort(F.collect_list(F.struct("ord", "id", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"))))
    area = F.sum(F.col("w").cast("long") * F.col("h").cast("long"))
    g = rows.groupBy(*keys).agg(box.alias("_b"), F.max("w").cast("long").alias("_w"), F.max("h").cast("long").alias("_h"), F.sum("w").cast("long").alias("_all"), area.alias("_area"))
    high = F.greatest(F.col("_h"), F.floor(F.sqrt(F.col("_area") / aspect)).cast("long"))
    g = g.withColumn("_high", high).withColumn("_wide", F.least(F.greatest(F.col("_w"), F.floor(F.col("_high") * aspect).cast("long")), F.col("_all")))
    zero = F.lit(0).cast("long")
    place = "array<struct<id:bigint,l:bigint,t:bigint,r:bigint,b:bigint>>"
    start = F.struct(zero.alias("x"), zero.alias("y"), zero.alias("row"), F.col("_wide").alias("wide"), F.array().cast(place).alias("out"))

    def put(s: Column, b: Column) -> Column:
        wraps = s["x"] + b["w"] > s["wide"]
        x, y = F.when(wraps, zero).otherwise(s["x"]), F.when(wraps, s["y"] + s["row"]).otherwise(s["y"])
        row = F.greatest(F.when(wraps, zero).otherwise(s["row"]), b["h"])
        at = F.struct(b["id"].cast("bigint").alias("id"), x.alias("l"), y.alias("t"), (x + b["w"]).alias("r"), (y + b["h"]).alias("b"))
        return F.struct((x + b["w"]).alias("x"), y.alias("y"), row.alias("row"), s["wide"].alias("wide"), F.concat(s["out"], F.array(at)).alias("out"))

    out = g.select(*keys, "_wide", "_high", F.aggregate("_b", start, put)["out"].alias("_o"))
    height = F.greatest(F.col("_high"), F.array_max(F.transform("_o", lambda p: p["b"])))
    return out.select(*keys, F.col("_wide").alias("width"), height.alias("height"), F.explode("_o").alias("o")).select(*keys, *[F.col(f"o.{c}").alias(c) for c in ("id", "l", "t", "r", "b")], "width", "height")
