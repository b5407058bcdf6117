"""Joins along an order: the last row at or before, and intervals that overlap. Both cut time into spans, so no task holds a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def as_of(left: DataFrame, right: DataFrame, on: str, values: tuple[str, ...], span: float, keys: tuple[str, ...] = ("game",), order: str | None = None, within: float | None = None) -> DataFrame:
    """Rows of left with `values` of the last right row of their keys at or before their `on`, null if there is none (or none `within` so far).

    Of right rows at one place the last by `order` counts. Rows meet inside a span of `on`; what a span inherits is the last right row of the
    spans before it, found from one row a span.
    """
    tie = F.col(order) if order else F.lit(0)
    held = F.struct(F.col(on).alias("_at"), *values)
    bin_ = F.floor(F.col(on) / span)
    a = left.withColumns({"_bin": bin_, "_row": F.lit(True), "_tie": F.lit(None).cast("long"), "_held": F.lit(None)})
    b = right.select(*keys, on, *values, tie.alias("_tie")).select(*keys, on, bin_.alias("_bin"), F.lit(False).alias("_row"), F.col("_tie").cast("long").alias("_tie"), held.alias("_held"))
    a = a.withColumn("_held", F.col("_held").cast(b.schema["_held"].dataType))
    both = a.unionByName(b, allowMissingColumns=True)
    bins = both.groupBy(*keys, "_bin").agg(F.max(F.when(~F.col("_row"), F.struct(F.col(on).alias("o"), F.col("_tie").alias("t"), F.col("_held").alias("h")))).alias("_l"))
    before = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    carried = bins.select(*keys, "_bin", F.last(F.col("_l.h"), ignorenulls=True).over(before).alias("_before"))
    w = W.partitionBy(*keys, "_bin").orderBy(on, "_row", "_tie").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_here", F.last("_held", ignorenulls=True).over(w)).filter("_row").join(carried, [*keys, "_bin"])
    found = found.withColumn("_v", F.coalesce("_here", "_before"))
    if within is not None:
        found = found.withColumn("_v", F.when(F.col(on) - F.col("_v._at") <= within, F.col("_v")))
    return found.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def overlapping(a: DataFrame, b: DataFrame, span: float, keys: tuple[str, ...] = ("game",), start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows of a and b (b's columns but the keys with `_` behind) whose intervals, ends included, share a place.

    An interval stands in every span that it touches; a pair is told in the first span that both touch, so once.
    """
    first, last = F.floor(F.col(start) / span), F.floor(F.col(end) / span)
    spread = lambda df: df.filter(F.col(end) >= F.col(start)).withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))
    x = spread(a).withColumnRenamed("_first", "_fa")
    y = spread(b).withColumnRenamed("_first", "_fb")
    y = y.select(*keys, "_bin", "_fb", *[F.col(c).alias(f"{c}_") for c in b.columns if c not in keys])
    met = x.join(y, [*keys, "_bin"]).filter((F.col(start) <= F.col(f"{end}_")) & (F.col(f"{start}_") <= F.col(end)) & (F.col("_bin") == F.greatest("_fa", "_fb")))
    return met.drop("_bin", "_fa", "_fb")
