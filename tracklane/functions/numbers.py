"""Numbers that don't depend on the order in which rows come."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def steady_mean(value: Column) -> Column:
    """An aggregate: the mean of a group's values, null if it has none; summed from the least on, with what each step rounds off kept apart.

    For groups of a frame's size, whose values are held as an array. `avg` adds values as they arrive, so its last digits change from run to run.
    """
    none = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(a: Column, v: Column) -> Column:
        t = a["s"] + v
        return F.struct(t.alias("s"), (a["c"] + F.when(F.abs(a["s"]) >= F.abs(v), (a["s"] - t) + v).otherwise((v - t) + a["s"])).alias("c"))

    values = F.array_sort(F.collect_list(value.cast("double")))
    total = F.aggregate(values, none, add, lambda a: F.when(F.isnan(a["c"]), a["s"]).otherwise(a["s"] + a["c"]))
    return F.try_divide(total, F.size(values))
