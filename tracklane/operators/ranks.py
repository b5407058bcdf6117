"""Numbers along an order over whole tables, from ranges and their counts: no task holds more than a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql import types as T


def numbered(rows: DataFrame, name: str, *by) -> DataFrame:
    """rows with `name`: 1, 2, 3 ... in the order `by`. Sorted ranges are counted, then numbered behind the ranges before."""
    kind = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])
    return rows.sparkSession.createDataFrame(rows.sort(*by).rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1)), kind)


def score_bins(rows: DataFrame, score: str, keys: tuple[str, ...], bins: int = 1024) -> DataFrame:
    """rows with `_bin`: where their score lies between their key's greatest (0) and least."""
    ends = rows.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    at = F.floor((F.col("_hi") - F.col(score)) / (F.col("_hi") - F.col("_lo")) * (bins - 1)).cast("int")
    return rows.join(ends, list(keys)).withColumn("_bin", F.when(F.col("_hi") > F.col("_lo"), at).otherwise(F.lit(0))).drop("_lo", "_hi")


def bins_before(totals: DataFrame, keys: tuple[str, ...], *columns: str) -> DataFrame:
    """A bin's columns summed over the bins before it, as `_before_<column>`: a window over one row a bin."""
    w = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    return totals.withColumns({f"_before_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in columns})
