"""Metadata of recordings as rows: sound runs, target profiles, rates, goals a side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .intervals import islands


def loud_runs(energy: DataFrame, percentile: float, gap: float, min_length: float, keys: tuple[str, ...] = ("game",)) -> DataFrame:
    """keys, start, end of runs, at least `min_length` long, of times whose energy lies over the percentile of their recording.

    Rows hold keys, at and energy; times at most `gap` apart make one run. The percentile is exact, over a recording's values.
    """
    bar = energy.groupBy(*keys).agg(F.percentile("energy", F.lit(percentile)).alias("_bar"))
    loud = energy.join(bar, list(keys)).filter(F.col("energy") > F.col("_bar")).select(*keys, "at")
    return islands(loud, "at", gap, keys).filter(F.col("end") - F.col("start") >= min_length).drop("n")


def target_profile(files: DataFrame, keys: tuple[str, ...], channel_cap: int = 2) -> DataFrame:
    """Profile to which a group's files are brought: the size of largest area (first of equals by ord), highest rates, channels up to the cap."""
    best = F.max_by(F.struct("width", "height"), F.struct(F.col("width") * F.col("height"), -F.col("ord")))
    out = files.groupBy(*keys).agg(best.alias("_s"), F.max("fps").alias("fps"), F.max("audio_rate").alias("audio_rate"), F.max("channels").alias("_c"))
    fallback = lambda c, d: F.when(c > 0, c).otherwise(F.lit(d))
    return out.select(*keys, F.coalesce("_s.width", F.lit(1920)).alias("width"), F.coalesce("_s.height", F.lit(1080)).alias("height"), fallback(F.col("fps"), 30.0).alias("fps"), fallback(F.col("audio_rate"), 48000).alias("audio_rate"), F.least(fallback(F.col("_c"), 1), F.lit(max(1, channel_cap))).alias("channels"))


def combined_rate(rates: DataFrame, rate: str, keys: tuple[str, ...]) -> DataFrame:
    """Product over sum of the rates (for two, that of both in turn); 0 where they sum to 0."""
    return rates.groupBy(*keys).agg(F.product(rate).alias("_p"), F.sum(rate).alias("_s")).select(*keys, F.when(F.col("_s") != 0, F.col("_p") / F.col("_s")).otherwise(F.lit(0.0)).alias("rate"))


def goal_counts(goals: DataFrame, keys: tuple[str, ...] = ("side",)) -> DataFrame:
    """gf and ga: goals for and against, of rows whose kind is GF or GA."""
    return goals.groupBy(*keys).agg(F.count_if(F.col("kind") == "GF").alias("gf"), F.count_if(F.col("kind") == "GA").alias("ga"))
