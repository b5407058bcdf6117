"""Sound as rows: blocks of samples, band energies over short-time spectra, whistles, and the lag between two recordings.

A block is a row (keys, at: the index of its first sample, samples: an array). Windows and correlations cross the edges
of blocks, but no task holds a whole recording.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import media

#: Decibels: the least amplitude, and how far under a recording's peak values are cut off.
_FLOOR, _RANGE = 1e-5, 80.0


def blocks(samples: DataFrame, size: int, keys: tuple[str, ...] = ("game",)) -> DataFrame:
    """keys, at, samples of rows (keys, i, v): `size` samples a block; samples that are missing are 0."""
    b = F.expr(f"i div {size}")
    held = samples.groupBy(*keys, b.alias("_b")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") % size).cast("int"), F.col("v").cast("double")))).alias("_m"), F.max(F.col("i") % size).cast("int").alias("_n"))
    return held.select(*keys, (F.col("_b") * size).alias("at"), F.transform(F.sequence(F.lit(0), F.col("_n")), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0))).alias("samples"))


def _joined(at: np.ndarray, parts: list, lo: int, hi: int) -> np.ndarray:
    """Samples lo to hi of the parts that begin at `at`; zeros where there are none."""
    out = np.zeros(hi - lo)
    for a, p in zip(at.tolist(), parts, strict=True):
        i, j = max(a, lo), min(a + len(p), hi)
        if j > i:
            out[i - lo : j - lo] = p[i - a : j - a]
    return out


def band_energy(rows: DataFrame, rate: float, low: float, high: float, size: int = 2048, hop: int = 512, keys: tuple[str, ...] = ("game",), frames_a_task: int = 4096) -> DataFrame:
    """keys, frame, energy: the mean decibels of the frequencies from low to high (Hz, both included) in each short-time spectrum.

    Hann windows of `size` samples stand every `hop` samples, the first centred on sample 0; zeros surround a recording. Decibels
    are cut off 80 under the recording's greatest value at any frequency.
    """
    bins = np.flatnonzero((np.arange(size // 2 + 1) * rate / size >= low) & (np.arange(size // 2 + 1) * rate / size <= high))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    span, names = hop * frames_a_task, list(keys)
    ends = rows.groupBy(*keys).agg(F.max(F.col("at") + F.size("samples")).alias("_end"))
    first, last = F.floor((F.col("at") - size) / span), F.floor((F.col("at") + F.size("samples") + size) / span)
    cut = rows.join(ends, names).withColumn("_part", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).filter(F.col("_part") * frames_a_task <= F.expr(f"_end div {hop}"))
    # only what the part's windows reach goes to it
    lo, hi = F.greatest(F.col("_part") * span - size // 2 - F.col("at"), F.lit(0)), F.least((F.col("_part") + 1) * span + size // 2 - F.col("at"), F.size("samples"))
    cut = cut.filter(hi > lo).select(*keys, "_part", "_end", (F.col("at") + lo).alias("at"), F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("samples"))

    def spectra(t: pa.Table) -> pa.Table:
        part, end = t["_part"][0].as_py(), t["_end"][0].as_py()
        f = np.arange(part * frames_a_task, min((part + 1) * frames_a_task, 1 + end // hop))
        begin = int(f[0]) * hop - size // 2
        x = _joined(t["at"].to_numpy(), [np.asarray(s) for s in t["samples"].to_pylist()], begin, begin + (len(f) - 1) * hop + size)
        db = 20 * np.log10(np.maximum(np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * window)), _FLOOR))
        cols = {k: pa.chunked_array([pa.repeat(t[k][0], len(f))]) for k in names}
        return pa.table(cols | {"frame": pa.array(f), "peak": pa.array(db.max(axis=1)), "band": pa.array(list(db[:, bins]), pa.list_(pa.float64()))})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    made = cut.groupBy(*keys, "_part").applyInArrow(spectra, f"{kinds}, frame bigint, peak double, band array<double>")
    peaks = made.groupBy(*keys).agg((F.max("peak") - _RANGE).alias("_least"))
    total = F.aggregate(F.transform("band", lambda v: F.greatest(v, F.col("_least"))), F.lit(0.0), lambda s, v: s + v)
    return made.join(peaks, names).select(*keys, "frame", (total / len(bins)).alias("energy") if len(bins) else F.lit(None).cast("double").alias("energy"))


def whistles(rows: DataFrame, rate: float, low: float = 2000.0, high: float = 4000.0, least: float = 0.05, percentile: float = 0.95, size: int = 2048, hop: int = 512, keys: tuple[str, ...] = ("game",)) -> DataFrame:
    """keys, start, end in seconds of runs of neighbouring spectra, `least` seconds or longer, whose band energy lies over the percentile."""
    energy = band_energy(rows, rate, low, high, size, hop, keys).select(*keys, F.col("frame").alias("at"), "energy")
    runs = media.loud_runs(energy, percentile, 1, least * rate / hop, keys)
    return runs.select(*keys, (F.col("start") * hop / rate).alias("start"), (F.col("end") * hop / rate).alias("end"))


def best_lag(left: DataFrame, right: DataFrame, size: int, most: int | None = None, keys: tuple[str, ...] = ("game",), together: int = 16) -> DataFrame:
    """keys, lag: by how many samples `left` comes later than `right`: where their cross-correlation is greatest, the least of equals.

    Both are blocks of `size` samples. Blocks at most `most` samples (None: any) apart meet: those of one distance are multiplied
    as spectra, `together` at a time, and added up by lag. Lags beyond `most` take no part.
    """
    names = list(keys)
    number = lambda df, side: df.select(*keys, F.expr(f"at div {size}").alias("i"), F.col("samples").alias(side))
    a, b = number(left, "a"), number(right, "b")
    ends = a.groupBy(*keys).agg(F.max("i").alias("_a")).join(b.groupBy(*keys).agg(F.max("i").alias("_b")), names)
    reach = F.lit(-(-most // size) + 1) if most is not None else None
    lo, hi = (-F.col("_b"), F.col("_a")) if reach is None else (F.greatest(-F.col("_b"), -reach), F.least(F.col("_a"), reach))
    far = ends.select(*keys, F.explode(F.sequence(lo, hi)).alias("d"))
    met = a.join(far, names).withColumn("j", F.col("i") - F.col("d")).join(b.withColumnRenamed("i", "j"), [*names, "j"]).withColumn("_g", F.expr(f"i div {together}"))

    def correlated(t: pa.Table) -> pa.Table:
        n = 2 * size
        spectrum = np.zeros(n // 2 + 1, complex)
        for p, q in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True):
            spectrum += np.fft.rfft(p, n) * np.conj(np.fft.rfft(q, n))
        c = np.fft.irfft(spectrum, n)
        lags = t["d"][0].as_py() * size + np.r_[np.arange(size), np.arange(-size, 0)]
        return pa.table({k: pa.chunked_array([pa.repeat(t[k][0], n)]) for k in names} | {"lag": pa.array(lags), "v": pa.array(c)})

    kinds = ", ".join(f"{k} {left.schema[k].dataType.simpleString()}" for k in keys)
    sums = met.groupBy(*keys, "d", "_g").applyInArrow(correlated, f"{kinds}, lag bigint, v double").groupBy(*keys, "lag").agg(F.sum("v").alias("v"))
    inside = sums.join(_lengths(left, "_n", keys), names).join(_lengths(right, "_m", keys), names).filter((F.col("lag") > -F.col("_m")) & (F.col("lag") < F.col("_n")))
    if most is not None:
        inside = inside.filter(F.abs("lag") <= most)
    return inside.groupBy(*keys).agg((-F.max(F.struct(F.round("v", 6).alias("v"), (-F.col("lag")).alias("l")))["l"]).alias("lag"))


def _lengths(rows: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(F.col("at") + F.size("samples")).alias(name))


def frame_offsets(lag: Column, rate: float, fps: float) -> tuple[Column, Column]:
    """The frames to leave out at the start of the left and of the right video so that they run together."""
    frames = lag / F.lit(rate / fps)
    return F.greatest(frames, F.lit(0.0)), F.greatest(-frames, F.lit(0.0))
