"""Clock texts, labels, file names and fractions as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def format_hms(seconds: Column, decimals: int = 0) -> Column:
    """HH:MM:SS; the seconds are rounded by themselves (half to even), so 59.9996 may show as 60."""
    whole = F.floor(seconds)
    rest = F.bround(seconds - F.floor(whole / 60) * 60, decimals)
    width = 2 if not decimals else 3 + decimals
    return F.concat(F.format_string("%02d:%02d:", F.floor(whole / 3600), F.floor(whole / 60) % 60), F.lpad(F.format_string(f"%.{decimals}f", rest), width, "0"))


def parse_hms(text: Column) -> Column:
    """Seconds of 1 to 3 fields parted by colons; null for anything else."""
    part = F.split(text, ":")
    value = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    return F.when(F.size(part) == 1, value(1)).when(F.size(part) == 2, value(1) * 60 + value(2)).when(F.size(part) == 3, value(1) * 3600 + value(2) * 60 + value(3))


def parse_rate(text: Column) -> Column:
    """Frames a second of `n/d` or a number; zero where it cannot be read."""
    part = F.split(text, "/")
    value = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    return F.coalesce(F.when(F.size(part) == 2, F.try_divide(value(1), value(2))).otherwise(value(1)), F.lit(0.0))


def frame_seconds(start: Column, end: Column, fps) -> tuple[Column, Column]:
    """(start, duration) in seconds of frames start to end."""
    return start / fps, (end - start) / fps


def jersey_number(text: Column) -> Column:
    """The number of a text of one or two digits, from 1 to 99; else null."""
    value = F.when(text.rlike(r"^[0-9]{1,2}$"), text.cast("int"))
    return F.when(value > 0, value)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def chapter(name: Column) -> Column:
    """Struct (video, chapter) of a camera's file name: GX<chapter><video>.MP4 or VID_<date>_<time>_<chapter>."""
    a = lambda i: F.regexp_extract(name, r"(?i)^G[XHL](\d{2})(\d{4})\.mp4$", i).try_cast("int")
    b = lambda i: F.regexp_extract(name, r"(?i)^VID_(\d{8})_(\d{6})_(?:\d{2}_)?(\d{3})", i)
    return F.struct(F.coalesce(a(2).cast("string"), F.nullif(F.concat(b(1), b(2)), F.lit(""))).alias("video"), F.coalesce(a(1), b(3).try_cast("int")).alias("chapter"))


def sanitized_label(label: Column) -> Column:
    """Labels that are negative or beyond 32 bits become 0."""
    return F.when(label.between(0, 2**31 - 1), label).otherwise(F.lit(0))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def clean_label(text: Column, charset: str, max_length: int) -> Column:
    """White space gone, letters folded to the charset's case, others dropped; null if too long."""
    out = F.regexp_replace(text, r"\s+", "")
    if charset == charset.lower():
        out = F.lower(out)
    elif charset == charset.upper():
        out = F.upper(out)
    out = F.regexp_replace(out, "[^" + "".join("\\" + c if not c.isalnum() else c for c in charset) + "]", "")
    return F.when(F.length(out) <= max_length, out)


def expand_hosts(df, column: str):
    """One row for each host of lists such as name[1-3,07]."""
    name, inner = F.regexp_extract(column, r"^([^\[]*)", 1), F.regexp_extract(column, r"\[([^\]]*)\]", 1)
    rows = df.withColumn("_name", name).withColumn("_part", F.explode(F.split(inner, ",")))
    lo, hi = F.split("_part", "-")[0], F.element_at(F.split("_part", "-"), -1)
    numbers = F.transform(F.sequence(lo.try_cast("int"), hi.try_cast("int")), lambda n: F.lpad(n.cast("string"), F.greatest(F.length(lo), F.length(n.cast("string"))), "0"))
    return rows.withColumn("host", F.explode(F.when(F.col("_part") == "", F.array(F.lit(""))).otherwise(numbers))).withColumn("host", F.concat("_name", "host")).drop("_name", "_part")


def time_frame(text: Column, fps) -> Column:
    """The frame of a clock text, cut to a whole number."""
    return F.floor(parse_hms(text) * fps).cast("long")


def parse_clock(text: Column) -> Column:
    """Whole seconds of 1 to 3 whole fields; null for anything else."""
    return F.when(text.rlike(r"^\s*-?\d+(\s*:\s*-?\d+){0,2}\s*$"), parse_hms(F.regexp_replace(text, r"\s", ""))).cast("long")


def parse_intervals(text: Column) -> Column:
    """Array of (start, stop) seconds of texts `a-b`, parted by commas."""
    return F.transform(F.split(text, ","), lambda t: F.struct(parse_clock(F.split(t, "-")[0]).alias("start"), parse_clock(F.split(t, "-")[1]).alias("stop")))


def in_intervals(seconds: Column, intervals: Column) -> Column:
    return F.exists(intervals, lambda i: seconds.between(i["start"], i["stop"]))


def clock_of(seconds: Column) -> Column:
    """H:MM:SS or MM:SS of whole seconds."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def file_safe(text: Column) -> Column:
    """Trimmed, with runs of path separators as one underscore; empty for null."""
    return F.coalesce(F.regexp_replace(F.trim(text), r"[\\/]+", "_"), F.lit(""))


def _split_name(path: Column) -> tuple[Column, Column, Column]:
    """Folder with its separator, stem and extension with its dot."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    dotted = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.regexp_extract(path, r"^(.*/)[^/]*$", 1), F.left(name, F.length(name) - F.length(dotted)), dotted


def with_suffix(path: Column, suffix: Column) -> Column:
    folder, stem, dotted = _split_name(path)
    return F.concat(folder, stem, suffix, dotted)


def with_prefix(path: Column, prefix: Column, between: str = "_") -> Column:
    """The file's name led by the prefix, unless it is already, or the prefix is blank."""
    p = F.trim(F.coalesce(prefix, F.lit("")))
    folder, stem, dotted = _split_name(path)
    name = F.concat(stem, dotted)
    then = F.substr(name, F.length(p) + 1, F.lit(1))
    has = name.startswith(p) & ((name == p) | then.isin("_", "-") | F.substr(name, F.length(p) + 1).startswith(between))
    return F.when((p == "") | has, path).otherwise(F.concat(folder, p, F.when(p.rlike("[_-]$"), F.lit("")).otherwise(F.lit(between)), name))


def token_map(line: Column) -> Column:
    """Map of a line's tokens: their leading letters to what follows; the last of equals."""
    tokens = F.filter(F.split(line, " "), lambda t: t != "")
    pairs = F.transform(tokens, lambda t: F.struct(F.regexp_extract(t, r"^([A-Za-z]*)", 1).alias("k"), F.regexp_replace(t, r"^[A-Za-z]*", "").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def game_line(line: Column) -> Column:
    """Struct (id, path, side, label, metadata) of `path[:HOME|:AWAY][:k=v]|k=v...` or `t2s=<id>[:HOME|:AWAY][:label]|k=v...`.

    The first of equal keys before a bar wins over those in the path; of equal keys behind bars the last.
    """
    parts = F.filter(F.transform(F.split(line, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    token = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    pair = lambda s: F.struct(F.trim(F.regexp_extract(s, r"^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract(s, r"^[^=]*=(.*)$", 1)).alias("value"))
    fine = lambda p: (p["key"] != "") & (p["value"] != "")
    barred = F.filter(F.transform(F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda s: s.contains("=")), pair), fine)
    known = token.rlike(r"(?i)^t2s\s*=\s*\d+")
    rest = F.regexp_replace(F.trim(F.regexp_extract(token, r"(?i)^t2s\s*=\s*\d+(.*)$", 1)), "^:", "")
    first, more = F.trim(F.regexp_extract(rest, r"^([^:]*)", 1)), F.trim(F.regexp_extract(rest, r"^[^:]*:(.*)$", 1))
    t_side = F.when(F.upper(first).isin("HOME", "AWAY"), F.upper(first))
    label = F.nullif(F.when(t_side.isNotNull(), more).otherwise(rest), F.lit(""))
    fields = F.split(token, ":")
    # trailing k=v fields of a path
    tail = F.aggregate(F.reverse(F.slice(fields, 2, F.greatest(F.size(fields), F.lit(1)))), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda a, f: F.struct((a["on"] & f.contains("=")).alias("on"), (a["n"] + F.when(a["on"] & f.contains("="), 1).otherwise(0)).alias("n")))["n"]
    body = F.slice(fields, 1, F.size(fields) - tail)
    inline = F.filter(F.transform(F.reverse(F.slice(fields, F.size(fields) - tail + 1, F.greatest(tail, F.lit(0)))), pair), fine)
    last = F.element_at(body, -1)
    sided = (F.size(body) > 1) & F.upper(last).isin("HOME", "AWAY")
    path = F.array_join(F.when(sided, F.slice(body, 1, F.size(body) - 1)).otherwise(body), ":")
    whole = F.when(known, F.reverse(barred)).otherwise(F.concat(F.reverse(barred), inline))
    keys = F.array_sort(F.array_distinct(F.transform(whole, lambda p: p["key"])))
    meta = F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(whole, lambda p: p["key"] == k)[0]["value"]))
    return F.struct(
        F.when(known, F.regexp_extract(token, r"(?i)^t2s\s*=\s*(\d+)", 1).cast("long")).alias("id"), F.when(~known, path).alias("path"),
        F.when(known, t_side).when(sided, F.upper(last)).alias("side"), F.when(known, label).alias("label"), meta.alias("metadata"),
    )


def normal_label(text: Column, charset: str, most: int) -> Column:
    """A label without white space and, its accents apart, in ASCII; null if longer than `most` before, or empty after, folding it to the charset.

    Letters decompose by a fixed list of Latin ones, which covers the labels of this kind.
    """
    plain = F.translate(F.regexp_replace(text, r"\s+", ""), _ACCENTED, _BARE)
    plain = F.regexp_replace(plain, r"[^\x00-\x7F]", "")
    return F.nullif(F.when(F.length(plain) <= most, clean_label(plain, charset, most)), F.lit(""))


#: Letters with accents and the letters they decompose to.
_ACCENTED, _BARE = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def interval_frames(total: Column, fps: Column, start: Column, duration: Column, start_frame: Column, duration_frames: Column) -> tuple[Column, Column]:
    """(first, last) frame of a cut: frame arguments override clock arguments; the end is part of it and capped."""
    first = F.coalesce(F.greatest(start_frame, F.lit(0)), F.greatest(time_frame(start, fps), F.lit(0)), F.lit(0))
    counted = F.coalesce(duration_frames, F.greatest(time_frame(duration, fps), F.lit(0)))
    return first, F.coalesce(F.least(total - 1, first + counted - 1), total - 1)


@F.pandas_udf(T.StringType())
def best_rational(rates: pd.Series) -> pd.Series:
    """The fraction nearest to a rate with a denominator up to 1001, as n/d."""
    from fractions import Fraction

    show = lambda f: f"{f.numerator}/{f.denominator}"
    return rates.map(lambda r: None if pd.isna(r) else show(Fraction(r).limit_denominator(1001)))
