"""Jersey numbers: evidence a track, roster rules, splits and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T


def last_number(observations: DataFrame) -> DataFrame:
    """id, frame, number: the last observation of a track in a frame."""
    return observations.groupBy("id", "frame").agg(F.max_by("number", "row_ord").alias("number"))


def in_roster(numbers: DataFrame, roster: DataFrame | None) -> DataFrame:
    """Rows whose number is on the roster; no roster keeps all."""
    return numbers if roster is None else numbers.join(roster.select("number").distinct(), "number", "left_semi")


def frequent_numbers(numbers: DataFrame, least: float = 0.1) -> DataFrame:
    """id, number, n, first_frame of numbers seen at least `least` times as often as the track's commonest."""
    counts = numbers.groupBy("id", "number").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"))
    return counts.withColumn("_most", F.max("n").over(W.partitionBy("id"))).filter(F.col("n") >= least * F.col("_most")).drop("_most")


def trim_one_digit(numbers: Column) -> Column:
    """Numbers of an array without those below 10 whose digit stands in one of two digits."""
    return F.filter(numbers, lambda n: (n >= 10) | ~F.exists(numbers, lambda m: (m >= 10) & F.contains(m.cast("string"), n.cast("string"))))


def resolved(observations: DataFrame, roster: DataFrame | None = None, least: float = 0.1) -> DataFrame:
    """id, sub, number, first_frame: a track's number; where several remain, one sub-track each in order of first sight."""
    seen = last_number(observations)
    kinds = seen.groupBy("id").agg(F.sort_array(F.collect_set("number")).alias("all"))
    on = in_roster(seen.select("id", "number").distinct(), roster).groupBy("id").agg(F.sort_array(F.collect_set("number")).alias("rostered"))
    picked = kinds.join(on, "id", "left").withColumn("kept", F.when(F.size("all") == 1, F.col("all")).when(F.size("rostered") == 1, F.col("rostered")).otherwise(trim_one_digit(F.coalesce("rostered", "all"))))
    rows = seen.join(picked.select("id", "kept"), "id").filter(F.array_contains("kept", F.col("number")))
    rank = F.row_number().over(W.partitionBy("id").orderBy("first_frame", "number"))
    return frequent_numbers(rows, least).withColumn("sub", rank - 1).select("id", "sub", "number", "first_frame")


def split_tracks(found: DataFrame) -> DataFrame:
    """track, number, first_frame of resolved tracks: sub-track i of a track is its id and i tenths, so at most ten fit; more make an error."""
    track = F.when(F.col("sub") < 10, F.col("id") + F.col("sub") / 10).otherwise(F.raise_error(F.lit("a track with more than ten numbers")).cast("double"))
    return found.select(track.alias("track"), "number", "first_frame")


def decayed_votes(observations: DataFrame, window: int, decay: float, two_digit: float = 0.61, one_digit: float = 0.39, keys: tuple[str, ...] = ("game", "id")) -> DataFrame:
    """keys, frame, number, votes: the number with most decayed votes of a track's last `window` frames.

    Observations stand in blocks of `window` frames, their own and the next, where each frame sees those before it; they are shuffled once, and what
    a frame sees stays in its row, in the order of numbers and frames.
    """
    own = F.floor(F.col("frame") / window)
    bias = F.when(F.col("number") >= 10, two_digit).otherwise(one_digit)
    entry = F.struct("number", "frame", "score", bias.alias("bias"))
    both = observations.select(*keys, "frame", entry.alias("_e"), F.explode(F.array(own, own + 1)).alias("_b"))
    block = W.partitionBy(*keys, "_b").orderBy("frame")
    here = both.withColumns({"_seen": F.array_sort(F.collect_list("_e").over(block.rangeBetween(-window, 0))), "_k": F.row_number().over(block), "_r": F.rank().over(block)})
    asked = here.filter((F.col("_b") == own) & (F.col("_k") == F.col("_r")))  # one row of each frame
    fresh = lambda n: F.struct(n.alias("number"), F.lit(None).cast("double").alias("votes"))

    def add(a: Column, e: Column) -> Column:
        """The best number so far and the one whose votes are being added."""
        now, best = a["now"], a["best"]
        same = now["number"].eqNullSafe(e["number"])
        held = F.when(same, now).otherwise(fresh(e["number"]))
        vote = e["score"] * F.pow(F.lit(decay), F.col("frame") - e["frame"]) * e["bias"]
        votes = F.coalesce(held["votes"] + vote, vote, held["votes"])  # an unknown score is no vote
        return F.struct(F.when(same, best).otherwise(better(best, now)).alias("best"), F.struct(held["number"].alias("number"), votes.alias("votes")).alias("now"))

    def better(best: Column, now: Column) -> Column:
        more = F.coalesce(F.round(now["votes"], 9) > F.round(best["votes"], 9), now["votes"].isNotNull() & best["votes"].isNull())
        return F.when(best.isNull() | more, now).otherwise(best)

    number = observations.schema["number"].dataType
    none = F.struct(F.lit(None).cast(T.StructType([T.StructField("number", number), T.StructField("votes", T.DoubleType())])).alias("best"), fresh(F.element_at("_seen", 1)["number"]).alias("now"))
    won = F.aggregate("_seen", none, add, lambda a: better(a["best"], a["now"]))
    return asked.withColumn("_won", won).select(*keys, "frame", "_won.number", "_won.votes")


def shifts(seen: DataFrame, starts: DataFrame, game: tuple[str, ...] = ("game",)) -> DataFrame:
    """game, number, shift, start, duration: a number's time on, from the intervals in which it was seen.

    `starts` holds each game's intervals (start in seconds); an interval lasts to the next start, the last one without
    end. `seen` holds (game, start, number). Neighbouring intervals join. A shift whose start equals the *duration* of
    the one before joins that too, as in the analytics being rebuilt.
    """
    w = W.partitionBy(*game).orderBy("start")
    spans = starts.select(*game, "start").distinct().withColumns({"_k": F.row_number().over(w), "_end": F.coalesce(F.lead("start").over(w).cast("double"), F.lit(float("inf")))})
    rows = seen.select(*game, "start", "number").distinct().join(spans, [*game, "start"])
    by = W.partitionBy(*game, "number").orderBy("_k")
    runs = rows.withColumn("_run", F.sum(F.when(F.col("_k") - F.lag("_k").over(by) == 1, 0).otherwise(1)).over(by))
    runs = runs.groupBy(*game, "number", "_run").agg(F.min("start").cast("double").alias("s"), F.max("_end").alias("e"))
    lists = runs.groupBy(*game, "number").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_l"))
    none = F.array().cast("array<struct<start:double,duration:double>>")

    def join(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        alone = F.concat(acc, F.array(F.struct(x["s"].alias("start"), (x["e"] - x["s"]).alias("duration"))))
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), (x["e"] - last["start"]).alias("duration"))))
        return F.when(last["duration"] == x["s"], longer).otherwise(alone)

    return lists.select(*game, "number", F.posexplode(F.aggregate("_l", none, join)).alias("shift", "_s")).select(*game, "number", "shift", "_s.start", "_s.duration")


def best_reading(readings: DataFrame, keys: tuple[str, ...] = ("frame", "id")) -> DataFrame:
    """keys, number, vote: of text readings (number, score, width, roi_width, vote_scale, ord) the one with the largest vote, the first by ord of equals.

    A vote is the score times the text's share of its region's width (at least 1, in whole pixels) times the region's scale.
    """
    vote = F.col("score") * F.col("width") / F.greatest(F.lit(1), F.col("roi_width").cast("int")) * F.col("vote_scale")
    best = F.max(F.struct(vote.alias("vote"), (-F.col("ord")).alias("o"), "number"))
    return readings.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.number", "m.vote")


def readable(text: Column, detected: Column, recognised: Column, least_detected: float = 0.5, least_recognised: float = 0.8) -> Column:
    """The number of a text reading that is sure enough, all digits and below 100; else null."""
    value = F.when(text.rlike(r"^[0-9]{1,9}$"), text.cast("int"))
    return F.when((detected >= least_detected) & (recognised >= least_recognised) & (value < 100), value)


@F.udtf(returnType=T.StructType([T.StructField("track", T.DoubleType()), T.StructField("number", T.IntegerType()), T.StructField("first_frame", T.LongType())]))
class SplitTrack:
    """A track's id and its resolved numbers (arrays of numbers and first frames) as sub-tracks, for SQL: register it as a table function."""

    def eval(self, track: int, numbers: list, first_frames: list):
        for k, (number, frame) in enumerate(sorted(zip(numbers, first_frames), key=lambda x: (x[1], x[0]))):
            yield track + k / 10, number, frame
