"""All queries over the driver's tables, with their SQL.

The driver has no tracking data: `tracks` projects its events onto tracks of games
of a hundred frames, in Spark and, as the CTE `t`, in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .functions import boxes, numbers, text
from .operators import frames, groups, intervals, jerseys, media, training
from .sources import tables
from .streaming import folds, movers

_WIDTH = 2000.0
_T = """t AS (SELECT (event_id // 15 + 1) // 100 AS game, event_id // 15 + 1 AS frame, user_id % 20 + 1 AS id, value * 10.0 AS x, CAST(props->>'k' AS DOUBLE) * 5 AS y,
  20.0 + event_id % 17 AS w, 40.0 + event_id % 23 AS h, (event_id % 100) / 100.0 AS score, event_type AS label, CAST(props->>'k' AS INT) AS number, event_id AS row_ord
  FROM events QUALIFY row_number() OVER (PARTITION BY event_id // 15, user_id % 20 ORDER BY event_id DESC) = 1)"""
_V = _T + f""", l AS (SELECT *, lag(frame) OVER o AS pf, lag(x + w / 2) OVER o AS px, lag(y + y / 2) OVER o AS py FROM t WINDOW o AS (PARTITION BY game, id ORDER BY frame, row_ord)),
v AS (SELECT game, frame, id, sqrt(((x + w / 2 - px) / {_WIDTH}) * ((x + w / 2 - px) / {_WIDTH}) + ((y + y / 2 - py) / {_WIDTH}) * ((y + y / 2 - py) / {_WIDTH})) AS v FROM l WHERE frame - pf BETWEEN 1 AND 2)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    rows = e.select(
        F.expr("event_id div 15 + 1").alias("frame"), (F.col("user_id") % 20 + 1).alias("id"), (F.col("value") * 10.0).alias("x"), (k.cast("double") * 5).alias("y"),
        (F.lit(20.0) + F.col("event_id") % 17).alias("w"), (F.lit(40.0) + F.col("event_id") % 23).alias("h"), ((F.col("event_id") % 100) / 100.0).alias("score"),
        F.col("event_type").alias("label"), k.cast("int").alias("number"), F.col("event_id").alias("row_ord"),
    )
    return frames.last_of(rows, ("frame", "id"), "row_ord").withColumn("game", F.expr("frame div 100"))


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(tracks(spark, sf_dir)) if f.__code__.co_varnames[0] == "t" else f(spark, sf_dir)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


#: Velocities below this many image widths are slow; a frame of 4 tracks or more is slow where half of them are.
_BAR, _SHARE = 0.2, 0.5
_GAME = ("game",)
_SLOW = _V + f", s AS (SELECT game, frame, count(*) AS n, count(*) FILTER (WHERE v < {_BAR}) AS slow FROM v GROUP BY 1, 2 HAVING count(*) >= 4 AND count(*) FILTER (WHERE v < {_BAR}) / count(*) >= {_SHARE})"
_LOW = _SLOW + """, k AS (SELECT game, frame, sum(CASE WHEN frame - lag <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY game ORDER BY frame) AS k FROM (SELECT game, frame, lag(frame) OVER (PARTITION BY game ORDER BY frame) AS lag FROM s)),
low AS (SELECT game, min(frame) AS "start", max(frame) AS "end" FROM k GROUP BY game, k.k HAVING max(frame) - min(frame) + 1 >= 3)"""


def _breaks(gap: float) -> str:
    return _LOW + f""", i AS (SELECT game, "start" / 30.0 AS s, ("end" - "start") / 30.0 AS d FROM low),
m AS (SELECT game, s, s + d AS e, max(s + d) OVER (PARTITION BY game ORDER BY s, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe, d FROM i),
g AS (SELECT game, s, e, sum(CASE WHEN s <= pe + {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY game ORDER BY s, d) AS g FROM m)
SELECT game, round(min(s), 6) AS start_s, round(max(e) - min(s), 6) AS duration_s FROM g GROUP BY game, g.g"""


def _velocity(t: DataFrame) -> DataFrame:
    return intervals.track_velocity(t, _WIDTH, game=_GAME)


def _low(t: DataFrame) -> DataFrame:
    return intervals.low_activity(_velocity(t), _BAR, _SHARE, 4, 3, game=_GAME)


def _break_rows(t: DataFrame, gap: float) -> DataFrame:
    start, duration = text.frame_seconds(F.col("start"), F.col("end"), 30.0)
    merged = intervals.merge_intervals(_low(t).select("game", start.alias("start"), duration.alias("duration")), gap, _GAME)
    return _r(merged.select("game", F.col("start").alias("start_s"), F.col("duration").alias("duration_s")), "start_s", "duration_s")


@query("WITH " + _breaks(0.3))
def period_breaks(t):
    return _break_rows(t, 0.3)


@query("WITH " + _breaks(0.15))
def faceoff_breaks(t):
    return _break_rows(t, 0.15)


@query("WITH " + _V + " SELECT game, frame, id, round(v, 9) AS v FROM v")
def track_velocity(t):
    return _r(_velocity(t), "v", digits=9)


@query("WITH " + _SLOW + " SELECT game, frame, n, slow FROM s")
def slow_frames(t):
    return intervals.slow_frames(_velocity(t), _BAR, _SHARE, 4, _GAME)


@query("WITH " + _LOW + ' SELECT game, "start", "end" FROM low')
def low_velocity_ranges(t):
    return _low(t)


@query("WITH " + _T + " SELECT frame, count(DISTINCT id) AS n FROM t GROUP BY 1")
def frame_occupancy(t):
    return t.groupBy("frame").agg(F.count_distinct("id").alias("n"))


@query("WITH RECURSIVE " + _T + """, z AS (SELECT game, max(frame % 100) + 1 AS size FROM t GROUP BY 1), f AS (SELECT game, i, size FROM z, range(100) q(i) WHERE i < size),
c AS (SELECT f.game, f.i, size, count(DISTINCT id) AS n FROM f LEFT JOIN t ON t.game = f.game AND t.frame % 100 = f.i GROUP BY 1, 2, 3),
p AS (SELECT game, i + 1 AS i, size, sum((n >= 10)::INT) OVER o AS s, sum(n) OVER o AS total FROM c WINDOW o AS (PARTITION BY game ORDER BY i) UNION ALL SELECT game, 0, size, 0, 0 FROM z),
e AS (SELECT a.game, a.i, a.size, a.total AS t0, min(b.i) - 1 AS stop, max((b.i = a.i + 6 AND (b.s - a.s) / 6 >= 0.75)::INT) AS good FROM p a JOIN p b ON a.game = b.game AND b.i >= a.i + 6
  WHERE a.i < a.size - 6 AND (b.i = a.i + 6 OR b.i = b.size OR (b.s - a.s) / (b.i - a.i) < 0.75) GROUP BY 1, 2, 3, 4),
n AS (SELECT e.game, e.i, good, CASE WHEN good = 1 THEN (SELECT min(b.i) - 1 FROM p b, p a WHERE b.game = e.game AND a.game = e.game AND a.i = e.i AND b.i > e.i + 6 AND (b.i = b.size OR (b.s - a.s) / (b.i - a.i) < 0.75)) ELSE e.i + 1 END AS nxt FROM e),
r AS (SELECT game, 0::BIGINT AS i FROM z UNION ALL SELECT r.game, n.nxt::BIGINT FROM r JOIN n ON n.game = r.game AND n.i = r.i)
SELECT n.game, round(n.i / 30.0, 9) AS start_s, round(nxt / 30.0, 9) AS end_s, round((b.total - a.total) / (nxt - n.i), 9) AS tracks FROM r JOIN n ON n.game = r.game AND n.i = r.i AND n.good = 1 JOIN p a ON a.game = n.game AND a.i = n.i JOIN p b ON b.game = n.game AND b.i = nxt""")
def crowded_periods(t):
    counts = t.groupBy("game", (F.col("frame") % 100).alias("frame")).agg(F.count_distinct("id").alias("n"))
    return _r(intervals.crowded_periods(counts, 30.0, 10, 0.2, 0.75), "start_s", "end_s", "tracks", digits=9)


_INTERVALS = _T + """, i AS (SELECT game, row_number() OVER o AS interval, s, lead(s) OVER o - 1 - s AS z FROM (SELECT DISTINCT game, (frame // 20) * 20 + 1 AS s FROM t) WINDOW o AS (PARTITION BY game ORDER BY s)),
a AS (SELECT DISTINCT game, interval, s, frame, id, number FROM t JOIN i USING (game) WHERE z IS NULL OR frame BETWEEN s + 0.1 * z AND s + z - 0.1 * z)"""


def _starts(t: DataFrame) -> DataFrame:
    return t.select("game", F.expr("(frame div 20) * 20 + 1").alias("start")).distinct()


@query("WITH " + _INTERVALS + " SELECT DISTINCT game, interval, frame, id FROM a")
def interval_assign(t):
    return intervals.assign_intervals(t.select("game", "frame", "id"), _starts(t), game=_GAME)


_OBS = _T + ", o AS (SELECT * FROM t WHERE number > 0 AND number < 100), r AS (SELECT DISTINCT number FROM o WHERE number % 3 = 0)"


def _obs(t: DataFrame) -> DataFrame:
    return t.filter("number > 0 and number < 100")


def _roster(t: DataFrame) -> DataFrame:
    return _obs(t).filter("number % 3 = 0").select("number").distinct()


@query("WITH " + _OBS + " SELECT id, frame, number FROM o SEMI JOIN r USING (number)")
def roster_filter(t):
    return jerseys.in_roster(_obs(t).select("id", "frame", "number"), _roster(t)).select("id", "frame", "number")


_FREQ = _OBS + ", c AS (SELECT id, number, count(*) AS n, min(frame) AS first_frame FROM o GROUP BY 1, 2), q AS (SELECT * FROM c QUALIFY n >= 0.5 * max(n) OVER (PARTITION BY id))"


@query("WITH " + _FREQ + " SELECT id, number, n, first_frame FROM q")
def frequent_numbers(t):
    return jerseys.frequent_numbers(jerseys.last_number(_obs(t)), 0.5)


@query("WITH " + _OBS + " SELECT game, id, number, min(frame) AS first_frame, string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame) AS frames FROM o GROUP BY 1, 2, 3")
def number_first_seen(t):
    return _obs(t).groupBy("game", "id", "number").agg(F.min("frame").alias("first_frame"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("frame")), lambda f: f.cast("string"))).alias("frames"))


@query("WITH " + _OBS + """, d AS (SELECT DISTINCT frame, number FROM o)
SELECT frame, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS numbers FROM d WHERE number >= 10 OR NOT EXISTS (SELECT 1 FROM d e WHERE e.frame = d.frame AND e.number >= 10 AND contains(CAST(e.number AS VARCHAR), CAST(d.number AS VARCHAR))) GROUP BY 1""")  # fmt: skip
def one_digit_trim(t):
    kept = jerseys.trim_one_digit(F.col("a"))
    return _obs(t).groupBy("frame").agg(F.sort_array(F.collect_set("number")).alias("a")).select("frame", F.concat_ws(",", F.transform(kept, lambda n: n.cast("string"))).alias("numbers"))


@query("WITH " + _FREQ.replace("0.5 *", "0.9 *").replace("FROM o GROUP BY 1, 2)", """FROM (SELECT o.* FROM o JOIN k ON k.id = o.id AND k.number = o.number) GROUP BY 1, 2)""").replace(", c AS", """, n AS (SELECT DISTINCT id, number FROM o),
b AS (SELECT id, count(*) AS a, count(*) FILTER (WHERE number IN (SELECT number FROM r)) AS m FROM n GROUP BY 1),
p AS (SELECT n.id, n.number, a, m FROM n JOIN b USING (id) WHERE a = 1 OR m = 0 OR number IN (SELECT number FROM r)),
k AS (SELECT id, number FROM p WHERE a = 1 OR m = 1 OR number >= 10 OR NOT EXISTS (SELECT 1 FROM p e WHERE e.id = p.id AND e.number >= 10 AND contains(CAST(e.number AS VARCHAR), CAST(p.number AS VARCHAR)))), c AS""") + " SELECT id, row_number() OVER (PARTITION BY id ORDER BY first_frame, number) - 1 AS sub, number, first_frame FROM q")  # fmt: skip
def roster_resolve(t):
    return jerseys.resolved(_obs(t), _roster(t), 0.9)


@query("WITH RECURSIVE " + _INTERVALS + """, n AS (SELECT DISTINCT game, number, interval, s FROM a WHERE number > 0 AND number < 100), e AS (SELECT n.*, coalesce((SELECT min(i.s) FROM i WHERE i.game = n.game AND i.s > n.s), 1e9) AS e FROM n),
k AS (SELECT *, sum(CASE WHEN interval - p = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY game, number ORDER BY interval) AS k FROM (SELECT *, lag(interval) OVER (PARTITION BY game, number ORDER BY interval) AS p FROM e)),
g AS (SELECT game, number, (min(s) - 1 - 100 * game) / 20.0 AS s, CASE WHEN max(e) = 1e9 THEN 1e9 ELSE (max(e) - 1 - 100 * game) / 20.0 END AS e, row_number() OVER (PARTITION BY game, number ORDER BY min(s)) AS j FROM k GROUP BY game, number, k.k),
r AS (SELECT game, number, j, s, e, 0 AS shift FROM g WHERE j = 1 UNION ALL SELECT g.game, g.number, g.j, CASE WHEN r.e - r.s = g.s THEN r.s ELSE g.s END, g.e, CASE WHEN r.e - r.s = g.s THEN r.shift ELSE r.shift + 1 END FROM r JOIN g ON g.game = r.game AND g.number = r.number AND g.j = r.j + 1)
SELECT game, number, shift, max(s) AS start, round(CASE WHEN max(e) = 1e9 THEN -1 ELSE max(e) - max(s) END, 6) AS duration FROM r GROUP BY 1, 2, 3""")  # fmt: skip
def shift_intervals(t):
    starts = _starts(t)
    seconds = lambda d: d.withColumn("start", (F.col("start") - 1 - 100 * F.col("game")) / 20.0)
    w = W.partitionBy("game").orderBy("start")
    seen = intervals.assign_intervals(t.select("game", "frame", "id"), starts, game=_GAME).join(starts.withColumn("interval", F.row_number().over(w)), ["game", "interval"])
    seen = seen.join(_obs(t).select("game", "frame", "id", "number"), ["game", "frame", "id"])
    out = jerseys.shifts(seconds(seen.select("game", "start", "number")), seconds(starts))
    return out.withColumns({"duration": F.round(F.when(F.col("duration") == float("inf"), -1.0).otherwise(F.col("duration")), 6), "shift": F.col("shift").cast("int")})


@query("WITH " + _OBS + """, g AS (SELECT DISTINCT a.game, a.frame, a.id FROM o a), e AS (SELECT g.game, g.frame, g.id, b.number, sum(b.score * pow(0.9, g.frame - b.frame) * CASE WHEN b.number >= 10 THEN 0.61 ELSE 0.39 END) AS votes
FROM g JOIN o b ON b.game = g.game AND b.id = g.id AND b.frame BETWEEN g.frame - 30 AND g.frame GROUP BY 1, 2, 3, 4)
SELECT game, frame, id, number, round(votes, 6) AS votes FROM e QUALIFY row_number() OVER (PARTITION BY game, frame, id ORDER BY round(votes, 9) DESC, number) = 1""")  # fmt: skip
def decayed_votes(t):
    return _r(jerseys.decayed_votes(_obs(t), 30, 0.9), "votes")


@query("WITH " + _T + """, c AS (SELECT frame, greatest(least((x + w / 2) / 2000, 1), 0) AS cx, greatest(least((y + h / 2) / 600, 1), 0) AS cy FROM t)
SELECT frame, round(least(count(*) / 22.0, 1), 9) AS n, round(avg(cx), 9) AS mean_cx, round(avg(cy), 9) AS mean_cy, round(stddev_pop(cx), 9) AS std_cx, round(stddev_pop(cy), 9) AS std_cy, round(min(cx), 9) AS min_cx, round(max(cx), 9) AS max_cx, round(max(cx) - min(cx), 9) AS width FROM c GROUP BY 1""")  # fmt: skip
def frame_features(t):
    return _r(frames.frame_features(t, 2000.0, 600.0, 22), "n", "mean_cx", "mean_cy", "std_cx", "std_cy", "min_cx", "max_cx", "width", digits=9)


@query("WITH " + _T + " SELECT DISTINCT frame FROM t WHERE frame IN (SELECT frame FROM t WHERE label = 'click') AND frame IN (SELECT frame FROM t WHERE score > 0.5)")
def frame_intersection(t):
    return frames.common_frames(t, t.filter("label = 'click'"), t.filter("score > 0.5"))


_B = ", avg(x) AS x, avg(y) AS y, avg(w) AS w, avg(h) AS h FROM t WHERE row_ord % 2 = "


@query("WITH " + _T + f""", a AS (SELECT frame{_B}0 GROUP BY 1), b AS (SELECT frame{_B}1 GROUP BY 1),
j AS (SELECT greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i, a.w * a.h + b.w * b.h AS s, sqrt(pow(a.x + a.w / 2 - b.x - b.w / 2, 2) + pow(a.y + a.h / 2 - b.y - b.h / 2, 2)) AS d FROM a JOIN b USING (frame))
SELECT count(*) AS frames, round(avg(i / (s - i)), 6) AS mean_iou, round(avg(d), 6) AS mean_distance FROM j""")  # fmt: skip
def run_compare_iou(t):
    run = lambda k: t.filter(F.col("row_ord") % 2 == k).groupBy("frame").agg(*[F.avg(c).alias(c) for c in "xywh"])
    return _r(frames.compare_runs(run(0), run(1)), "mean_iou", "mean_distance")


@query("WITH " + _T + " SELECT t.frame, t.id, coalesce(s.number, -1) AS jersey FROM t LEFT JOIN (SELECT frame, id, number FROM t WHERE number > 50) s USING (frame, id)")
def attach_defaults(t):
    side = t.filter("number > 50").select("frame", "id", F.col("number").alias("jersey"))
    return frames.attach(t.select("frame", "id"), side, ("frame", "id"), {"jersey": -1})


@query("WITH " + _T + ", m AS (SELECT max(x + w) AS mx, max(y + h) AS my FROM t) SELECT frame, id, mx, my FROM t, m")
def rink_cross(t):
    m = t.agg(F.max(F.col("x") + F.col("w")).alias("mx"), F.max(F.col("y") + F.col("h")).alias("my"))
    return t.select("frame", "id").crossJoin(F.broadcast(m))  # one row


_IOU = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"
_WIDE = _T + ", u AS (SELECT * REPLACE (w * 10 AS w, h * 5 AS h) FROM t)"


def _wide(t):
    return t.withColumns({"w": F.col("w") * 10, "h": F.col("h") * 5})


@query("WITH " + _WIDE + f""", j AS (SELECT a.frame, a.id, b.id AS id_, {_IOU} AS i, a.w * a.h + b.w * b.h AS s FROM u a JOIN u b ON a.frame = b.frame AND a.row_ord % 2 = 0 AND b.row_ord % 2 = 1)
SELECT frame, id, id_, round(i / (s - i), 6) AS iou FROM j WHERE i / (s - i) > 0.1 QUALIFY row_number() OVER (PARTITION BY frame, id ORDER BY i / (s - i) DESC, id_) = 1""")  # fmt: skip
def iou_best_match(t):
    u = _wide(t)
    return _r(frames.best_match(u.filter("row_ord % 2 = 0"), u.filter("row_ord % 2 = 1"), 0.1), "iou")


@query("WITH " + _WIDE + f" SELECT frame, id FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE a.frame = b.frame AND a.id <> b.id AND {_IOU} > 0)")
def non_overlap(t):
    return frames.non_overlapping(_wide(t)).select("frame", "id")


@query("WITH " + _T + " SELECT frame, id, score FROM t QUALIFY row_number() OVER (PARTITION BY frame ORDER BY score DESC, id) <= 3")
def topk_per_frame(t):
    return frames.top_k(t, 3, [F.desc("score"), F.col("id")]).select("frame", "id", "score")


@query("WITH " + _T + " SELECT frame, id, h FROM t QUALIFY row_number() OVER (PARTITION BY frame ORDER BY h DESC, id) <= 4")
def tallest_k(t):
    return frames.top_k(t, 4, [F.desc("h"), F.col("id")]).select("frame", "id", "h")


@query("WITH " + _T + " SELECT frame, id FROM t QUALIFY row_number() OVER (PARTITION BY frame ORDER BY w * h DESC, id) > 1 OR count(*) OVER (PARTITION BY frame) < 5")
def drop_largest(t):
    return frames.drop_largest(t, 5).select("frame", "id")


@query("WITH " + _T + " SELECT frame, id FROM t QUALIFY h >= 60 OR max(h) OVER (PARTITION BY frame) < 60")
def min_height(t):
    return frames.min_height(t, 60.0).select("frame", "id")


@query("WITH " + _T + """ SELECT frame, id FROM t WHERE NOT (x + w / 2 BETWEEN 0 AND 1000 AND y + h / 2 < 50 + 50 * (x + w / 2) / 1000) AND NOT (x + w / 2 BETWEEN 500 AND 2000 AND y + h / 2 > 450 - 100 * (x + w / 2 - 500) / 1500)""")
def border_prune(t):
    return frames.below_borders(t, [(0.0, 50.0, 1000.0, 100.0)], [(500.0, 450.0, 2000.0, 350.0)]).select("frame", "id")


@query("WITH " + _T + " SELECT frame, id FROM t WHERE CAST(floor(y + h / 2) AS BIGINT) BETWEEN 0 AND 399 AND floor(x + w / 2) BETWEEN floor(y + h / 2) AND 1500 + floor(y + h / 2)")
def mask_prune(t):
    mask = t.sparkSession.range(400).select(F.col("id").alias("y"), F.col("id").alias("x0"), (F.col("id") + 1500).alias("x1"))
    return frames.in_mask(t, mask).select("frame", "id")


@query("WITH " + _T + " SELECT frame, id, label FROM t WHERE id >= 0 AND isfinite(x) AND isfinite(y) AND w >= 0 AND h >= 0")
def valid_tracks(t):
    return t.filter(boxes.valid(boxes.tlwh_to_tlbr(boxes.cols("x", "y", "w", "h"))) & (F.col("id") >= 0)).select("frame", "id", "label")


@query("WITH " + _T + """ SELECT frame, id, x + w AS r, y + h AS b, x + w / 2 AS cx, round(w / h, 6) AS ratio, greatest(least(x, 1000), 100) AS clamped, round(100 * abs(pi() / 2 * ((x - 1000) / 1000) - pi() / 2 * ((x + w - 1000) / 1000)), 6) AS arc,
 CASE WHEN x < 0 THEN 0 WHEN x + w > 1000 THEN 1000 - w ELSE x END AS flush FROM t""")
def box_ops(t):
    b = boxes.tlwh_to_tlbr(boxes.cols("x", "y", "w", "h"))
    bounds = tuple(F.lit(v) for v in (0.0, 0.0, 1000.0, 10000.0))
    out = t.select("frame", "id", b[2].alias("r"), b[3].alias("b"), boxes.center(b)[0].alias("cx"), boxes.aspect_ratio(b).alias("ratio"), boxes.clamp(F.col("x"), F.lit(100.0), F.lit(1000.0)).alias("clamped"), boxes.panoramic_distance(F.col("x"), F.col("x") + F.col("w"), F.lit(2000.0)).alias("arc"), boxes.shift_into(b, bounds)[0].alias("flush"))
    return _r(out, "ratio", "arc", "cx", "flush")


@query("""WITH s AS (SELECT event_id, value * 37 AS s FROM events) SELECT event_id, printf('%02d:%02d:%02d', CAST(floor(s / 3600) AS INT), CAST(floor(s / 60) AS INT) % 60, CAST(round_even(s - floor(s / 60) * 60, 0) AS INT)) AS clock FROM s""")
def hms_format(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.format_hms(F.col("value") * 37).alias("clock"))


@query("SELECT event_id, (event_id % 3) * 3600.0 + (event_id % 60) * 60.0 + user_id % 60 AS seconds, CASE event_id % 4 WHEN 0 THEN 30000 / 1001.0 WHEN 1 THEN 25 WHEN 2 THEN 0 ELSE 59.94 END AS fps, CASE event_id % 4 WHEN 3 THEN NULL ELSE (event_id % 3) * 60.0 + user_id % 60 END AS short FROM events")
def hms_parse(spark, sf_dir):
    clock = F.concat_ws(":", F.col("event_id") % 3, F.col("event_id") % 60, F.col("user_id") % 60)
    rate = F.element_at(F.array(*map(F.lit, ("30000/1001", "25", "1/0", "59.94"))), (F.col("event_id") % 4 + 1).cast("int"))
    short = F.when(F.col("event_id") % 4 == 3, "1:x").otherwise(F.concat_ws(":", F.col("event_id") % 3, F.col("user_id") % 60))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.parse_hms(clock).alias("seconds"), text.parse_rate(rate).alias("fps"), text.parse_hms(short).alias("short"))


_VX = _T + ", g AS (SELECT frame, x + w / 2 AS cx, x - lag(x) OVER (PARTITION BY game, id ORDER BY frame) AS vx FROM t), f AS (SELECT * FROM g WHERE vx IS NOT NULL)"


def _group_sql(op: str, neg: str, most: str) -> str:
    return "WITH " + _VX + f""", c AS (SELECT frame, count(*) AS n, count(*) FILTER (WHERE vx {op} 300) AS r, count(*) FILTER (WHERE vx {neg} -300) AS l, max(cx) FILTER (WHERE vx {op} 300) AS er, min(cx) FILTER (WHERE vx {neg} -300) AS el FROM f GROUP BY 1)
SELECT frame, CASE WHEN r / n > 0.5 THEN 1 ELSE -1 END AS direction, CASE WHEN r / n > 0.5 THEN er ELSE el END AS edge_x FROM c WHERE n {most} 4 AND (r / n > 0.5 OR l / n > 0.5)"""


def _speeds(t):
    return t.withColumn("vx", F.col("x") - F.lag("x").over(W.partitionBy("game", "id").orderBy("frame"))).filter("vx is not null").withColumn("cx", F.col("x") + F.col("w") / 2)


@query(_group_sql(">", "<", ">"))
def group_velocity_strict(t):
    return frames.group_velocity(_speeds(t), 300.0, 0.5, 4, True)


@query(_group_sql(">=", "<=", ">="))
def group_velocity_native(t):
    return frames.group_velocity(_speeds(t), 300.0, 0.5, 4, False)


@query("WITH " + _T + ', c AS (SELECT game, frame, avg(x) AS x FROM t GROUP BY 1, 2) SELECT game, frame, round(x - lag(x) OVER o, 9) AS d1, round(x - 2 * lag(x) OVER o + lag(x, 2) OVER o, 9) AS d2 FROM c WINDOW o AS (PARTITION BY game ORDER BY frame)')
def diff1_diff2(t):
    return _r(intervals.differences(t.groupBy("game", "frame").agg(F.avg("x").alias("x")), "x", "frame", _GAME), "d1", "d2", digits=9).drop("x")


@query("WITH " + _T + ", c AS (SELECT game, frame, count(*) AS n FROM t GROUP BY 1, 2) SELECT game, frame, array_to_string(list(n) OVER o, ',') AS window_n FROM c WINDOW o AS (PARTITION BY game ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER o = 4")
def sliding_sequences(t):
    rows = intervals.sequences(t.groupBy("game", "frame").agg(F.count("*").alias("n")), F.col("n"), "frame", 4, _GAME)
    return rows.select("game", "frame", F.concat_ws(",", F.transform("window", lambda n: n.cast("string"))).alias("window_n"))


@query("WITH " + _T + " SELECT id, max(frame) AS frame, arg_max(label, frame) AS label FROM t GROUP BY 1")
def latest_action(t):
    return t.groupBy("id").agg(F.max("frame").alias("frame"), F.max_by("label", "frame").alias("label"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def last_wins_dedupe(spark, sf_dir):
    return frames.last_of(spark.read.parquet(f"{sf_dir}/events.parquet"), ("user_id",), "event_id").select("user_id", "event_id", "event_type")


@query("WITH " + _T + " SELECT frame, sha256(string_agg(concat(id, ',', row_ord, ',', label), ';' ORDER BY concat(id, ',', row_ord, ',', label))) AS hash FROM t GROUP BY 1")
def fingerprint(t):
    return frames.fingerprint(t, ("frame",), ("id", "row_ord", "label"))


@query("WITH " + _T + " SELECT max(x + w) AS max_x, max(y + h) AS max_y FROM t")
def max_extents(t):
    return frames.max_extents(t)


@query("WITH " + _T + " SELECT frame, min(x) AS l, min(y) AS t, max(x + w) AS r, max(y + h) AS b FROM t GROUP BY 1")
def union_box(t):
    return frames.enclosing(t)


@query("SELECT event_id, CASE WHEN user_id - 50 BETWEEN 0 AND 2147483647 THEN user_id - 50 ELSE 0 END AS label FROM events")
def label_sanitize(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.sanitized_label(F.col("user_id") - 50).alias("label"))


@query("""WITH o AS (SELECT c_mktsegment AS player, CASE WHEN c_custkey % 2 = 0 THEN 'home' ELSE 'away' END AS side, CAST(max(c_custkey) AS VARCHAR) AS v FROM customer GROUP BY 1, 2)
SELECT player, max(v) FILTER (WHERE side = 'home') AS home, max(v) FILTER (WHERE side = 'away') AS away, CAST(max(v) FILTER (WHERE side = 'home') AS INT) - CAST(max(v) FILTER (WHERE side = 'away') AS INT) AS delta FROM o GROUP BY 1""")
def player_compare(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_mktsegment").alias("player"), F.when(F.col("c_custkey") % 2 == 0, "home").otherwise("away").alias("side")).agg(F.max("c_custkey").cast("string").alias("v"))
    return frames.pivot_sides(rows, "player", "side", "v")


@query("SELECT c_name AS name, c_acctbal AS balance, 'home' AS side FROM customer UNION ALL SELECT s_name, s_acctbal, 'away' FROM supplier")
def union_sides(spark, sf_dir):
    read = lambda t, p, side: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(f"{p}_name").alias("name"), F.col(f"{p}_acctbal").alias("balance"), F.lit(side).alias("side"))
    return read("customer", "c", "home").unionByName(read("supplier", "s", "away"))


_PR = """WITH b AS (SELECT d.lang AS cls, d.doc_id AS ord, d.n_chars AS conf, l.quality AS hit FROM documents d JOIN labels l USING (doc_id)),
p AS (SELECT cls, ord, row_number() OVER o AS seen, sum(hit) OVER o / nullif(sum(hit) OVER (PARTITION BY cls), 0) AS recall, sum(hit) OVER o / row_number() OVER o AS precision FROM b WINDOW o AS (PARTITION BY cls ORDER BY conf DESC, ord))"""


def _scored(spark, sf_dir):
    d, q = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return d.select("doc_id", F.col("lang").alias("cls"), F.col("n_chars").alias("conf")).join(q, "doc_id").select("cls", F.col("doc_id").alias("ord"), "conf", F.col("quality").alias("hit"))


@query(_PR + " SELECT cls, ord, seen, round(recall, 6) AS recall, round(precision, 6) AS precision FROM p")
def pr_curve(spark, sf_dir):
    return _r(frames.precision_recall(_scored(spark, sf_dir)), "recall", "precision")


@query(_PR + """, e AS (SELECT cls, seen, recall, max(precision) OVER (PARTITION BY cls ORDER BY seen DESC) AS best, lag(recall) OVER (PARTITION BY cls ORDER BY seen) AS before FROM p)
SELECT cls, round(sum(best * (recall - coalesce(before, 0))), 6) AS ap FROM e GROUP BY 1""")
def average_precision(spark, sf_dir):
    return _r(frames.average_precision(_scored(spark, sf_dir)), "ap")


@query("WITH " + _T + """, i AS (SELECT game, id, frame AS s, frame + w / 10 AS e FROM t), m AS (SELECT *, max(e) OVER (PARTITION BY game, id ORDER BY s, e - s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM i),
k AS (SELECT *, sum(CASE WHEN s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY game, id ORDER BY s, e - s) AS k FROM m), u AS (SELECT game, id, max(e) - min(s) AS d FROM k GROUP BY game, id, k.k)
SELECT game, id, round(b, 6) AS busy, round(a, 6) AS total FROM (SELECT game, id, sum(d) AS b FROM u GROUP BY 1, 2) JOIN (SELECT game, id, sum(e - s) AS a FROM i GROUP BY 1, 2) USING (game, id)""")
def busy_union(t):
    rows = t.select("game", "id", F.col("frame").cast("double").alias("start"), (F.col("frame") + F.col("w") / 10).alias("end"))
    return _r(intervals.busy_time(rows, ("game", "id")), "busy", "total")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS \"start\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return _r(folds.event_windows(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour"), "total")


@query("WITH b AS (SELECT label, vec_id // 16 AS batch, count(*) AS n, avg(list_sum(embedding)) AS m FROM embeddings GROUP BY 1, 2) SELECT label, sum(n) AS n, round(sum(m * n) / sum(n), 4) AS mean_sum FROM b GROUP BY 1")
def batch_means(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    batches = e.groupBy("label", F.expr("vec_id div 16").alias("batch")).agg(F.count("*").alias("n"), F.avg(total).alias("mean_sum"))
    return _r(frames.weighted_means(batches, ("label",), "n", ("mean_sum",)), "mean_sum", digits=4)


@query("SELECT a.n_name AS a, b.n_name AS b, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def edit_similarity(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    both = n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey")
    return _r(both.select("a", "b", text.edit_similarity(F.col("a"), F.col("b")).alias("similarity")), "similarity")


@query("WITH " + _T + """, r AS (SELECT game, id, frame, x, row_number() OVER (PARTITION BY game, id ORDER BY frame) AS k FROM t)
SELECT a.game, a.id, a.frame, round(sum(b.x * CASE WHEN b.k = 1 THEN pow(2 / 3, a.k - 1) ELSE pow(2 / 3, a.k - b.k) / 3 END), 6) AS ema FROM r a JOIN r b ON a.game = b.game AND a.id = b.id AND b.k <= a.k GROUP BY 1, 2, 3""")
def ema_anchor(t):
    return _r(intervals.ema(t, "x", "frame", 1 / 3, ("game", "id")), "ema")


@query("WITH " + _T + """, m AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY game, id ORDER BY frame) = 1 THEN 0 ELSE 1 END AS fresh FROM t), r AS (SELECT *, sum(fresh) OVER (PARTITION BY game, id ORDER BY frame) AS run FROM m),
s AS (SELECT game, id, run, frame, sqrt(pow(x + w / 2 - lag(x + w / 2) OVER o, 2) + pow(y + h / 2 - lag(y + h / 2) OVER o, 2)) AS step FROM r WINDOW o AS (PARTITION BY game, id, run ORDER BY frame))
SELECT game, frame, id, round(avg(step) OVER (PARTITION BY game, id, run ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS speed FROM s""")
def rolling_speed(t):
    return _r(intervals.rolling_speed(t, 10, _GAME), "speed")


@query("WITH RECURSIVE " + _OBS + """, i AS (SELECT game * 100 + id AS track, frame, number, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY game, id ORDER BY frame) AS k FROM o),
s AS (SELECT track, 0::BIGINT AS k, NULL::BIGINT AS frame, CAST([] AS STRUCT(n INT, v DOUBLE)[]) AS m, -1 AS number FROM (SELECT DISTINCT track FROM i) UNION ALL
SELECT track, k, frame, m, CASE WHEN cur < 0 THEN CASE WHEN top >= 1 THEN best ELSE cur END WHEN best <> cur AND top >= 1 AND top >= 1.05 * coalesce(second, 0) AND top >= 1.35 * coalesce(own, 0) THEN best ELSE cur END FROM
 (SELECT *, list_max(list_transform(list_filter(m, lambda x: x.n <> best), lambda x: x.v)) AS second, list_filter(m, lambda x: x.n = cur)[1].v AS own FROM
  (SELECT *, list_filter(m, lambda x: x.v = top)[1].n AS best FROM
   (SELECT track, k, frame, m, cur, list_max(list_transform(m, lambda x: x.v)) AS top FROM
    (SELECT track, k, frame, cur, CASE WHEN len(list_filter(m, lambda x: x.n = number)) > 0 THEN list_transform(m, lambda x: {'n': x.n, 'v': x.v + CASE WHEN x.n = number THEN greatest(score, 0) ELSE 0 END}) ELSE list_append(m, {'n': number, 'v': greatest(score, 0)}) END AS m FROM
     (SELECT s.track, i.k, i.frame, i.number, i.score, s.number AS cur, list_filter(list_transform(s.m, lambda x: {'n': x.n, 'v': x.v * pow(0.92, greatest(1, i.frame - s.frame))}), lambda x: x.v >= 1e-4) AS m FROM s JOIN i ON i.track = s.track AND i.k = s.k + 1))))))
SELECT track, frame, number FROM s WHERE frame IS NOT NULL""")
def evidence_voter(t):
    rows = _obs(t).select((F.col("game") * 100 + F.col("id")).alias("track"), "frame", "number", F.col("score").cast("double").alias("score"))
    return folds.fold(rows, folds.EvidenceVoter(), "track")


@query("WITH RECURSIVE " + _T + """, c AS (SELECT game, frame, avg(x + w / 2) AS cx, row_number() OVER (PARTITION BY game ORDER BY frame) AS k FROM t GROUP BY 1, 2),
z AS (SELECT game, frame, k, CASE WHEN cx < 400 THEN 'left' WHEN cx > 600 THEN 'right' ELSE 'middle' END AS zone FROM c WHERE k = 1 UNION ALL
SELECT c.game, c.frame, c.k, CASE WHEN z.zone = 'left' AND cx <= 450 OR z.zone = 'right' AND cx >= 550 THEN z.zone WHEN cx < 400 THEN 'left' WHEN cx > 600 THEN 'right' ELSE 'middle' END FROM z JOIN c ON c.game = z.game AND c.k = z.k + 1)
SELECT game, frame, zone FROM z""")
def zone_state(t):
    cx = t.groupBy("game", "frame").agg(numbers.steady_mean(F.col("x") + F.col("w") / 2).alias("cx"))
    return folds.fold(cx, folds.Zones(400.0, 450.0, 550.0, 600.0), "game")


@query()
def association_tracker(t):
    rows = t.select("game", "frame", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.length("label").cast("long").alias("label"), F.col("score").cast("double").alias("score"))
    return folds.fold(rows, folds.Associations(), "game")


@query("SELECT track, number, first_frame FROM (SELECT id + sub / 10.0 AS track, number, first_frame FROM (" + ORACLE_SQL["roster_resolve"] + ") WHERE sub < 10)")
def track_split(t):
    return jerseys.split_tracks(jerseys.resolved(_obs(t), _roster(t), 0.9).filter("sub < 10"))


@query("""WITH i AS (SELECT event_id // 500 AS game, event_id / 4.0 AS s, value / 100.0 AS d FROM events), m AS (SELECT *, max(s + d) OVER (PARTITION BY game ORDER BY s, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM i),
g AS (SELECT *, sum(CASE WHEN s <= pe + 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY game ORDER BY s, d) AS g FROM m) SELECT game, round(min(s), 6) AS "start", round(max(s + d) - min(s), 6) AS duration FROM g GROUP BY game, g.g""")
def interval_merge(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("event_id div 500").alias("game"), (F.col("event_id") / 4.0).alias("start"), (F.col("value") / 100.0).alias("duration"))
    return _r(intervals.merge_intervals(rows, 0.5, ("game",)), "start", "duration")


@query("WITH " + _T + """, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY w * h DESC, id) AS big, row_number() OVER (PARTITION BY frame ORDER BY trunc(x + w / 2), id) AS low,
row_number() OVER (PARTITION BY frame ORDER BY trunc(x + w / 2) DESC, id) AS top, count(*) OVER (PARTITION BY frame) AS n FROM t) SELECT frame, id FROM r WHERE n < 4 OR NOT (big = 1 OR (n >= 10 AND (low = 1 OR top = 1)))""")
def extremes_prune(t):
    return groups.without_extremes(t).select("frame", "id")


@query()
def kmeans_cluster(t):
    return groups.cluster_boxes(t)


_PF = "least(greatest({}, 0), 1)"


@query("WITH " + _T + f""" SELECT frame, {", ".join(f"round({_PF.format(e)}, 9) AS {n}" for n, e in {
    "count": "count(*) / 22.0", "mean_cx": "avg((x + x + w) / 2 / 6000)", "mean_cy": "avg((y + y + h) / 2 / 700)", "std_cx": "stddev_pop((x + x + w) / 2 / 6000)", "std_cy": "stddev_pop((y + y + h) / 2 / 700)", "mean_h": "avg(h / 700)",
    "mean_score": "avg((score + number / 100) / 2)", "sure": "avg((CASE WHEN score > 0.5 THEN 1 ELSE 0 END + CASE WHEN number / 100 > 0.5 THEN 1 ELSE 0 END) / 2)"}.items())} FROM t GROUP BY 1""")  # fmt: skip
def pose_features(t):
    box = F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    parts = t.groupBy(F.col("frame").alias("Frame")).agg(F.collect_list(F.struct(box.alias("b"), F.array(F.col("score").cast("double"), F.col("number") / 100).alias("s"))).alias("l"))
    prediction = F.struct(F.transform("l", lambda e: e["b"]).alias("bboxes"), F.transform("l", lambda e: e["s"]).alias("keypoint_scores"))
    poses = tables.pose_rows(parts.select("Frame", F.to_json(F.struct(F.array(prediction).alias("predictions"))).alias("PoseJSON")))
    out = training.pose_features(poses, 6000.0, 700.0, 22).withColumnRenamed("Frame", "frame")
    return _r(out, *[c for c in out.columns if c != "frame"], digits=9)


@query("WITH " + _T + """, r AS (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY x + w / 2, id) AS k, least(x / 6000, 1) AS a, least(y / 700, 1) AS b, least(w / 6000, 1) AS c, least(h / 700, 1) AS d FROM t),
s AS (SELECT frame, k FROM (SELECT DISTINCT frame FROM t), range(1, 7) q(k)), u AS (SELECT s.frame, s.k, unnest([0, 1, 2, 3]) AS j, unnest([a, b, c, d]) AS v FROM s LEFT JOIN r USING (frame, k))
SELECT frame, 4 * (k - 1) + j AS pos, round(coalesce(v, 0), 6) AS v FROM u""")
def player_layout(t):
    rows = training.player_layout(t, 6000.0, 700.0, 6).select("frame", F.posexplode("boxes").alias("pos", "v"))
    return _r(rows.withColumn("pos", F.col("pos").cast("long")), "v")


_CAM = ", c AS (SELECT game, frame, avg(x) AS x, avg(y) AS y, avg(w) AS w, avg(h) AS h FROM t GROUP BY 1, 2)"


def _camera(t):
    return t.groupBy("game", "frame").agg(*[F.avg(c).alias(c) for c in "xywh"])


@query("WITH " + _T + _CAM + " SELECT game, frame, " + ", ".join(f"round(lag({c}, 1, {d}) OVER o, 9) AS p{c}" for c, d in zip("xywh", "0011", strict=True)) + " FROM c WINDOW o AS (PARTITION BY game ORDER BY frame)")
def previous_target(t):
    return _r(training.previous_target(_camera(t), ("game",)).select("game", "frame", "px", "py", "pw", "ph"), "px", "py", "pw", "ph", digits=9)


@query("WITH " + _T + _CAM + " SELECT game, frame, round(least((x + w / 2) / 3000, 1), 9) AS cx, round(least((y + h / 2) / 300, 1), 9) AS cy, round(least(h / 300, 1), 9) AS height FROM c")
def camera_targets(t):
    return _r(training.center_height(_camera(t), 3000.0, 300.0), "cx", "cy", "height", digits=9)


@query("WITH " + _T + ", l AS (SELECT frame, list(id ORDER BY y, id) AS l FROM t GROUP BY 1) SELECT frame, i AS sample, l[1 + i * (len(l) - 1) // 4] AS id FROM l, range(5) q(i)")
def evenly_spaced(t):
    return training.evenly_spaced(t, 5, "y").withColumn("sample", F.col("sample").cast("long"))


@query("WITH " + _T + """, s AS (SELECT id, label, round(avg(score), 6) AS score FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM s)
SELECT id, max(label) FILTER (WHERE r = 1) AS label, max(score) AS score, string_agg(label, ',' ORDER BY r) AS labels FROM r WHERE r <= 2 GROUP BY 1 HAVING max(score) >= 0.5""")
def top_actions(t):
    scores = t.groupBy("id", "label").agg(F.round(F.avg("score"), 6).alias("score"))
    return training.top_classes(scores, 2, 0.5).withColumn("labels", F.concat_ws(",", "labels"))


@query("""WITH e AS (SELECT event_id // 1000 AS game, event_id AS pos, value AS energy FROM events), b AS (SELECT game, quantile_cont(energy, 0.6) AS bar FROM e GROUP BY 1),
k AS (SELECT game, pos, sum(CASE WHEN pos - p <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY game ORDER BY pos) AS k FROM (SELECT game, pos, lag(pos) OVER (PARTITION BY game ORDER BY pos) AS p FROM e JOIN b USING (game) WHERE energy > bar))
SELECT game, min(pos) AS "start", max(pos) AS "end" FROM k GROUP BY game, k.k HAVING max(pos) - min(pos) >= 12""")
def loud_runs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("event_id div 1000").alias("game"), F.col("event_id").alias("at"), F.col("value").alias("energy"))
    return media.loud_runs(e, 0.6, 6, 12)


_FILES = "SELECT frame // 20 AS game, row_ord AS ord, CAST(w AS INT) AS width, CAST(h AS INT) AS height, score * 60 AS fps, number * 100 AS audio_rate, id % 4 AS channels FROM t"


@query("WITH " + _T + f""", f AS ({_FILES}), s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY game ORDER BY width * height DESC, ord) = 1), m AS (SELECT game, max(fps) AS fps, max(audio_rate) AS a, max(channels) AS c FROM f GROUP BY 1)
SELECT game, width, height, round(CASE WHEN m.fps > 0 THEN m.fps ELSE 30 END, 6) AS fps, CASE WHEN a > 0 THEN a ELSE 48000 END AS audio_rate, least(greatest(c, 1), 2) AS channels FROM s JOIN m USING (game)""")
def target_profile(t):
    files = t.select(F.expr("frame div 20").alias("game"), F.col("row_ord").alias("ord"), F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"), (F.col("score") * 60).alias("fps"), (F.col("number") * 100).alias("audio_rate"), (F.col("id") % 4).alias("channels"))
    return _r(media.target_profile(files, ("game",)), "fps")


@query("WITH " + _T + ", m AS (SELECT frame, min(w) AS a, max(h) AS b FROM t GROUP BY 1) SELECT frame, round(a * b / (a + b), 6) AS rate FROM m")
def combined_rate(t):
    both = t.groupBy("frame").agg(F.array(F.min("w"), F.max("h")).alias("l")).select("frame", F.explode("l").alias("rate"))
    return _r(media.combined_rate(both, "rate", ("frame",)), "rate")


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'home' ELSE 'away' END AS side, count(*) FILTER (WHERE event_type = 'click') AS gf, count(*) FILTER (WHERE event_type = 'view') AS ga FROM events GROUP BY 1")
def goal_counts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "click", "GF").when(F.col("event_type") == "view", "GA")
    return media.goal_counts(e.select(F.when(F.col("user_id") % 2 == 0, "home").otherwise("away").alias("side"), kind.alias("kind")))


@query("WITH " + _T + """, e AS (SELECT x AS l, y AS t, x + w AS r, y + h AS b, w, h, frame, id FROM t), k AS (SELECT *, least(1, 60 / w, 90 / h) AS k FROM e)
SELECT frame, id, round(greatest(least(l, 4000), 100), 6) AS cl, round(CASE WHEN l < 100 THEN 100 WHEN r > 2000 THEN 2000 - w ELSE l END, 6) AS sl, round(CASE WHEN t < 50 THEN 50 WHEN b > 300 THEN 300 - h ELSE t END, 6) AS st,
round(w * k, 6) AS fw, round(h * k, 6) AS fh, round(greatest(w, h * 16 / 9.0), 6) AS aw, round(greatest(h, w / (16 / 9.0)), 6) AS ah FROM k""")
def box_fits(t):
    b = boxes.tlwh_to_tlbr(boxes.cols("x", "y", "w", "h"))
    edges = tuple(F.lit(v) for v in (100.0, 50.0, 2000.0, 300.0))
    moved, fit, wide = boxes.shift_into(b, edges), boxes.tlbr_to_tlwh(boxes.fit_inside(b, F.lit(60.0), F.lit(90.0))), boxes.tlbr_to_tlwh(boxes.with_aspect(b, 16 / 9))
    out = t.select("frame", "id", boxes.clamp(b[0], F.lit(100.0), F.lit(4000.0)).alias("cl"), moved[0].alias("sl"), moved[1].alias("st"), fit[2].alias("fw"), fit[3].alias("fh"), wide[2].alias("aw"), wide[3].alias("ah"))
    return _r(out, "cl", "sl", "st", "fw", "fh", "aw", "ah")


@query()
def camera_box(t):
    arena = (0.0, 0.0, 6000.0, 700.0)
    slow = movers.CameraBox(arena, movers.Limits(120.0, 12.0, brake=6, cancel=True, cooldown=4, arrive=3), aspect=16 / 9, sticky=10.0, bands=(0.1, 0.1, 0.1, 0.1))
    return movers.play(t, [movers.CameraBox(arena, movers.Limits(300.0, 60.0)), slow], scale=1.2).withColumnsRenamed({"x": "l", "y": "t"})


@query("""WITH k AS (SELECT *, sum(CASE WHEN ts < p + INTERVAL '2705 seconds' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s, count(*) AS n, round(sum(value), 6) AS total FROM k GROUP BY user_id, k.k""")
def event_sessions(spark, sf_dir):
    rows = folds.event_sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "2705 seconds", "user_id")
    return _r(rows.select("user_id", F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("last").alias("last_s"), "n", "total"), "total")


@query()
def optimal_tracker(t):
    rows = t.select("game", "frame", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.lit(0).cast("long").alias("label"), F.col("score").cast("double").alias("score"))
    return folds.padded(folds.fold(rows, folds.Associations(assignment="optimal", user_ids=True), "game"), 8)


@query()
def center_tracker(t):
    rows = t.select("game", "frame", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w") * 10).alias("x2"), (F.col("y") + F.col("h") * 5).alias("y2"), F.lit(0).cast("long").alias("label"), F.col("score").cast("double").alias("score"))
    return folds.fold(rows, folds.CenterPoints(), "game")


@query("WITH " + _OBS + """, e AS (SELECT a.game * 100 + a.id AS track, a.frame, b.number, sum(b.score * pow(0.9, a.frame - b.frame) * CASE WHEN b.number >= 10 THEN 0.61 ELSE 0.39 END) AS votes FROM o a JOIN o b ON b.game = a.game AND b.id = a.id AND b.frame BETWEEN a.frame - 30 AND a.frame GROUP BY 1, 2, 3)
SELECT track, frame, number, round(votes, 6) AS votes FROM e QUALIFY row_number() OVER (PARTITION BY track, frame ORDER BY round(votes, 9) DESC, number) = 1""")
def recent_votes(t):
    rows = _obs(t).select((F.col("game") * 100 + F.col("id")).alias("track"), "frame", "number", F.col("score").cast("double").alias("score"))
    return _r(folds.fold(rows, folds.RecentVotes(), "track"), "votes")


@query("WITH " + _T + _CAM + """, g AS (SELECT game, frame, greatest(w, h * 16 / 9.0) AS w, greatest(h, w / (16 / 9.0)) AS h, x + w / 2 AS cx, y + h / 2 AS cy FROM c), k AS (SELECT *, least(1, 4000 / w, 400 / h) AS k FROM g)
SELECT game, frame, CAST(round(round(greatest(least(cx, 4000 - w * k / 2), w * k / 2) - w * k / 2, 6)) AS INT) AS l, CAST(round(round(greatest(least(cy, 400 - h * k / 2), h * k / 2) - h * k / 2, 6)) AS INT) AS t, CAST(round(round(w * k, 6)) AS INT) AS cw, CAST(round(round(h * k, 6)) AS INT) AS ch FROM k""")
def camera_crop(t):
    return training.crop(_camera(t), 4000, 400, 16 / 9).select("game", "frame", "l", "t", "cw", "ch")
