"""Queries of the play tick, sound, identity, feedback models and stored tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from .catalog import _T, _r, query
from .functions import boxes
from .operators import frames, intervals, joins, poses, reports, sound, tiles, training
from .sources import stores
from .streaming import folds, movers

_TICK_ARENA = (0.0, 0.0, 5000.0, 700.0)
#: Of the tick's mover: speed, push, frames of braking at a change of direction, after non-stop frames and after overshooting.
_SPEED, _PUSH, _TURN, _AFTER, _OVER = 240.0, 80.0, 4, 3, 2


@query("WITH RECURSIVE " + _T + f""", d AS (SELECT game, frame, count(*) < 4 AS few, (min(x) + max(x + w)) / 2 AS dx FROM t GROUP BY 1, 2),
g AS (SELECT game, frame, id, x + w / 2 AS cx, x - lag(x) OVER (PARTITION BY game, id ORDER BY frame) AS vx FROM t),
c AS (SELECT game, frame, count(*) AS n, count(*) FILTER (WHERE vx >= 150) AS r, count(*) FILTER (WHERE vx <= -150) AS l, avg(vx) FILTER (WHERE vx >= 150) AS ar, avg(vx) FILTER (WHERE vx <= -150) AS al, max(cx) FILTER (WHERE vx >= 150) AS rx, min(cx) FILTER (WHERE vx <= -150) AS lx FROM g WHERE vx IS NOT NULL GROUP BY 1, 2),
u AS (SELECT game, frame, CASE WHEN r / n > 0.4 THEN ar ELSE al END AS rv, CASE WHEN r / n > 0.4 THEN rx ELSE lx END AS ex FROM c WHERE n >= 4 AND (r / n > 0.4 OR l / n > 0.4)),
i AS (SELECT game, frame, CASE WHEN rv IS NULL OR few THEN dx ELSE (dx + ex) / 2 END AS dx, rv, ex, row_number() OVER (PARTITION BY game ORDER BY frame) AS k FROM d LEFT JOIN u USING (game, frame)),
s AS (SELECT game, 0::BIGINT AS k, NULL::BIGINT AS frame, 2450.0::DOUBLE AS l, 2550.0::DOUBLE AS r, 0.0::DOUBLE AS v, 0 AS b, 0.0::DOUBLE AS z, 0 AS n FROM (SELECT DISTINCT game FROM i) UNION ALL
SELECT game, k, frame, greatest(least(cx - w / 2, 5000), 0), greatest(least(cx + w / 2, 5000), 0), CASE WHEN (cx - w / 2 <= 0 AND v < 0.1) OR (cx + w / 2 >= 5000 AND v > -0.1) THEN 0 ELSE v END, b, z, n FROM
 (SELECT game, k, frame, cx, w, CASE WHEN b = 1 THEN 0 ELSE v END AS v, greatest(b - 1, 0) AS b, CASE WHEN b = 1 THEN 0 ELSE z END AS z, n FROM
  (SELECT game, k, frame, cx, w, v, CASE WHEN ended THEN {_AFTER} ELSE b END AS b, CASE WHEN ended THEN -v / {_AFTER} ELSE z END AS z, n FROM
   (SELECT game, k, frame, (l + r) / 2 + v AS cx, greatest(r - l, 10) AS w, v, b, z, greatest(n - 1, 0) AS n, n = 1 AND abs(v) >= {_SPEED / 6} AS ended FROM
    (SELECT * EXCLUDE (v), greatest(least(v + greatest(least(CASE WHEN b > 0 THEN z ELSE p END, {_PUSH}), -{_PUSH}), {_SPEED}), -{_SPEED}) AS v FROM
     (SELECT * EXCLUDE (v, b, z), CASE WHEN turns AND fast THEN {_TURN} ELSE b END AS b, CASE WHEN turns AND fast THEN -v / {_TURN} ELSE z END AS z, CASE WHEN turns AND NOT fast THEN 0 ELSE v END AS v, CASE WHEN turns AND NOT fast THEN a / 4 ELSE a END AS p FROM
      (SELECT *, n = 0 AND b = 0 AND a * v < 0 AS turns, abs(v) >= {_SPEED / 6} AS fast FROM
       (SELECT * EXCLUDE (v, a), CASE WHEN e THEN 0 ELSE v END AS v, CASE WHEN e THEN 0 ELSE a END AS a FROM
        (SELECT *, (l <= 0 AND a < 0.1) OR (r >= 5000 AND a > -0.1) AS e FROM
         (SELECT game, k, frame, dx - (l + r) / 2 AS a, l, r, CASE WHEN ahead THEN greatest(least(v + greatest(least(rv * 0.3, {_PUSH * 3}), -{_PUSH * 3}), {_SPEED * 3}), -{_SPEED * 3}) ELSE v END AS v, CASE WHEN over THEN {_OVER} ELSE b END AS b, CASE WHEN over THEN -v / {_OVER} ELSE z END AS z, CASE WHEN ahead THEN 3 ELSE n END AS n FROM
          (SELECT s.game, i.k, i.frame, i.dx, i.rv, i.ex, l, r, v, b, z, n, coalesce((rv > 0 AND (l + r) / 2 < ex) OR (rv < 0 AND (l + r) / 2 > ex), false) AS ahead, rv IS NOT NULL AND NOT ((rv > 0 AND (l + r) / 2 < ex) OR (rv < 0 AND (l + r) / 2 > ex)) AS over FROM s JOIN i ON i.game = s.game AND i.k = s.k + 1))))) AS q(game, k, frame, l, r, b, z, n, e, v, a, turns, fast)) AS q2) AS q3) AS q4) AS q5) AS q6)
SELECT game, frame, round((l + r) / 2, 6) AS cx, round(r - l, 6) AS w FROM s WHERE frame IS NOT NULL""")
def play_tick(t):
    """The sideways way of one mover of fixed size that follows the frames' boxes, with breakaways."""
    cx = F.col("x") + F.col("w") / 2
    moving = t.select("game", "frame", "id", cx.alias("cx"), F.lit(0.0).alias("cy"), (F.col("x") - F.lag("x").over(W.partitionBy("game", "id").orderBy("frame"))).alias("vx")).filter("vx is not null")
    rush = frames.rushes(moving, 150.0, 0.4, 4, ("game", "frame"))
    still = movers.Limits(0.0, 0.0)
    mover = movers.CameraBox(_TICK_ARENA, movers.Limits(_SPEED, _PUSH, brake=_TURN), movers.Limits(15.0, 1.5), still, still, first=(2450.0, 300.0, 2550.0, 400.0), after_nonstop=_AFTER)
    box = frames.enclosing(t, ("game", "frame"))
    few = t.groupBy("game", "frame").agg((F.count("*") < 4).alias("few"))
    rows = box.select("game", "frame", F.col("l").alias("x"), F.col("t").alias("y"), (F.col("r") - F.col("l")).alias("w"), (F.col("b") - F.col("t")).alias("h")).join(few, ["game", "frame"]).join(rush, ["game", "frame"], "left")
    out = folds.fold(rows, movers.PlayTick((mover,), overshoot_brake=_OVER), "game")
    return _r(out.select("game", "frame", (F.col("x") + F.col("w") / 2).alias("cx"), "w"), "cx", "w")


def _sound(spark, sf_dir, size):
    """Events as samples: recordings of 1000 events each, their values in tenths less 250."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("event_id div 1000").alias("game"), (F.col("event_id") % 1000).alias("i"), (F.round(F.col("value") * 10) - 250).alias("v"))
    return rows, sound.blocks(rows, size)


_WAVE = "x AS (SELECT event_id // 1000 AS game, event_id % 1000 AS i, round(value * 10) - 250 AS v FROM events)"
_SPECTRA = _WAVE + """, n AS (SELECT game, max(i) + 1 AS n FROM x GROUP BY 1), f AS (SELECT game, unnest(range(0, n // 8 + 1)) AS frame FROM n),
s AS (SELECT f.game, frame, b, sum(x.v * (0.5 - 0.5 * cos(2 * pi() * j / 32)) * cos(2 * pi() * b * j / 32)) AS re, sum(x.v * (0.5 - 0.5 * cos(2 * pi() * j / 32)) * sin(2 * pi() * b * j / 32)) AS im
  FROM f, range(32) q(j), range(17) r(b), x WHERE x.game = f.game AND x.i = frame * 8 - 16 + j GROUP BY 1, 2, 3),
d AS (SELECT game, frame, b, 20 * log10(greatest(sqrt(re * re + im * im), 1e-5)) AS db FROM s), p AS (SELECT game, max(db) - 80 AS least FROM d GROUP BY 1),
e AS (SELECT game, frame, avg(greatest(db, least)) AS energy FROM d JOIN p USING (game) WHERE b BETWEEN 4 AND 9 GROUP BY 1, 2)"""


@query("WITH " + _SPECTRA + " SELECT game, frame, round(energy, 6) AS energy FROM e")
def band_energy(spark, sf_dir):
    """At 100 samples a second, the band from 12.5 to 28.125 Hz."""
    return _r(sound.band_energy(_sound(spark, sf_dir, 64)[1], 100.0, 12.5, 28.125, 32, 8, frames_a_task=50), "energy")


@query("WITH " + _SPECTRA + """, c AS (SELECT game, quantile_cont(energy, 0.7) AS bar FROM e GROUP BY 1), l AS (SELECT game, frame, frame - row_number() OVER (PARTITION BY game ORDER BY frame) AS k FROM e JOIN c USING (game) WHERE energy > bar)
SELECT game, round(min(frame) * 0.08::DOUBLE, 6) AS "start", round(max(frame) * 0.08::DOUBLE, 6) AS "end" FROM l GROUP BY game, k HAVING max(frame) - min(frame) >= 2""")
def whistles(spark, sf_dir):
    return _r(sound.whistles(_sound(spark, sf_dir, 100)[1], 100.0, 12.5, 28.125, 0.16, 0.7, 32, 8), "start", "end")


@query("WITH " + _WAVE + """, y AS (SELECT game, i + game % 7 - 3 AS i, v FROM x WHERE i + game % 7 - 3 >= 0), c AS (SELECT game, x.i - y.i AS lag, sum(x.v * y.v) AS v FROM x JOIN y USING (game) GROUP BY 1, 2)
SELECT game, lag, round(greatest(lag * 0.3::DOUBLE, 0), 6) AS left_offset, round(greatest(-lag * 0.3::DOUBLE, 0), 6) AS right_offset FROM c QUALIFY row_number() OVER (PARTITION BY game ORDER BY v DESC, lag) = 1""")
def sound_lag(spark, sf_dir):
    """Each recording against itself, a few samples later or earlier; 100 samples and 30 frames a second."""
    rows, left = _sound(spark, sf_dir, 128)
    moved = rows.withColumn("i", F.col("i") + F.col("game") % 7 - 3).filter("i >= 0")
    out = sound.best_lag(left, sound.blocks(moved, 128), 128, together=2)
    a, b = sound.frame_offsets(F.col("lag"), 100.0, 30.0)
    return _r(out.select("game", "lag", a.alias("left_offset"), b.alias("right_offset")), "left_offset", "right_offset")


@query("WITH RECURSIVE " + _T + """, f AS (SELECT game, frame, avg(x) / 5000 AS a, count(*) / 20.0::DOUBLE AS b, row_number() OVER (PARTITION BY game ORDER BY frame) AS k FROM t GROUP BY 1, 2),
l AS (SELECT *, lag(a) OVER (PARTITION BY game ORDER BY frame) AS pa FROM f),
r AS (SELECT game, 0::BIGINT AS k, NULL::BIGINT AS frame, 0.5::DOUBLE AS y, 0.25::DOUBLE AS z, NULL::DOUBLE AS py FROM (SELECT DISTINCT game FROM f) UNION ALL
SELECT r.game, l.k, l.frame, greatest(least(y + (greatest(least(0.2 + 0.6 * (a + coalesce(pa, a)) / 2 - 0.3 * (y + coalesce(py, y)) / 2 + 0.1 * b, 1), 0) - 0.5) * 0.2, 1), 0), greatest(least(z + (greatest(least(0.9 * z + 0.3 * b, 1), 0) - 0.5) * 0.2, 1), 0), y FROM r JOIN l ON l.game = r.game AND l.k = r.k + 1)
SELECT game, frame, round(y, 9) AS y, round(z, 9) AS z FROM r WHERE frame IS NOT NULL""")
def feedback_camera(t):
    """A linear model of two frames and its own outputs, as changes of a fifth at most."""
    f = t.groupBy("game", "frame").agg(F.array(F.avg("x") / 5000, F.count("*") / 20.0).alias("features"))

    def model(x):
        import numpy as np

        mean, last = x.mean(axis=1), x[:, -1]
        return np.clip(np.stack([0.2 + 0.6 * mean[:, 0] - 0.3 * mean[:, 2] + 0.1 * last[:, 1], 0.9 * last[:, 3] + 0.3 * last[:, 1]], 1), 0, 1)

    out = training.autoregressive(f, model, 2, 2, (0.5, 0.25), 0.1)
    return _r(out.select("game", "frame", F.col("outputs")[0].alias("y"), F.col("outputs")[1].alias("z")), "y", "z", digits=9)


@query()
def appearance_tracker(t):
    """Looks are three numbers of a track's id, so identities outlast gaps that overlap does not bridge."""
    look = F.array(*[F.sin(F.col("id") * k + 1.0) for k in (1.0, 2.0, 3.0)])
    rows = t.select("game", "frame", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.lit(0).cast("long").alias("label"), F.col("score").cast("double").alias("score"), look.alias("look"))
    return folds.fold(rows, folds.Reidentified(least=0.3), "game")


@query("""WITH j AS (SELECT event_id AS id, 'd' || (event_id % 7) AS day, CASE WHEN event_id % 3 > 0 THEN 'j' || event_id END AS job, 'f' || (event_id // 2) AS folder, event_type AS status, CASE WHEN event_id % 5 = 0 THEN event_id END AS finished FROM events WHERE event_id % 2 = 0),
u AS (SELECT event_id AS ord, CASE WHEN event_id % 4 = 1 THEN 'j' || ((event_id * 7) % 4001) END AS job, 'f' || ((event_id * 11) % 9001) AS folder, 'run' || (event_id % 9) AS status, CASE WHEN event_id % 6 = 1 THEN event_id END AS finished FROM events WHERE event_id % 2 = 1),
h AS (SELECT u.*, coalesce(a.id, b.id) AS id FROM u LEFT JOIN (SELECT job, min(id) AS id FROM j WHERE job IS NOT NULL GROUP BY 1) a USING (job) LEFT JOIN (SELECT folder, max(id) AS id FROM j GROUP BY 1) b ON b.folder = u.folder),
o AS (SELECT id, CASE WHEN id IS NULL THEN folder END AS fresh, arg_max(folder, ord) AS folder, arg_max(status, ord) AS status, arg_max(job, ord) FILTER (WHERE job IS NOT NULL) AS job, arg_max(finished, ord) FILTER (WHERE finished IS NOT NULL) AS finished FROM h GROUP BY 1, 2)
SELECT j.id, j.day, coalesce(o.job, j.job) AS job, j.folder, coalesce(o.status, j.status) AS status, coalesce(o.finished, j.finished) AS finished, o.id IS NOT NULL AS changed FROM j LEFT JOIN o ON o.id = j.id
UNION ALL SELECT (SELECT max(id) FROM j) + row_number() OVER (ORDER BY folder), NULL, job, folder, status, finished, true FROM o WHERE id IS NULL""")
def merged_jobs(spark, sf_dir):
    """Even events are jobs, odd ones updates of them by job or else by folder."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    name = lambda letter, v: F.concat(F.lit(letter), v.cast("bigint").cast("string"))
    jobs = e.filter("event_id % 2 = 0").select(i.alias("id"), name("d", i % 7).alias("day"), F.when(i % 3 > 0, name("j", i)).alias("job"), name("f", F.expr("event_id div 2")).alias("folder"), F.col("event_type").alias("status"), F.when(i % 5 == 0, i).alias("finished"))
    updates = e.filter("event_id % 2 = 1").select(i.alias("ord"), F.when(i % 4 == 1, name("j", i * 7 % 4001)).alias("job"), name("f", i * 11 % 9001).alias("folder"), name("run", i % 9).alias("status"), F.when(i % 6 == 1, i).alias("finished"))
    return stores.merged(jobs, updates, "job", "folder", "id", "ord", ("status",), ("finished",)).withColumnRenamed("_changed", "changed")


_TILES = _T + """, s AS (SELECT frame, id, CAST(floor(w * (1 + id % 9)) AS BIGINT) AS w, CAST(h * (1 + id % 6) AS BIGINT) AS h FROM t),
z AS (SELECT frame, id, CASE WHEN h > 256 THEN CAST(floor(w * 256.0::DOUBLE / greatest(1, h)) AS BIGINT) WHEN h < 128 THEN CAST(floor(greatest(1, w * 128.0::DOUBLE / greatest(1, h))) AS BIGINT) ELSE w END AS w, greatest(least(h, 256), 128) AS h FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY id) AS k FROM z), c AS (SELECT frame, max(w) AS w, greatest(max(h), CAST(floor(sqrt(sum(w * h) / (16.0::DOUBLE / 9))) AS BIGINT)) AS high, sum(w) AS total FROM z GROUP BY 1),
d AS (SELECT frame, high, CAST(least(greatest(w, CAST(floor(high * (16.0::DOUBLE / 9)) AS BIGINT)), total) AS BIGINT) AS wide FROM c),
p AS (SELECT frame, 0::BIGINT AS k, NULL::BIGINT AS id, 0::BIGINT AS l, 0::BIGINT AS t, 0::BIGINT AS x, 0::BIGINT AS r, 0::BIGINT AS h, wide FROM d UNION ALL
SELECT p.frame, k.k, k.id, CASE WHEN x + w > wide THEN 0 ELSE x END, CASE WHEN x + w > wide THEN t + r ELSE t END, CASE WHEN x + w > wide THEN 0 ELSE x END + w, CASE WHEN x + w > wide THEN k.h ELSE greatest(r, k.h) END, k.h, wide FROM p JOIN k ON k.frame = p.frame AND k.k = p.k + 1)"""


def _tiles(t):
    w, h = (F.col("w") * (1 + F.col("id") % 9)).cast("long"), (F.col("h") * (1 + F.col("id") % 6)).cast("long")
    w, h = tiles.readable_size(w, h)
    return tiles.packed(t.select("frame", "id", F.col("id").alias("ord"), w.alias("w"), h.alias("h")))


@query("WITH RECURSIVE " + _TILES + " SELECT frame, id, l, t, x AS r, t + p.h AS b, wide AS width, greatest(high, max(t + p.h) OVER (PARTITION BY frame)) AS height FROM p JOIN d USING (frame, wide) WHERE id IS NOT NULL")
def packed_tiles(t):
    return _tiles(t)


@query("WITH RECURSIVE " + _TILES + " SELECT a.frame, CAST(a.number AS VARCHAR) AS text, p.id FROM t a JOIN p ON p.frame = a.frame AND p.id IS NOT NULL AND a.x / 4 >= l AND a.x / 4 < p.x AND a.y >= p.t AND a.y < p.t + p.h")
def text_in_tiles(t):
    """Texts found at points of the packed pictures, by the tile that holds them."""
    points = t.select("frame", F.col("number").cast("string").alias("text"), (F.col("x") / 4).alias("px"), F.col("y").alias("py"))
    return reports.text_in_boxes(points, _tiles(t))


@query("WITH " + _T + ", g AS (SELECT game, max(x + w) AS max_x, max(y + h) AS max_y FROM t GROUP BY 1), a AS (SELECT max(max_x) AS x, max(max_y) AS y FROM g WHERE game % 2 = 0) SELECT game, round(max_x, 6) AS max_x, round(max_y, 6) AS max_y, max_x > x + x * 1e-6 OR max_y > y + y * 1e-6 AS beyond FROM g, a")
def game_extents(t):
    """How far each game reaches, and whether that is beyond the scale of the even ones."""
    games = frames.max_extents(t, keys=("game",))
    scale = frames.extents_over(games.filter("game % 2 = 0")).first()  # one row
    beyond = frames.beyond_scale(games, scale["max_x"], scale["max_y"]).select("game", F.lit(True).alias("beyond"))
    return _r(games.join(beyond, "game", "left").fillna(False, ["beyond"]), "max_x", "max_y")


_SCALES = """, s AS (SELECT *, frame // 10 AS batch, CASE frame % 3 WHEN 0 THEN [0.5] WHEN 1 THEN [0.5, 0.25] ELSE [0.5, 0.25, 2.0, 4.0] END::DOUBLE[] AS sc, frame % 37 = 5 AS bad FROM t),
f AS (SELECT *, CASE WHEN bool_or(bad) OVER (PARTITION BY batch) THEN NULL WHEN len(sc) = 1 THEN [sc[1], sc[1], sc[1], sc[1]] WHEN len(sc) = 2 THEN [sc[1], sc[2], sc[1], sc[2]] ELSE sc END AS f FROM s)"""


@query("WITH " + _T + _SCALES + " SELECT frame, id, round(x * coalesce(f[1], 1), 6) AS l, round(y * coalesce(f[2], 1), 6) AS t, round((x + w) * coalesce(f[3], 1), 6) AS r, round((y + h) * coalesce(f[4], 1), 6) AS b, round(w / coalesce(f[1], 1), 6) AS px, round(h / coalesce(f[2], 1), 6) AS py FROM f")
def pose_scales(t):
    """Boxes scaled for the detector and a point led back; a batch with a frame of no valid scale stays as it is."""
    n = lambda *v: F.array(*map(F.lit, v))
    scale = F.when(F.col("frame") % 37 == 5, n(0.0, 1.0)).when(F.col("frame") % 3 == 0, n(0.5)).when(F.col("frame") % 3 == 1, n(0.5, 0.25)).otherwise(n(0.5, 0.25, 2.0, 4.0))
    f = poses.detection_scales(t.select("frame").distinct().select("frame", F.expr("frame div 10").alias("batch"), scale.alias("scale")))
    rows = t.join(f.select("frame", "factors"), "frame")
    box = poses.scaled_box(boxes.tlwh_to_tlbr(boxes.cols(*"xywh")), F.col("factors"))
    point = poses.restored_points(F.array(F.array(F.col("w").cast("double"), F.col("h").cast("double"))), F.col("factors"))[0]
    return _r(rows.select("frame", "id", *[c.alias(n) for c, n in zip(box, "ltrb", strict=True)], point[0].alias("px"), point[1].alias("py")), *"ltrb", "px", "py")


@query("WITH " + _T + """, p AS (SELECT frame, id AS pose, x + 0.2 * w AS l, y + 0.1 * h AS t, x + 0.2 * w + w * 10 / 11.0 AS r, y + 0.1 * h + h * 12 / 13.0 AS b FROM t WHERE row_ord % 3 > 0),
j AS (SELECT t.game, t.frame, t.id, p.l, p.t, greatest(least(x + w, r) - greatest(x, l), 0) * greatest(least(y + h, b) - greatest(t.y, p.t), 0) AS i, w * h + (r - l) * (b - p.t) AS u, pose FROM t JOIN p USING (frame)),
m AS (SELECT * FROM j WHERE i / (u - i) >= 0.3 QUALIFY row_number() OVER (PARTITION BY frame, id ORDER BY round(i / (u - i), 9) DESC, pose) = 1),
s AS (SELECT frame // 10 AS clip, id, [count(*) / 10.0::DOUBLE, avg(l) / 5000, avg(t) / 600] AS s FROM m GROUP BY 1, 2),
c AS (SELECT *, list_max(s) AS score, list_position(s, list_max(s)) - 1 AS k FROM s)
SELECT t.frame, t.id, ['skate', 'pass', 'shoot'][k + 1] AS label, round(c.score, 6) AS score FROM t JOIN c ON c.clip = t.frame // 10 AND c.id = t.id WHERE c.score >= 0.3""")
def clip_actions(t):
    """Poses matched to tracks by overlap, a clip's poses of a track through a model, its best class on all the track's frames."""
    points = F.array(*[F.array(F.col("x") + 0.2 * F.col("w") + F.col("w") * (i * 7 % 11) / 11, F.col("y") + 0.1 * F.col("h") + F.col("h") * (i * 5 % 13) / 13) for i in range(17)])
    held = t.filter("row_ord % 3 > 0").select("frame", F.col("id").alias("pose"), points.alias("points"), F.array_repeat(F.lit(0.9), 17).alias("scores"))
    tracks = t.select("frame", "id", *[F.col(c).cast("double").alias(c) for c in "xywh"])
    clips = poses.matched(tracks, held).withColumn("clip", F.expr("frame div 10"))
    windows = poses.action_windows(clips)

    def model(batch):
        import math

        return [[len(w) / 10, math.fsum(w[:, 0]) / len(w) / 5000, math.fsum(w[:, 1]) / len(w) / 600] for w in batch]

    scored = training.with_windows(windows, "window", model, 3)
    found = scored.withColumn("a", poses.chosen_action(F.col("outputs"), ["skate", "pass", "shoot"], 2, 0.3)).filter("a is not null").select("clip", "id", "a.label", "a.score")
    return _r(poses.fan_out_actions(found, clips.select("clip", "frame", "id")).select("frame", "id", "label", "score"), "score")


@query("WITH " + _T + ", n AS (SELECT game, frame, number, row_ord FROM t WHERE number > 60) SELECT t.game, t.frame, t.id, n.number AS seen FROM t ASOF LEFT JOIN (SELECT game, frame, arg_max(number, row_ord) AS number FROM n GROUP BY 1, 2) n ON n.game = t.game AND n.frame <= t.frame")
def number_as_of(t):
    """The last number over 60 that was read in the game when a track is seen."""
    read = t.filter("number > 60").select("game", "frame", F.col("number").alias("seen"), "row_ord")
    return joins.as_of(t.select("game", "frame", "id"), read, "frame", ("seen",), 8, order="row_ord")


@query("WITH " + _T + ", i AS (SELECT game, id, frame AS s, frame + w / 4 AS e, number FROM t WHERE row_ord % 4 = 0) SELECT a.game, a.id, b.id AS id_, round(a.s::DOUBLE, 6) AS s, round(b.s::DOUBLE, 6) AS s_ FROM i a JOIN i b ON a.game = b.game AND a.number < 20 AND b.number > 80 AND a.s <= b.e AND b.s <= a.e")
def overlapping_spans(t):
    i = t.filter("row_ord % 4 = 0").select("game", "id", F.col("frame").cast("double").alias("start"), (F.col("frame") + F.col("w") / 4).alias("end"), "number")
    out = joins.overlapping(i.filter("number < 20").drop("number"), i.filter("number > 80").drop("number"), 6.0)
    return _r(out.select("game", "id", "id_", F.col("start").alias("s"), F.col("start_").alias("s_")), "s", "s_")


@query("WITH " + _T + ", k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY id) - 1 AS k FROM t) SELECT frame, k AS index, id, x AS value FROM k WHERE x > 300 AND x < 700")
def threshold_indexes(t):
    return frames.selected(t.select("frame", "id", F.col("x").alias("value")), "value", 300.0, 700.0).select("frame", "index", "id", "value")


@query("WITH " + _T + ", k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY id) - 1 AS k FROM t) SELECT frame, k AS index, id, floor(x / 50) AS value FROM k WHERE frame % 100 BETWEEN 10 AND 30 AND frame % 2 = 0 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY floor(x / 50) DESC, k) = 1")
def greatest_of_stride(t):
    """Every other frame from the 10th to the 30th of each game, its greatest value and where that stands."""
    rows = t.select("frame", "id", F.floor(F.col("x") / 50).cast("double").alias("value"), (F.col("game") * 100).alias("start"))
    return frames.extreme(frames.between(rows, 10, 30, 2, start="start"), "value", least=False)


@query("WITH RECURSIVE " + _T + """, f AS (SELECT game, frame, (frame // 10) % 2 AS label, avg(x) AS x, avg(y) AS y, max(score)::DOUBLE AS score FROM t GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY game, label ORDER BY frame) AS k FROM f),
d AS (SELECT game, label, row_number() OVER (PARTITION BY game ORDER BY min(frame)) - 1 AS id FROM f GROUP BY 1, 2),
r AS (SELECT game, label, k, frame, score, x, y FROM k WHERE k = 1 UNION ALL SELECT k.game, k.label, k.k, k.frame, k.score, r.x * 0.4::DOUBLE + k.x * 0.6::DOUBLE, r.y * 0.4::DOUBLE + k.y * 0.6::DOUBLE FROM r JOIN k ON k.game = r.game AND k.label = r.label AND k.k = r.k + 1)
SELECT game, frame, id, round(x, 6) AS x, round(y, 6) AS y, score FROM r JOIN d USING (game, label)""")
def followed_boxes(t):
    """One box a frame, of two kinds by turns that look alike: each kind is a track, which comes back when its turn does, its box following by momentum."""
    f = t.groupBy("game", "frame").agg(F.avg("x").alias("x1"), F.avg("y").alias("y1"), F.max("score").cast("double").alias("score"))
    rows = f.select("game", "frame", "x1", "y1", (F.col("x1") + 50).alias("x2"), (F.col("y1") + 50).alias("y2"), (F.expr("frame div 10") % 2).alias("label"), "score", F.array(F.lit(1.0), F.lit(2.0)).alias("look"))
    out = folds.fold(rows, folds.Reidentified(init=0.0, low=0.0), "game")
    return _r(out.select("game", "frame", "id", F.col("x1").alias("x"), F.col("y1").alias("y"), "score"), "x", "y")


@query("WITH " + _T + " SELECT game, least(12, count(DISTINCT frame)) AS n, true AS unbroken FROM t GROUP BY 1")
def subsequence_runs(t):
    """Each game's random subsequence has the length asked for and leaves out no frame that the game has inside it."""
    every = t.groupBy("game", "frame").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("game").orderBy("frame"))
    cut = intervals.subsequence(every.withColumn("place", place), 12, 5)
    return cut.groupBy("game").agg(F.count("*").alias("n"), (F.max("place") - F.min("place") + 1 == F.count("*")).alias("unbroken"))
