"""Queries of sources, stored records, alignment, lists and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from .catalog import ORACLE_SQL, _INTERVALS, _T, _obs, _r, _starts, query
from .functions import text
from .operators import intervals, jerseys, poses, reports
from .sources import alignment, records, tables


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _samples(t):
    """A frame's tracks as arrays side by side; the mask leaves out every fifth id."""
    entry = F.struct("id", F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("b"), F.col("score").cast("double").alias("s"), F.length("label").cast("long").alias("l"))
    g = t.groupBy("frame").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    field = lambda f: F.transform("e", lambda v: v[f])
    return g.select("frame", field("id").alias("ids"), field("b").alias("bboxes"), field("s").alias("scores"), field("l").alias("labels"), F.transform("e", lambda v: v["id"] % 5 != 0).alias("mask"), F.size("e").alias("n"))


@query("WITH " + _T + """, k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY id) AS k, count(*) OVER (PARTITION BY frame) AS n FROM t)
SELECT frame AS "Frame", round(x, 6) AS "BBox_X1", round(y, 6) AS "BBox_Y1", round(x + w, 6) AS "BBox_X2", round(y + h, 6) AS "BBox_Y2", CAST(CASE frame % 3 WHEN 0 THEN score WHEN 1 THEN 0.5 ELSE 1 END AS DOUBLE) AS "Scores", CASE WHEN frame % 2 = 0 THEN length(label) ELSE 0 END AS "Labels" FROM k WHERE k <= 6""")
def detection_records(t):
    """Arrays are trimmed to 6; a frame has all scores, one, or too many; every other frame lacks labels."""
    s = _samples(t)
    cut = {c: records.trimmed(F.col(c), F.lit(6)) for c in ("bboxes", "labels")}
    scores = F.when(F.col("frame") % 3 == 0, records.trimmed(F.col("scores"), F.lit(6))).when(F.col("frame") % 3 == 1, F.array(F.lit(0.5))).otherwise(F.array_repeat(F.lit(0.1), 99))
    out = records.detection_records(s.withColumns(cut | {"scores": scores}).withColumn("labels", F.when(F.col("frame") % 2 == 0, F.col("labels"))))
    return _r(out, "BBox_X1", "BBox_Y1", "BBox_X2", "BBox_Y2")


@query("WITH " + _T + """ SELECT frame AS "Frame", id AS "ID", round(x, 6) AS "BBox_X", round(y, 6) AS "BBox_Y", round(w, 6) AS "BBox_W", round(h, 6) AS "BBox_H", CAST(score AS DOUBLE) AS "Scores", length(label) AS "Labels", -1 AS "Visibility",
CASE WHEN number > 50 THEN '{"tracking_id":' || id || ',"number":' || number || ',"score":0.5}' ELSE '{}' END AS "JerseyInfo", CASE WHEN id % 3 = 0 THEN label ELSE '' END AS "ActionLabel", CASE WHEN id % 3 = 0 THEN 0.75 ELSE 0.0 END AS "ActionScore", CASE WHEN id % 3 = 0 THEN 2 ELSE -1 END AS "ActionIndex" FROM t WHERE id % 5 <> 0""")
def tracking_records(t):
    jersey = lambda n, o: t.filter("number > 50").select("frame", F.col("id").alias("tracking_id"), (F.col("number") - n).alias("number"), F.lit(0.5).alias("score"), F.lit(o).alias("ord"))
    action = t.filter("id % 3 = 0").select("frame", F.col("id").alias("tracking_id"), "label", F.lit(0.75).alias("score"), F.lit(2).cast("long").alias("label_index"))
    hidden = t.select("frame", F.lit(-1).cast("long").alias("tracking_id"), "label", F.lit(0.9).alias("score"), F.lit(1).cast("long").alias("label_index"))
    out = records.tracking_records(_samples(t), jersey(1, 1).unionByName(jersey(0, 2)), action.unionByName(hidden))
    return _r(out, "BBox_X", "BBox_Y", "BBox_W", "BBox_H")


@query("WITH " + _T + """, f AS (SELECT frame, max(row_ord) AS m, count(*) AS n FROM t GROUP BY 1) SELECT frame AS "Frame", CASE WHEN m % 2 = 0 THEN '{"predictions":[{"labels":[' || n || ']}]}' ELSE '{"predictions":[]}' END AS "PoseJSON" FROM f""")
def pose_records(t):
    f = t.groupBy("frame").agg(F.max("row_ord").alias("m"), F.count("*").alias("n"))
    return records.pose_records(f.select("frame", F.when(F.col("m") % 2 == 0, F.array(F.struct(F.array("n").alias("labels")))).alias("predictions")))


@query("WITH " + _T + """, f AS (SELECT frame, string_agg('{"tracking_id":' || id || ',"label":"' || label || '"}', ',' ORDER BY id) FILTER (WHERE number > 60) AS l FROM t GROUP BY 1) SELECT frame AS "Frame", '[' || coalesce(l, '') || ']' AS "ActionJSON" FROM f""")
def action_records(t):
    entry = F.when(F.col("number") > 60, F.struct(F.col("id").alias("tracking_id"), "label"))
    return records.action_records(t.groupBy("frame").agg(F.array_sort(F.collect_list(entry)).alias("actions")))


@query("WITH " + _T + """ SELECT frame AS "Frame", round(min(x), 6) AS "BBox_X", round(min(y), 6) AS "BBox_Y", round(max(x + w) - min(x), 6) AS "BBox_W", round(max(y + h) - min(y), 6) AS "BBox_H" FROM t GROUP BY 1""")
def camera_records(t):
    box = F.array(F.min("x"), F.min("y"), F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h")))
    return _r(records.camera_records(t.groupBy("frame").agg(box.alias("box"))), "BBox_X", "BBox_Y", "BBox_W", "BBox_H")


@query("WITH " + _T + """ SELECT frame, id AS value FROM (SELECT min(frame) + k - 1 AS frame, l[k] AS id FROM (SELECT min(frame) AS frame, list(id ORDER BY frame, id) AS l FROM t GROUP BY frame // 4), range(1, 5) q(k) WHERE k <= len(l) GROUP BY frame, k, l)""")
def batch_records(t):
    g = t.groupBy(F.expr("frame div 4")).agg(F.min("frame").alias("frame"), F.array_sort(F.collect_list(F.struct("frame", "id"))).alias("l"))
    return records.batch_records(g.select("frame", F.transform("l", lambda s: s["id"]).alias("values")), F.lit(4))


_STORED = ", s AS (SELECT * FROM t WHERE frame % 3 > 0 AND row_ord % 2 = 0), f AS (SELECT DISTINCT frame, frame // 8 AS batch FROM t)"


def _stored(t):
    s = t.filter("frame % 3 > 0 and row_ord % 2 = 0")
    frames = t.select("frame", F.expr("frame div 8").alias("batch")).distinct()
    return frames, s.select(F.col("frame").alias("Frame"), F.col("id").alias("ID"), *[F.col(c).alias(f"BBox_{c.upper()}") for c in "xywh"], "score", "label")


@query("WITH " + _T + _STORED + ", c AS (SELECT f.batch, f.frame, count(id) AS n, coalesce(string_agg(id || ':' || CAST(round(x, 0) AS INT), ',' ORDER BY id), '') AS tracks, max(id) AS m FROM f LEFT JOIN s USING (frame) GROUP BY 1, 2) SELECT batch, frame, n, tracks, max(n) OVER (PARTITION BY batch) AS nr_tracks, coalesce(max(m) OVER (PARTITION BY batch), 0) AS max_tracking_id FROM c")
def attach_tracks(t):
    frames, s = _stored(t)
    out = records.attach_tracks(frames, s)
    return out.withColumn("tracks", F.array_join(F.transform("tracks", lambda e: F.concat(e["id"].cast("string"), F.lit(":"), F.round(e["box"][0], 0).cast("int").cast("string"))), ","))


@query("WITH " + _T + _STORED + " SELECT f.frame, count(id) AS n, round(coalesce(sum(x + w), 0), 6) AS total FROM f LEFT JOIN s USING (frame) GROUP BY 1")
def attach_detections(t):
    frames, s = _stored(t)
    d = s.select("Frame", F.col("BBox_X").alias("BBox_X1"), F.col("BBox_Y").alias("BBox_Y1"), (F.col("BBox_X") + F.col("BBox_W")).alias("BBox_X2"), (F.col("BBox_Y") + F.col("BBox_H")).alias("BBox_Y2"), F.col("score").alias("Scores"), F.col("label").alias("Labels"))
    out = records.attach_detections(frames.select("frame"), d)
    return _r(out.select("frame", F.size("detections").alias("n"), F.aggregate("detections", F.lit(0.0), lambda a, e: a + e["box"][2]).alias("total")), "total")


@query("WITH " + _T + _STORED + """ SELECT f.frame, CASE WHEN count(id) > 0 THEN '{"n":' || count(id) || '}' ELSE '{"predictions":[]}' END AS "PoseJSON" FROM f LEFT JOIN s USING (frame) GROUP BY 1""")
def attach_poses(t):
    frames, s = _stored(t)
    return records.attach_poses(frames.select("frame"), s.groupBy("Frame").agg(F.concat(F.lit('{"n":'), F.count("*").cast("string"), F.lit("}")).alias("PoseJSON")))


@query("WITH " + _T + _STORED + ", c AS (SELECT frame, avg(x) AS a, CASE WHEN frame % 2 = 0 THEN min(x) END AS b FROM t GROUP BY 1), m AS (SELECT batch, min(frame) AS frame FROM f GROUP BY 1) SELECT batch, frame, round(a, 6) AS slow_x, round(coalesce(b, a), 6) AS fast_x FROM m LEFT JOIN c USING (frame)")
def attach_camera(t):
    box = lambda f: [f(c).alias(f"BBox_{c.upper()}") for c in "xywh"]
    slow = t.groupBy(F.col("frame").alias("Frame")).agg(*box(F.avg))
    fast = t.filter("frame % 2 = 0").groupBy(F.col("frame").alias("Frame")).agg(*box(F.min))
    frames, _ = _stored(t)
    out = records.attach_camera(frames, slow, fast)
    return _r(out.select("batch", "frame", F.col("slow")[0].alias("slow_x"), F.col("fast")[0].alias("fast_x")), "slow_x", "fast_x")


_FILES = ", v AS (SELECT game, id AS ord, 'f' || id AS file, 3 + max(number) % 9 AS n FROM t GROUP BY 1, 2)"


@query("WITH " + _T + _FILES + ", a AS (SELECT game, file, ord, unnest(range(1, n + 1)) AS p FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY ord, p) AS k FROM a) SELECT game, (k - 3) // 2 + 1 AS frame, file, p AS \"at\" FROM k WHERE k >= 3 AND (k - 3) % 2 = 0 AND (k - 3) // 2 + 1 <= 40")
def video_frames(t):
    files = t.groupBy("game", F.col("id").alias("ord")).agg((3 + F.max("number") % 9).alias("n_frames")).withColumn("file", F.concat(F.lit("f"), F.col("ord").cast("string")))
    return alignment.video_frames(files, 2, start=3, most=40)


@query("WITH " + _T + ", f AS (SELECT game, frame, count(*) AS n, max(id) AS m FROM t GROUP BY 1, 2), a AS (SELECT game, n, row_number() OVER (PARTITION BY game ORDER BY frame) - 1 AS step FROM f WHERE frame % 3 > 0), b AS (SELECT game, m, row_number() OVER (PARTITION BY game ORDER BY frame) - 1 AS step FROM f WHERE frame % 2 = 0) SELECT game, step, n, m FROM a JOIN b USING (game, step)")
def lock_step(t):
    f = t.groupBy("game", "frame").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    return alignment.lock_step({"n": f.filter("frame % 3 > 0").withColumnRenamed("n", "value"), "m": f.filter("frame % 2 = 0").withColumnRenamed("m", "value")})


@query("WITH " + _T + """, f AS (SELECT DISTINCT game, frame FROM t), g AS (SELECT game, min(frame) + 2 AS ls, min(frame) + 1 AS rs, CASE WHEN game % 2 = 0 THEN 2 ELSE 1 END AS st FROM f GROUP BY 1),
a AS (SELECT game, frame AS "left", row_number() OVER (PARTITION BY game ORDER BY frame) - 1 AS step FROM f JOIN g USING (game) WHERE frame >= ls AND (frame - ls) % st = 0), b AS (SELECT game, frame AS "right", row_number() OVER (PARTITION BY game ORDER BY frame) - 1 AS step FROM f JOIN g USING (game) WHERE frame >= rs) SELECT game, step, "left", "right" FROM a JOIN b USING (game, step)""")
def align_rates(t):
    f = t.select("game", "frame").distinct()
    fps = F.when(F.col("game") % 2 == 0, 59.94).otherwise(29.97)
    rates = f.groupBy("game").agg((F.min("frame") + 2).alias("left_start"), (F.min("frame") + 1).alias("right_start")).withColumns({"left_fps": fps, "right_fps": F.lit(29.97)})
    return alignment.align_rates(f, f, rates)


@query("""WITH e AS (SELECT event_id AS e, user_id % 4 AS k, 'g' || (event_id // 40) AS g FROM events),
p AS (SELECT e, g, k, (e // 40) % 2 = 0 AS cams, lpad(CAST(e % 7 AS VARCHAR), 2, '0') AS ch, lpad(CAST(e % 5 AS VARCHAR), 4, '0') AS vid FROM e),
f AS (SELECT e, g, CASE WHEN cams AND k < 2 THEN 'cam' || (k + 1) END AS cam, CASE WHEN k = 1 THEN 'left' END AS lr, vid, CAST(ch AS INT) AS ch, CASE WHEN cams AND k < 2 THEN g || '/cam' || (k + 1) ELSE g END || '/' || CASE WHEN k = 1 THEN 'left-' || e || '.mp4' WHEN k = 3 THEN 'notes.txt' ELSE 'GX' || ch || vid || '.MP4' END AS path, cams, k FROM p),
v AS (SELECT * FROM f WHERE k <> 3 AND (NOT cams OR cam IS NOT NULL)), d AS (SELECT DISTINCT g, cam, lr, vid, ch, path, e FROM v)
SELECT g AS game, coalesce(cam, CASE WHEN lr IS NULL THEN CAST(CAST(vid AS INT) AS VARCHAR) END, lr) AS camera, CAST(CASE WHEN cam IS NOT NULL THEN row_number() OVER (PARTITION BY g, cam ORDER BY CASE WHEN lr IS NULL THEN vid ELSE '' END, CASE WHEN lr IS NULL THEN ch ELSE e END, path) WHEN lr IS NOT NULL THEN e ELSE ch END AS INT) AS chapter, path FROM d""")
def video_chapters(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_id").alias("e"), (F.col("user_id") % 4).alias("k"))
    g = F.concat(F.lit("g"), F.expr("e div 40").cast("string"))
    cams = F.expr("(e div 40) % 2 = 0")
    ch, vid = F.lpad((F.col("e") % 7).cast("string"), 2, "0"), F.lpad((F.col("e") % 5).cast("string"), 4, "0")
    name = F.when(F.col("k") == 1, F.concat(F.lit("left-"), F.col("e").cast("string"), F.lit(".mp4"))).when(F.col("k") == 3, "notes.txt").otherwise(F.concat(F.lit("GX"), ch, vid, F.lit(".MP4")))
    folder = F.when(cams & (F.col("k") < 2), F.concat(g, F.lit("/cam"), (F.col("k") + 1).cast("string"))).otherwise(g)
    return alignment.chapters(e.select(F.concat(folder, F.lit("/"), name).alias("path")))


@query("""SELECT event_id, value AS duration, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1920 + user_id END AS width, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 30000 / 1001.0 ELSE 25.0 END AS fps, CASE WHEN event_id % 5 > 0 THEN 'yuv420p' END AS pixels, 48000 AS sample_rate, user_id % 3 AS channels FROM events""")
def probed_files(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    video = F.concat(F.lit('{"codec_type":"video","width":'), (F.col("user_id") + 1920).cast("string"), F.lit(',"height":1080,"avg_frame_rate":"'), F.when(F.col("event_id") % 2 == 0, "30000/1001").otherwise(""), F.lit('","r_frame_rate":"25/1"},'))
    audio = F.concat(F.lit('{"codec_type":"audio","sample_rate":"48000","channels":'), (F.col("user_id") % 3).cast("string"), F.lit("}"))
    probe = F.concat(F.lit('{"format":{"duration":"'), s("value"), F.lit('"},"streams":['), F.when(F.col("event_id") % 5 == 0, "").otherwise(video), audio, F.lit("]}"))
    out = alignment.probed(_events(spark, sf_dir).select("event_id", probe.alias("probe")), keys=("event_id",))
    return out.drop("height")


@query("""WITH l AS (SELECT user_id AS folder, event_id AS at, event_type = 'click' AS changed, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type <> 'view')
SELECT 'd' || folder AS folder FROM l WHERE k <= 2 GROUP BY l.folder HAVING count(*) = 2 AND count(DISTINCT changed) = 1""")
def ready_folders(spark, sf_dir):
    e = _events(spark, sf_dir)
    name = F.when(F.col("event_type") == "view", "other.txt").otherwise("done.txt")
    rows = e.select(F.col("event_id").alias("at"), F.concat(F.lit("root/d"), F.col("user_id").cast("string"), F.lit("/"), name).alias("path"), F.when(F.col("event_type") == "click", 5).otherwise(6).alias("size"), F.lit(1).alias("modified"))
    return alignment.ready_folders(rows, "done.txt", 2)


@query("SELECT DISTINCT user_id AS number, 'model_' || user_id || '.pt' AS name FROM events WHERE user_id % 3 > 0")
def numbered_files(spark, sf_dir):
    k = F.col("user_id").cast("string")
    name = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("model_"), k, F.lit(".pt"))).otherwise(F.concat(F.lit("model_x"), k, F.lit(".pt")))
    return alignment.numbered(_events(spark, sf_dir).select(name.alias("name")).distinct(), "model", "pt")


@query("WITH " + _T + " SELECT row_ord, CASE WHEN id > 2 THEN printf('%d,%d,%.6f,%.6f,%.6f,%.6f,%.6f,-1,-1,-1', frame, id, x, y, w, h, score) END AS mot, CASE WHEN id > 2 THEN printf('%d %d pedestrian 0 0 -10 %.6f %.6f %.6f %.6f -10 -10 -10 -1000 -1000 -1000 -10', frame - 1, id, x, y, x + w, y + h) END AS kitti FROM t")
def text_lines(t):
    rows = t.withColumn("id_", F.when(F.col("id") > 2, F.col("id")).otherwise(-1)).withColumn("score", F.col("score").cast("double"))
    rows = rows.drop("id").withColumnRenamed("id_", "id")
    return rows.select("row_ord", tables.mot_line().alias("mot"), tables.kitti_line().alias("kitti"))


@query("WITH q AS (" + ORACLE_SQL["shift_intervals"] + """), s AS (SELECT *, greatest(start - 3, 0) AS a, CASE WHEN duration >= 0 THEN start + duration END AS b FROM q)
SELECT game, number, shift, printf('00:%02d:%02d', CAST(floor(a / 60) AS INT), CAST(round_even(a - floor(a / 60) * 60, 0) AS INT)) || '    ' || coalesce(printf('00:%02d:%02d', CAST(floor(b / 60) AS INT), CAST(round_even(b - floor(b / 60) * 60, 0) AS INT)), '') AS line FROM s""")
def highlights(t):
    starts = _starts(t)
    seconds = lambda d: d.withColumn("start", (F.col("start") - 1 - 100 * F.col("game")) / 20.0)
    seen = intervals.assign_intervals(t.select("game", "frame", "id"), starts, game=("game",)).join(starts.withColumn("interval", F.row_number().over(W.partitionBy("game").orderBy("start"))), ["game", "interval"])
    seen = seen.join(_obs(t).select("game", "frame", "id", "number"), ["game", "frame", "id"])
    return reports.highlights(jerseys.shifts(seconds(seen.select("game", "start", "number")), seconds(starts))).withColumn("shift", F.col("shift").cast("int"))


@query("WITH " + _INTERVALS + ", d AS (SELECT DISTINCT game, interval, id FROM a) SELECT game, interval, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM d GROUP BY 1, 2")
def ids_of_intervals(t):
    out = reports.ids_of_intervals(intervals.assign_intervals(t.select("game", "frame", "id"), _starts(t), game=("game",)))
    return out.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query("SELECT c_name AS player, CAST(c_nationkey AS VARCHAR) AS nation, coalesce(c_mktsegment, '') AS segment, 'home' AS side FROM customer UNION ALL SELECT s_name, CAST(s_nationkey AS VARCHAR), '', 'away' FROM supplier")
def combined_stats(spark, sf_dir):
    c, s = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "supplier"))
    home = c.select(F.col("c_name").alias("player"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    away = s.select(F.col("s_nationkey").cast("string").alias("nation"), F.col("s_name").alias("player"), F.lit("x").alias("other"))
    return reports.combined_stats({"home": home, "away": away}, "home")


@query("WITH e AS (SELECT event_id, event_type || user_id % 9 AS line FROM events WHERE user_id % 11 > 1) SELECT line, min(event_id) AS ord FROM e GROUP BY 1")
def first_of_lines(spark, sf_dir):
    k = F.col("user_id") % 11
    line = F.when(k == 0, "  # comment").when(k == 1, "  ").otherwise(F.concat(F.lit(" "), "event_type", (F.col("user_id") % 9).cast("string"), F.lit(" ")))
    return reports.first_of_lines(_events(spark, sf_dir).select(F.col("event_id").alias("ord"), line.alias("line")))


_CLOCK = "(event_id % 3) || ':' || (event_id % 60) || ':' || (user_id % 60)"


@query(f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 3) * 3600 + (event_id % 60) * 60 + user_id % 60 END AS seconds, CAST(floor(((event_id % 3) * 3600 + (event_id % 60) * 60 + user_id % 60 + 0.25) * 29.97) AS BIGINT) AS frame, (event_id % 5) * 60 + user_id % 30 BETWEEN 60 AND 90 OR (event_id % 5) * 60 + user_id % 30 BETWEEN 120 AND 125 AS muted, CASE WHEN user_id * 97 >= 3600 THEN printf('%d:%02d:%02d', user_id * 97 // 3600, user_id * 97 // 60 % 60, user_id * 97 % 60) ELSE printf('%02d:%02d', user_id * 97 // 60, user_id * 97 % 60) END AS shown FROM events")
def clocks(spark, sf_dir):
    clock = F.concat_ws(":", F.col("event_id") % 3, F.col("event_id") % 60, F.col("user_id") % 60)
    at = (F.col("event_id") % 5) * 60 + F.col("user_id") % 30
    return _events(spark, sf_dir).select(
        "event_id", text.parse_clock(F.when(F.col("event_id") % 7 == 0, F.concat(clock, F.lit(".5"))).otherwise(clock)).alias("seconds"), text.time_frame(F.concat(clock, F.lit(".25")), 29.97).alias("frame"),
        text.in_intervals(at, text.parse_intervals(F.lit("1:00-1:30,2:00-125"))).alias("muted"), text.clock_of(F.col("user_id") * 97).alias("shown"),
    )


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS BIGINT) END AS id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '/s/' || user_id WHEN 2 THEN 'c:/s/' || user_id ELSE '/x' END AS path, CASE event_id % 4 WHEN 0 THEN 'HOME' WHEN 1 THEN 'AWAY' END AS side, CASE event_id % 4 WHEN 0 THEN 'r:2' END AS label,
CASE event_id % 4 WHEN 0 THEN 'a=2' WHEN 1 THEN 'k=' || user_id || ',z=9' WHEN 2 THEN '' ELSE 'q=1' END AS meta FROM events""")
def game_lines(spark, sf_dir):
    u = F.col("user_id").cast("string")
    kinds = [F.concat(F.lit("T2S = "), u, F.lit(":home:r:2|a=1|a=2|bad|=x")), F.concat(F.lit(" /s/"), u, F.lit(":away:k="), u, F.lit("|z=9 ")), F.concat(F.lit("c:/s/"), u), F.lit("/x|q=1|")]
    line = F.element_at(F.array(*kinds), (F.col("event_id") % 4 + 1).cast("int"))
    g = text.game_line(line)
    meta = F.array_join(F.transform(F.map_entries(g["metadata"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return _events(spark, sf_dir).select("event_id", g["id"].alias("id"), g["path"].alias("path"), g["side"].alias("side"), g["label"].alias("label"), meta.alias("meta"))


@query("""SELECT event_id, 'd/' || CASE WHEN event_id % 3 = 0 THEN 'g_' || user_id || '.csv' ELSE 'g_' || 'f' || user_id || '.csv' END AS named, 'd/f' || user_id || '_x.csv' AS suffixed, 'a_b_' || user_id AS safe, CAST(user_id AS DOUBLE) AS x, value AS y, least(100, greatest(user_id - 20, 0) + 9) AS last FROM events""")
def names_and_tokens(spark, sf_dir):
    u = F.col("user_id").cast("string")
    name = F.concat(F.lit("d/"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("g_"), u)).otherwise(F.concat(F.lit("f"), u)), F.lit(".csv"))
    m = text.token_map(F.concat(F.lit("c n0 N1 x"), u, F.lit(" y0  y"), F.col("value").cast("string"), F.lit(" X3")))
    first, last = text.interval_frames(F.lit(101), F.lit(10.0), F.lit("0:09"), F.lit("0:01"), F.col("user_id") - 20, F.lit(10))
    return _events(spark, sf_dir).select("event_id", text.with_prefix(name, F.lit("g")).alias("named"), text.with_suffix(F.concat(F.lit("d/f"), u, F.lit(".csv")), F.lit("_x")).alias("suffixed"), text.file_safe(F.concat(F.lit(" a/\\b\\"), u)).alias("safe"), m["x"].cast("double").alias("x"), m["y"].cast("double").alias("y"), last.alias("last"))


@query("""WITH e AS (SELECT user_id % 4 AS d, event_type AS a, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CASE event_type WHEN 'click' THEN 'view' ELSE 'click' END END AS b, value / 1000 AS c FROM events),
r AS (SELECT 'd' || d AS dataset, count(*) AS n, 100 * avg(CAST(a = b AS DOUBLE)) AS accuracy, 100 * avg(1 - levenshtein(a, b) / greatest(length(a), length(b))) AS ned, 100 * avg(c) AS confidence, avg(length(b)) AS length FROM e GROUP BY d)
SELECT dataset, n, round(accuracy, 6) AS accuracy, round(ned, 6) AS ned, round(confidence, 6) AS confidence, round(length, 6) AS length FROM r UNION ALL
SELECT 'Combined', sum(n), round(sum(accuracy * n) / sum(n), 6), round(sum(ned * n) / sum(n), 6), round(sum(confidence * n) / sum(n), 6), round(sum(length * n) / sum(n), 6) FROM r""")
def label_accuracy(spark, sf_dir):
    b = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.when(F.col("event_type") == "click", "view").otherwise("click"))
    rows = _events(spark, sf_dir).select(F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")).alias("dataset"), F.col("event_type").alias("truth"), b.alias("predicted"), (F.col("value") / 1000).alias("confidence"))
    return _r(reports.label_accuracy(rows), "accuracy", "ned", "confidence", "length")


@query("WITH a AS (SELECT c_custkey AS key, c_nationkey AS value FROM customer), b AS (SELECT c_custkey AS key, c_nationkey + (c_custkey % 5 = 0)::INT AS value FROM customer WHERE c_custkey % 7 > 0) SELECT a.key FROM a LEFT JOIN b USING (key) WHERE b.key IS NULL OR a.value IS DISTINCT FROM b.value")
def changed_keys(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("value"))
    return reports.changed_keys(c, c.filter("key % 7 > 0").withColumn("value", F.col("value") + F.when(F.col("key") % 5 == 0, 1).otherwise(0)))


@query("WITH a AS (SELECT 0 AS k, 'c' AS store, c_custkey AS key, c_custkey % 50 AS width, 40 AS height FROM customer UNION ALL SELECT 1, 's', s_suppkey, 30, s_suppkey % 50 FROM supplier) SELECT row_number() OVER (ORDER BY k, key) AS number, store, key, width, height FROM a WHERE width >= 20 AND height >= 20")
def kept_and_renumbered(spark, sf_dir):
    c, s = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "supplier"))
    return reports.kept_and_renumbered({"c": c.select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 50).alias("width"), F.lit(40).alias("height")), "s": s.select(F.col("s_suppkey").alias("key"), F.lit(30).alias("width"), (F.col("s_suppkey") % 50).alias("height"))}, 20)


@query("WITH " + _T + """ SELECT 'skate_' || frame AS sequence, 'skate' AS action, string_agg(id || ':' || CAST(round(least(x, 1999), 0) AS INT) || ':' || CAST(round(least(y, 299), 0) AS INT), ',' ORDER BY id) AS frames FROM t WHERE id % 4 > 0 GROUP BY frame""")
def sequence_frames(t):
    s = lambda c: F.col(c).cast("string")
    name = F.when(F.col("id") % 4 > 0, F.concat(F.lit("skate_"), s("frame"), F.lit("_"), s("id"), F.lit(".jpg"))).otherwise(F.concat(s("id"), F.lit(".jpg")))
    out = reports.sequence_frames(t.select(name.alias("name"), F.array(F.array("x", "y")).alias("points")), 2000, 300)
    show = lambda v: F.round(v, 0).cast("int").cast("string")
    return out.withColumn("frames", F.array_join(F.transform("frames", lambda f: F.concat_ws(":", f["frame"].cast("string"), show(f["points"][0][0]), show(f["points"][0][1]))), ","))


@query("SELECT user_id, count(*) // 4 * k AS cut, k FROM events, range(1, 4) q(k) GROUP BY user_id, k")
def split_points(spark, sf_dir):
    n = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.posexplode(reports.split_points(F.col("n"), 4)).alias("k", "cut")).withColumn("k", F.col("k").cast("long") + 1)


@query("WITH " + _T + " SELECT id, count(*) AS n, 'low' AS variant FROM t WHERE score > 0.2 GROUP BY 1 UNION ALL SELECT id, count(*), 'high' FROM t WHERE score > 0.7 GROUP BY 1")
def variants(t):
    return reports.with_variants(lambda s: t.filter(F.col("score") > s["least"]).groupBy("id").agg(F.count("*").alias("n")), {"low": {"least": 0.2}, "high": {"least": 0.7}})


@query("SELECT n_name, CASE WHEN length(replace('é ' || n_name, ' ', '')) <= 9 THEN regexp_replace(lower('e' || n_name), '[^a-z]', '', 'g') END AS label FROM nation")
def normal_labels(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select("n_name", text.normal_label(F.concat(F.lit("é "), "n_name"), "abcdefghijklmnopqrstuvwxyz", 9).alias("label"))


@query("WITH " + _T + ", a AS (SELECT frame, avg(x) AS c FROM t GROUP BY 1) SELECT frame, round(c, 6) AS check, round(CASE WHEN frame % 5 = 0 THEN c + 1 WHEN frame % 7 = 0 THEN NULL END, 6) AS expected FROM a WHERE frame % 5 = 0 OR frame % 7 = 0")
def frame_checks(t):
    a = reports.frame_values(t, "x")
    b = a.filter("frame % 7 <> 0 or frame % 5 = 0").withColumn("check", F.col("check") + F.when(F.col("frame") % 5 == 0, 1.0).otherwise(1e-9))
    return _r(reports.differing(a, b), "check", "expected")


@query("WITH " + _T + ", a AS (SELECT frame, id % 3 AS channel, min(number) AS lo, max(number) AS hi, avg(number) AS m, max(id) AS i FROM t GROUP BY 1, 2), b AS (SELECT frame, id % 3 AS channel, min(number) AS lo, max(number) AS hi, avg(number) AS m FROM t WHERE id <> 7 GROUP BY 1, 2) SELECT frame, channel, a.lo <> b.lo OR a.hi <> b.hi OR abs(a.m - b.m) > 0.001 + 0.00001 * abs(b.m) AS changed FROM a JOIN b USING (frame, channel)")
def color_checks(t):
    stats = lambda d: reports.color_stats(d.select("frame", (F.col("id") % 3).alias("channel"), F.col("number").alias("value")))
    return reports.changed_stats(stats(t), stats(t.filter("id <> 7")))


@query("WITH s AS (SELECT event_type AS name, sum(value) AS s FROM events GROUP BY 1) SELECT name, round(100 * s / (SELECT sum(value) FROM events), 6) AS share FROM s WHERE 100 * s / (SELECT sum(value) FROM events) >= 15")
def time_shares(spark, sf_dir):
    return _r(reports.time_shares(_events(spark, sf_dir).select(F.col("event_type").alias("name"), F.col("value").alias("seconds")), least=15.0), "share")


@query("WITH " + _T + ", a AS (SELECT frame // 10 AS clip, id, max(label) AS label FROM t WHERE number > 50 GROUP BY 1, 2) SELECT t.frame, t.id, a.label FROM t JOIN a ON a.clip = t.frame // 10 AND a.id = t.id")
def fan_out_actions(t):
    clip = F.expr("frame div 10")
    found = t.filter("number > 50").groupBy(clip.alias("clip"), "id").agg(F.max("label").alias("label"))
    return poses.fan_out_actions(found, t.select(clip.alias("clip"), "frame", "id")).select("frame", "id", "label")


@query("WITH " + _T + """, c AS (SELECT frame, min(x) AS x, min(y) AS y, max(w) AS w, max(h) AS h FROM t GROUP BY 1) SELECT frame AS "Frame", CASE WHEN frame % 3 = 0 THEN round(x, 6) ELSE -1 END AS "BBox_X", CASE WHEN frame % 3 = 0 THEN round(y, 6) ELSE -1 END AS "BBox_Y", CAST(CASE WHEN frame % 3 = 0 THEN w ELSE -1 END AS DOUBLE) AS "BBox_W", CAST(CASE WHEN frame % 3 = 0 THEN h ELSE -1 END AS DOUBLE) AS "BBox_H" FROM c""")
def camera_baseline(t):
    """Every third frame is annotated."""
    done = t.filter("frame % 3 = 0").groupBy(F.col("frame").alias("Frame")).agg(F.min("x").alias("BBox_X"), F.min("y").alias("BBox_Y"), F.max("w").cast("double").alias("BBox_W"), F.max("h").cast("double").alias("BBox_H"))
    return _r(records.camera_baseline(t, done), "BBox_X", "BBox_Y", "BBox_W", "BBox_H")


@query("WITH " + _T + ", r AS (SELECT game, frame, id, row_number() OVER (PARTITION BY game ORDER BY frame, id) - 1 AS k FROM t) SELECT game, frame, id, k // 16 AS batch, k % 16 AS place FROM r")
def batches(t):
    return alignment.batched(t.select("game", "frame", "id", F.struct("frame", "id").alias("o")), 16, order="o").drop("o")


@query("WITH " + _T + " SELECT game, 1 + (frame - 100 * game) AS ordinal, count(*) AS n FROM t WHERE frame - 100 * game BETWEEN 10 AND 19 GROUP BY 1, 2")
def frame_ranges(t):
    """Frames by range, both ends included, and by ordinal."""
    return t.filter((F.col("frame") - 100 * F.col("game")).between(10, 19)).groupBy("game", (1 + F.col("frame") - 100 * F.col("game")).alias("ordinal")).agg(F.count("*").alias("n"))


@query("WITH " + _T + " SELECT frame, id FROM t WHERE frame % 6 = 0 AND w > 0 AND h > 0")
def frame_stride(t):
    return t.filter((F.col("frame") % 6 == 0) & (F.col("w") > 0) & (F.col("h") > 0)).select("frame", "id")


@query("WITH " + _T + " SELECT frame, id, score * w AS cost FROM t QUALIFY row_number() OVER (PARTITION BY frame ORDER BY score * w, id) = 1")
def least_cost(t):
    """The first of the least, in the order of ids."""
    return t.groupBy("frame").agg(F.min(F.struct((F.col("score") * F.col("w")).alias("cost"), "id")).alias("m")).select("frame", "m.id", "m.cost")
