"""Queries of boxes, poses, masks, anchors and clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from .catalog import _T, _r, _wide, _WIDE, query
from .functions import boxes
from .operators import frames, intervals, jerseys, masks, poses, reports
from .sources import tables

_NUM = "number / 100.0"
_OFF = "(number / 100.0 + 0.003)"


def _lit(*values: float):
    return tuple(F.lit(v) for v in values)


@query("WITH " + _T + """, e AS (SELECT frame, id, x - 500 AS l, y - 100 AS t, x - 500 + w AS r, y - 100 + h AS b FROM t)
SELECT frame, id, round(CASE WHEN l < 0 THEN 0 WHEN r > 3000 THEN 3000 - (r - l) ELSE l END, 6) AS sl, round(CASE WHEN t < 0 THEN 0 WHEN b > 250 THEN 250 - (b - t) ELSE t END, 6) AS st, l < 0 OR r >= 3000 AS moved_x, t < 0 OR b >= 250 AS moved_y,
l <= 100 AS on_left, b >= 200 AS on_bottom, (l <= 100 AND id - 10 < 0.01) OR (r >= 2500 AND id - 10 > -0.01) AS over_x, (t <= 20 AND id - 15 < 0.01) OR (b >= 200 AND id - 15 > -0.01) AS over_y FROM e""")
def box_edges(t):
    b = boxes.tlwh_to_tlbr((F.col("x") - 500, F.col("y") - 100, F.col("w"), F.col("h")))
    moved, mx, my = boxes.shift_flags(b, F.lit(3000.0), F.lit(250.0))
    bounds = _lit(100.0, 20.0, 2500.0, 200.0)
    left, _, _, bottom = boxes.on_edges(b, bounds)
    ox, oy = boxes.overshoots(b, bounds, F.col("id") - 10, F.col("id") - 15)
    return _r(t.select("frame", "id", moved[0].alias("sl"), moved[1].alias("st"), mx.alias("moved_x"), my.alias("moved_y"), left.alias("on_left"), bottom.alias("on_bottom"), ox.alias("over_x"), oy.alias("over_y")), "sl", "st")


@query("WITH " + _T + """, e AS (SELECT frame, id, x + w / 2 AS cx, y + h / 2 AS cy, w * 1.5 AS w, h * 0.5 AS h FROM t), s AS (SELECT frame, id, greatest(cx - w / 2, 300) AS l, least(cx + w / 2, 2000) AS r, greatest(cy - h / 2, 40) AS t, least(cy + h / 2, 300) AS b FROM e)
SELECT frame, id, round(CASE WHEN l >= r AND l >= 2000 THEN 1999 ELSE l END, 6) AS l, round(CASE WHEN l >= r THEN CASE WHEN l < 2000 THEN l + 1 ELSE 2000 END ELSE r END, 6) AS r,
round(CASE WHEN t >= b AND t >= 300 THEN 299 ELSE t END, 6) AS t, round(CASE WHEN t >= b THEN CASE WHEN t < 300 THEN t + 1 ELSE 300 END ELSE b END, 6) AS b FROM s""")
def box_scaled_within(t):
    out = boxes.scaled_within(boxes.tlwh_to_tlbr(boxes.cols(*"xywh")), 1.5, 0.5, _lit(300.0, 40.0, 2000.0, 300.0))
    return _r(t.select("frame", "id", *[v.alias(n) for v, n in zip(out, "ltrb", strict=True)]), *"ltrb")


@query("WITH " + _T + """, l AS (SELECT frame, id, x, y, w, h, h / w AS m, y - h / w * x AS c FROM t), p AS (SELECT *, CASE WHEN id % 2 = 0 THEN x + w ELSE x END AS px, y + h / 2 AS py FROM l)
SELECT frame, id, round(m, 9) AS slope, round(c, 6) AS start, CASE WHEN px < (py - c) / m THEN -1 WHEN px > (py - c) / m THEN 1 ELSE 0 END AS side, 600 - y AS up, round(x + h * 0.5 / 2, 6) AS r, sign((w) * (py - y) - h * (px - x)) AS turn FROM p""")
def box_lines(t):
    x, y, w, h = boxes.cols(*"xywh")
    px, py = F.when(F.col("id") % 2 == 0, x + w).otherwise(x), y + h / 2
    slope, start = boxes.line(x, y, x + w, y + h)
    out = t.select("frame", "id", slope.alias("slope"), start.alias("start"), boxes.beside_line(px, py, x, y, x + w, y + h).alias("side"), boxes.y_up(y, 600).alias("up"), boxes.from_center_aspect_height(x, y, 0.5, h)[2].alias("r"), boxes.side_of_line(px, py, x, y, x + w, y + h).alias("turn"))
    return out.withColumns({"slope": F.round("slope", 9), "start": F.round("start", 6), "r": F.round("r", 6)})


@query("WITH " + _T + """, s AS (SELECT frame, id, x / 5000 AS x, y / 500 AS y, w / 60 AS w, greatest(h / 90, 1e-6) AS h0 FROM t), a AS (SELECT *, least(h0, 1 / 1.6) AS h, least(least(h0, 1 / 1.6) * 1.6, 1) AS ow FROM s)
SELECT frame, id, round(greatest(least(x + w / 2, 1 - ow / 2), ow / 2) - ow / 2, 9) AS l, round(greatest(least(y + w * 0 + h0 / 2, 1 - h / 2), h / 2) - h / 2, 9) AS t, round(ow, 9) AS w, round(h, 9) AS h, round(greatest(least(x + w, 1), 0) - greatest(least(x, 1), 0), 9) AS cut FROM a""")
def slow_aspect_boxes(t):
    x, y, w, h = F.col("x") / 5000, F.col("y") / 500, F.col("w") / 60, F.col("h") / 90
    out = t.select("frame", "id", *[v.alias(n) for v, n in zip(boxes.slow_aspect(x, y, w, h, 1.6), "ltwh", strict=True)], boxes.unit_box(x, y, w, h)[2].alias("cut"))
    return _r(out, *"ltwh", "cut", digits=9)


@query("WITH " + _T + ", r AS (SELECT frame, id, w, h, least(608 / h, 1088 / w) AS k FROM t) SELECT frame, id, round_even(w * k, 0) AS nw, round_even(h * k, 0) AS nh, round(k, 9) AS ratio, (1088 - round_even(w * k, 0)) / 2 AS dw, (608 - round_even(h * k, 0)) / 2 AS dh FROM r")
def letterbox_sizes(t):
    out = t.select("frame", "id", *[v.alias(n) for v, n in zip(boxes.letterbox(F.col("w"), F.col("h"), 1088, 608), ("nw", "nh", "ratio", "dw", "dh"), strict=True)])
    return _r(out, "ratio", digits=9)


@query("WITH " + _T + """, p AS (SELECT frame, id, w * 20 AS w, h * 5 AS h, CASE WHEN x - 500 < 0 OR x - 500 > 3000 OR y > 400 THEN greatest(least(x - 500, 2999), 0) ELSE x - 500 END AS cx, CASE WHEN x - 500 < 0 OR x - 500 > 3000 OR y > 400 THEN greatest(least(y, 399), 0) ELSE y END AS cy FROM t),
k AS (SELECT *, greatest(least(1, 2 * cx / w, 2 * (3000 - cx) / w, 2 * cy / h, 2 * (400 - cy) / h), 0.25) AS k FROM p)
SELECT frame, id, round(greatest(least(cx - w * k / 2, greatest(3000 - w * k, 0)), 0), 6) AS x, round(greatest(least(cy - h * k / 2, greatest(400 - h * k, 0)), 0), 6) AS y, round(w * k, 6) AS w, round(h * k, 6) AS h FROM k""")
def click_boxes(t):
    out = boxes.click_box(F.col("x") - 500, F.col("y"), F.col("w") * 20, F.col("h") * 5, 3000.0, 400.0)
    return _r(t.select("frame", "id", *[v.alias(n) for v, n in zip(out, "xywh", strict=True)]), *"xywh")


@query("WITH " + _T + " SELECT frame, id, round((x - 100) / 30, 9) AS dx, round((y - 50) / 60, 9) AS dy, round(ln(w / 30), 9) AS dw, round(ln(h / 60), 9) AS dh, round(x, 6) AS gx, round(h, 6) AS gh FROM t")
def anchor_deltas(t):
    anchor = _lit(100.0, 50.0, 30.0, 60.0)
    d = boxes.anchor_deltas(*boxes.cols(*"xywh"), *anchor)
    back = boxes.from_deltas(*d, *anchor)
    out = t.select("frame", "id", *[v.alias(n) for v, n in zip(d, ("dx", "dy", "dw", "dh"), strict=True)], back[0].alias("gx"), back[3].alias("gh"))
    return _r(_r(out, "dx", "dy", "dw", "dh", digits=9), "gx", "gh")


@query("WITH " + _T + f""", p AS (SELECT *, x + w * {_OFF} AS px, y + h * (id / 25.0) AS py, id / 25.0 AS f FROM t)
SELECT frame, id, px >= x + f * w / 2 AND px < x + w - f * w / 2 AND f > 0 AS inside, round(x + w / 2, 6) AS cx, round(y + h / 3, 6) AS cy, round(x + w / 2 - w, 6) AS sx, round(y + h / 3 - h / 3 * 0.5, 6) AS sy FROM p""")
def polygons(t):
    x, y, w, h = boxes.cols(*"xywh")
    p = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w / 2, y + h))
    t = t.withColumns({"p": p, "px": x + w * (F.col("number") / 100 + 0.003), "py": y + h * (F.col("id") / 25)})
    cx, cy = boxes.polygon_center(F.col("p"))
    out = t.select("frame", "id", boxes.in_polygon(F.col("px"), F.col("py"), F.col("p")).alias("inside"), cx.alias("cx"), cy.alias("cy"), boxes.scaled_polygon(F.col("p"), 2.0)[0][0].alias("sx"), boxes.scaled_polygon_y(F.col("p"), 2.0, 0.5)[0][1].alias("sy"))
    return _r(out, "cx", "cy", "sx", "sy")


@query("WITH " + _T + """, g AS (SELECT k, exp(-pow(k - 2500 - 1, 2) / (2 * 625.0 * 625)) AS v FROM range(5001) q(k)), m AS (SELECT min(v) AS a, max(v) AS b FROM g)
SELECT frame, id, round((v - a) / (b - a), 9) AS weight, round(1 - (v - a) / (b - a), 9) AS inverse FROM t JOIN g ON g.k = floor(greatest(least(x, 4999), 0)), m""")
def gaussian_weights(t):
    out = t.select("frame", "id", boxes.gaussian_profile(F.col("x"), 5000).alias("weight"), boxes.gaussian_profile(F.col("x"), 5000, invert=True).alias("inverse"))
    return _r(out, "weight", "inverse", digits=9)


@query("WITH " + _T + f""" SELECT frame, round(x, 6) AS l, round(y, 6) AS t, round(x + w, 6) AS r, round(y + h, 6) AS b, round(greatest(least(CASE WHEN frame % 3 = 0 THEN score ELSE (score + {_NUM}) / 2 END + 0.25, 1), 0), 6) AS score, 0 AS label FROM t""")
def pose_detections(t):
    """Every other frame lacks boxes, two thirds lack their scores."""
    box, point = F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")), F.array(F.array("x", "y"), F.array(F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    parts = t.groupBy("frame").agg(F.collect_list(F.struct(box.alias("b"), point.alias("k"), F.col("score").cast("double").alias("v"), F.array(F.col("score").cast("double"), F.col("number") / 100).alias("s"))).alias("l"))
    field = lambda f: F.transform("l", lambda e: e[f])
    prediction = F.struct(F.when(F.col("frame") % 2 == 0, field("b")).alias("bboxes"), field("k").alias("keypoints"), F.when(F.col("frame") % 3 == 0, field("v")).alias("bbox_scores"), field("s").alias("keypoint_scores"))
    stored = parts.select(F.col("frame").alias("Frame"), F.to_json(F.struct(F.array(prediction).alias("predictions"))).alias("PoseJSON"))
    return _r(poses.detections(tables.pose_rows(stored)).withColumnRenamed("Frame", "frame").drop("person"), *"ltrb", "score")


def _px(i):
    return f"(x + w * {i * 7 % 11} / 11)"


def _py(i):
    return f"(y + h * {i * 5 % 13} / 13)"


def _ps(i):
    return f"(((number + {i * 13}) % 100) / 100.0)"


def _cut(v, most):
    return f"trunc(greatest({v}, 0))" if most is None else f"trunc(least({v}, {most}))"


_TORSO = (6, 5, 11, 12)


def _arm(a, b, c):
    pad = f"trunc(greatest(5, 0.45 * sqrt(pow({_px(a)} - {_px(b)}, 2) + pow({_py(a)} - {_py(b)}, 2))))"
    pick = lambda f, p, d: f"{f}({p(a)}, {p(b)}, CASE WHEN {_ps(c)} >= 0.4 THEN {p(c)} ELSE {p(a)} END)"
    l, r = _cut(f"{pick('least', _px, 0)} - {pad}", None), _cut(f"{pick('greatest', _px, 0)} + {pad}", 4999)
    t, o = _cut(f"{pick('least', _py, 0)} - trunc(0.25 * {pad})", None), _cut(f"{pick('greatest', _py, 0)} + trunc(0.75 * {pad})", 549)
    return f"CASE WHEN {_ps(a)} >= 0.4 AND {_ps(b)} >= 0.4 AND {r} - {l} >= 4 AND {o} - {t} >= 4 THEN [{l}, {t}, {r}, {o}] END"


_XS, _YS = ", ".join(map(_px, _TORSO)), ", ".join(map(_py, _TORSO))
_TL, _TR = _cut(f"least({_XS}) - 5", None), _cut(f"greatest({_XS}) + 5", 4999)
_TT, _TB = _cut(f"least({_YS}) - 5", None), _cut(f"greatest({_YS})", 549)
_SURE2 = f"({_ps(5)} >= 0.4) AND ({_ps(6)} >= 0.4)"


@query("WITH " + _T + f""", v AS (SELECT *, CASE WHEN ({_SURE2} AND sqrt(pow({_px(5)} - {_px(6)}, 2) + pow({_py(5)} - {_py(6)}, 2)) / w < 1.6) OR (({_ps(5)} >= 0.4) <> ({_ps(6)} >= 0.4)) THEN CASE WHEN {_ps(5)} >= {_ps(6)} THEN 'left' ELSE 'right' END END AS side,
trunc(x) AS il, trunc(y) AS it, trunc(x + w) AS ir, trunc(y + h) AS ib FROM t),
a AS (SELECT *, CASE WHEN {" AND ".join(f"{_ps(i)} >= 0.4" for i in _TORSO)} AND {_TR} > {_TL} AND {_TB} > {_TT} THEN [{_TL}, {_TT}, {_TR}, {_TB}] END AS torso, CASE side WHEN 'left' THEN {_arm(5, 7, 9)} WHEN 'right' THEN {_arm(6, 8, 10)} END AS arm,
[greatest(il + trunc(0.2 * (ir - il)), 0), greatest(it + trunc(0.25 * (ib - it)), 0), least(ir - trunc(0.2 * (ir - il)), 4999), least(it + trunc(0.95 * (ib - it)), 549)] AS mid FROM v),
z AS (SELECT frame, id, side, coalesce(arm, torso, CASE WHEN mid[3] <= mid[1] OR mid[4] <= mid[2] THEN [il, it, ir, ib] ELSE mid END) AS r, torso IS NOT NULL AS has_torso FROM a)
SELECT frame, id, coalesce(side, '-') AS side, has_torso, CAST(r[1] AS INT) AS l, CAST(r[2] AS INT) AS t, CAST(r[3] AS INT) AS r, CAST(r[4] AS INT) AS b FROM z""")  # fmt: skip
def pose_regions(t):
    points = F.array(*[F.array(F.col("x") + F.col("w") * (i * 7 % 11) / 11, F.col("y") + F.col("h") * (i * 5 % 13) / 13) for i in range(17)])
    scores = F.array(*[((F.col("number") + i * 13) % 100) / 100 for i in range(17)])
    t = t.withColumns({"p": points, "s": scores})
    b = boxes.tlwh_to_tlbr(boxes.cols(*"xywh"))
    region = poses.region_for_track(F.col("p"), F.col("s"), b, 5000, 550, 1.6)
    out = t.select("frame", "id", F.coalesce(poses.side_view(F.col("p"), F.col("s"), F.col("w"), 1.6), F.lit("-")).alias("side"), poses.torso_region(F.col("p"), F.col("s"), 5000, 550).isNotNull().alias("has_torso"), region.alias("g"))
    return out.select("frame", "id", "side", "has_torso", "g.l", "g.t", "g.r", "g.b")


_MASK = ", g AS (SELECT DISTINCT game FROM t), m AS (SELECT game, k AS y, (k * 7 + game * 3) % 40 AS x0, (k * 7 + game * 3) % 40 + 30 + (k * game) % 20 AS x1 FROM g, range(10, 90) q(k)), p AS (SELECT game, y, unnest(range(x0, x1 + 1)) AS x FROM m)"


def _mask(t):
    k = F.explode(F.sequence(F.lit(10).cast("long"), F.lit(89).cast("long")))
    rows = t.select("game").distinct().select("game", k.alias("y")).withColumn("x0", (F.col("y") * 7 + F.col("game") * 3) % 40)
    return rows.withColumn("x1", F.col("x0") + 30 + (F.col("y") * F.col("game")) % 20)


@query("WITH " + _T + _MASK + " SELECT game, round(min(x) / 80.0, 9) AS x1, round(min(y) / 90.0, 9) AS y1, round(least(max(x) / 80.0, 1), 9) AS x2, round(max(y) / 90.0, 9) AS y2, round(avg(x) / 80, 9) AS cx, round(avg(y) / 90, 9) AS cy, round(count(*) / 10000.0, 9) AS area FROM p GROUP BY 1")
def mask_features(t):
    return _r(masks.mask_features(_mask(t), 100, 100, 80.0, 90.0, ("game",)), "x1", "y1", "x2", "y2", "cx", "cy", "area", digits=9)


@query("WITH " + _T + _MASK + """, q AS (SELECT DISTINCT game, number AS x, 5 + id * 4 AS y FROM t), r AS (SELECT game, y, min(x) AS l, max(x) AS r FROM p GROUP BY 1, 2), c AS (SELECT game, x, min(y) AS t, max(y) AS b FROM p GROUP BY 1, 2)
SELECT game, x, y, y - t AS above, b - y AS below, x - l AS "left", r - x AS "right" FROM q JOIN p USING (game, x, y) JOIN r USING (game, y) JOIN c USING (game, x)""")
def mask_edges(t):
    points = t.select("game", F.col("number").cast("long").alias("x"), (5 + F.col("id") * 4).alias("y")).distinct()
    return masks.edge_distances(points, _mask(t), ("game",))


@query("WITH " + _T + _MASK + """ SELECT game, arg_min(y, x * 1000 + y) AS left_y, min(x) AS left_x, arg_max(y, x * 1000 - y) AS right_y, max(x) AS right_x, min(y) AS top_y, arg_min(x, y * 1000 + x) AS top_x, max(y) AS bottom_y, arg_max(x, y * 1000 - x) AS bottom_x FROM p GROUP BY 1""")
def mask_extremes(t):
    return masks.extreme_points(_mask(t), ("game",))


@query("WITH " + _T + _MASK + """, s AS (SELECT game, count(*) FILTER (WHERE x < 12) AS "left", count(*) FILTER (WHERE x >= 88 AND x < 100) AS "right", count(*) FILTER (WHERE y < 12) AS top, count(*) FILTER (WHERE y >= 12) AS bottom FROM p GROUP BY 1)
SELECT *, CASE WHEN "left" > "right" THEN 'right' WHEN "right" > "left" THEN 'left' ELSE 'UNKNOWN' END AS orientation FROM s""")
def mask_orientation(t):
    return masks.edge_occupancy(_mask(t), 100, 100, ("game",))


_PROBE = ", k AS (SELECT frame, id, score, x + w / 2 AS px, CASE WHEN y + h / 2 > 200 THEN y + h / 2 - h * 0.1 ELSE y + h - h * 0.2 END AS py FROM t)"


@query("WITH " + _T + _PROBE + """, i AS (SELECT * FROM k WHERE floor(py) BETWEEN 0 AND 399 AND floor(px) BETWEEN floor(py) AND 2500 + floor(py)), s AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, id) - 1 AS slot FROM i)
SELECT f.frame, q.slot, s.id IS NOT NULL AS valid, coalesce(s.id, 0) AS id, coalesce(s.score, 0) AS score FROM (SELECT DISTINCT frame FROM t) f, range(6) q(slot) LEFT JOIN s ON s.frame = f.frame AND s.slot = q.slot""")
def masked_slots(t):
    mask = t.sparkSession.range(400).select(F.col("id").alias("y"), F.col("id").alias("x0"), (F.col("id") + 2500).alias("x1"))
    out = masks.in_mask_slots(masks.probe_points(t, 0.1, 0.2, 200.0).withColumn("score", F.col("score").cast("double")), mask, 6)
    return out.withColumn("slot", F.col("slot").cast("long"))


@query("WITH " + _T + _PROBE + " SELECT frame, id, round(px, 6) AS px, round(py, 6) AS py FROM k")
def probe_points(t):
    return _r(masks.probe_points(t, 0.1, 0.2, 200.0).select("frame", "id", "px", "py"), "px", "py")


@query("WITH " + _T + ", c AS (SELECT frame, id, x - 200 + w / 2 AS cx, y - 30 + h / 2 AS cy FROM t) SELECT frame, id FROM c WHERE NOT (cx BETWEEN 0 AND 1000 AND cy < 50 + 50 * cx / 1000)")
def clipped_border_prune(t):
    clipped = t.withColumns({"x": F.col("x") - 200, "y": F.col("y") - 30})
    return frames.below_borders(clipped, [(0.0, 50.0, 1000.0, 100.0)], []).select("frame", "id")


@query("WITH " + _T + " SELECT frame, id, y > 250 AS below_y, y < 100 AS below_x, y > 400 AS above_x FROM t WHERE y > 250 OR y < 100")
def threshold_points(t):
    """The selectors along x read y too, as in the system being rebuilt."""
    return t.filter((F.col("y") > 250) | (F.col("y") < 100)).select("frame", "id", (F.col("y") > 250).alias("below_y"), (F.col("y") < 100).alias("below_x"), (F.col("y") > 400).alias("above_x"))


_OV = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"


@query("WITH RECURSIVE " + _WIDE + f""", n AS (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY score DESC, id) AS k FROM u),
o AS (SELECT a.frame, a.label, a.k, a.id, coalesce(list(b.id) FILTER (WHERE {_OV} / (a.w * a.h + b.w * b.h - {_OV}) > 0.1), []) AS over FROM n a LEFT JOIN n b ON a.frame = b.frame AND a.label = b.label AND b.k < a.k GROUP BY 1, 2, 3, 4),
r AS (SELECT frame, label, k, [id] AS kept FROM o WHERE k = 1 UNION ALL SELECT o.frame, o.label, o.k, CASE WHEN list_has_any(r.kept, o.over) THEN r.kept ELSE list_append(r.kept, o.id) END FROM r JOIN o ON o.frame = r.frame AND o.label = r.label AND o.k = r.k + 1)
SELECT frame, label, unnest(kept) AS id FROM r QUALIFY k = max(k) OVER (PARTITION BY frame, label)""")
def suppressed_boxes(t):
    return reports.suppressed(_wide(t), 0.1).select("frame", "label", "id")


@query("WITH " + _T + """, f AS (SELECT DISTINCT frame FROM t), p AS (SELECT * FROM t WHERE frame % 5 > 0), u AS (SELECT frame, coalesce(min(x), 0) AS l, coalesce(min(y), 0) AS t, coalesce(max(x + w), 5000) AS r, coalesce(max(y + h), 600) AS b FROM f LEFT JOIN p USING (frame) GROUP BY 1),
h AS (SELECT frame, (l + r) / 2 AS cx, (t + b) / 2 AS cy, greatest(least((b - t) * 1.4, 570), 210) AS h FROM u),
c AS (SELECT frame, greatest(least(cx - h * 16 / 9 / 2, 5000), 0) AS l, greatest(least(cy - h / 2, 600), 0) AS t, greatest(least(cx + h * 16 / 9 / 2, 5000), 0) AS r, greatest(least(cy + h / 2, 600), 0) AS b FROM h),
s AS (SELECT *, greatest(r - l, 1) * least(1, 4200 / greatest(r - l, 1), 500 / greatest(b - t, 1)) / 2 AS w2, greatest(b - t, 1) * least(1, 4200 / greatest(r - l, 1), 500 / greatest(b - t, 1)) / 2 AS h2 FROM c),
m AS (SELECT frame, w2, h2, greatest(least((l + r) / 2, 4600 - w2), 400 + w2) AS cx, greatest(least((t + b) / 2, 550 - h2), 50 + h2) AS cy FROM s)
SELECT frame, round(cx - w2, 6) AS l, round(cy - h2, 6) AS t, round(cx + w2, 6) AS r, round(cy + h2, 6) AS b FROM m""")
def rule_camera(t):
    """Every fifth frame has no boxes; the play bounds are narrower than the picture."""
    return _r(reports.rule_camera(t.filter("frame % 5 > 0"), 5000.0, 600.0, 16 / 9, bounds=(400.0, 50.0, 4600.0, 550.0), every=t.select("frame").distinct()), *"ltrb")


_CAMS = ", c AS (SELECT game, frame, avg(x) / 5000 AS x, avg(y) / 600 AS y, avg(w) / 100 AS w, avg(h) / 100 AS h, min(x) / 5000 AS px, min(y) / 600 AS py, min(w) / 100 AS pw, min(h) / 100 AS ph FROM t GROUP BY 1, 2)"
_D = {c: f"p{c} - {c}" for c in "xywh"}


@query("WITH " + _T + _CAMS + f""", d AS (SELECT *, {", ".join(f"{v} AS d{c}" for c, v in _D.items())} FROM c),
l AS (SELECT *, {", ".join(f"abs(d{c} - lag(d{c}) OVER o) AS v{c}, abs(d{c} - 2 * lag(d{c}) OVER o + lag(d{c}, 2) OVER o) AS a{c}" for c in "xywh")}, greatest(least(px + pw, x + w) - greatest(px, x), 0) * greatest(least(py + ph, y + h) - greatest(py, y), 0) AS i FROM d WINDOW o AS (PARTITION BY game ORDER BY frame)),
m AS (SELECT avg((abs(dx) + abs(dy) + abs(dw) + abs(dh)) / 4) AS l1, avg(i / greatest(pw * ph + w * h - i, 1e-6)) AS iou, avg((vx + vy + vw + vh) / 4) AS velocity, avg((ax + ay + aw + ah) / 4) AS acceleration FROM l)
SELECT round(l1, 9) AS l1, round(iou, 9) AS iou, round(velocity, 9) AS velocity, round(acceleration, 9) AS acceleration, round(l1 + 0.5 * (1 - iou) + 0.2 * velocity + 0.1 * acceleration, 9) AS loss FROM m""")
def camera_losses(t):
    scale = {"x": 5000, "y": 600, "w": 100, "h": 100}
    side = lambda f: t.groupBy("game", "frame").agg(*[(f(c) / k).alias(c) for c, k in scale.items()])
    out = reports.camera_losses(side(F.min), side(F.avg), (1.0, 0.5, 0.2, 0.1))
    return _r(out, *out.columns, digits=9)


@query("WITH " + _T + """, c AS (SELECT frame AS image, id, length(label) AS cls, least(x / 5000, 0.999) * 19 AS x, y / 500 * 34 AS y, w / 37 * 19 / 4 AS w, h / 63 * 34 / 4 AS h FROM t), a(anchor, aw, ah) AS (VALUES (0, 3.0, 6.0), (1, 4.5, 8.0), (2, 2.0, 5.0)),
p AS (SELECT *, least(w, aw) * least(h, ah) / (w * h + aw * ah - least(w, aw) * least(h, ah) + 1e-16) AS iou, CAST(floor(greatest(least(x, 18), 0)) AS BIGINT) AS gi, CAST(floor(greatest(least(y, 33), 0)) AS BIGINT) AS gj FROM c, a),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY image, id ORDER BY iou DESC, anchor) = 1), o AS (SELECT * FROM b WHERE iou > 0.6 QUALIFY row_number() OVER (PARTITION BY image, gi, gj, anchor ORDER BY iou DESC, id) = 1)
SELECT image, anchor, gj, gi, id, cls, round(x - floor(x), 6) AS tx, round(y - floor(y), 6) AS ty, round(ln(w / aw), 6) AS tw, round(ln(h / ah), 6) AS th FROM o""")
def anchor_targets(t):
    targets = t.select(F.col("frame").alias("image"), "id", F.length("label").alias("cls"), F.least(F.col("x") / 5000, F.lit(0.999)).alias("cx"), (F.col("y") / 500).alias("cy"), (F.col("w") / 37 / 4).alias("w"), (F.col("h") / 63 / 4).alias("h"))
    anchors = t.sparkSession.createDataFrame([(0, 3.0, 6.0), (1, 4.5, 8.0), (2, 2.0, 5.0)], "anchor int, w double, h double")
    return _r(reports.anchor_targets(targets, anchors, 19, 34), "tx", "ty", "tw", "th")


@query("WITH " + _T + " SELECT frame, id, length(label) + 1 AS cls, round(2 * x + 0.1 * y + 5, 6) AS l, round(0.2 * x + 3 * y - 1, 6) AS t, round(2 * (x + w) + 0.1 * (y + h) + 5, 6) AS r, round(0.2 * (x + w) + 3 * (y + h) - 1, 6) AS b FROM t")
def rescaled_boxes(t):
    rows = t.select("frame", "id", F.length("label").alias("cls"), F.col("x").alias("l"), F.col("y").alias("t"), (F.col("x") + F.col("w")).alias("r"), (F.col("y") + F.col("h")).alias("b"))
    return _r(reports.rescaled_detections(rows, F.array(*_lit(2.0, 0.1, 5.0, 0.2, 3.0, -1.0))), *"ltrb")


@query("WITH " + _T + ", g AS (SELECT frame, id % 3 AS label, count(*) AS n, avg(x + w / 2) AS cx, avg(y + h / 2) AS cy FROM t GROUP BY 1, 2) SELECT frame, label, n, round(cx, 6) AS cx, round(cy, 6) AS cy, row_number() OVER (PARTITION BY frame ORDER BY n DESC, label) = 1 AS largest FROM g")
def cluster_snapshot(t):
    rows = t.select("frame", "id", (F.col("id") % 3).alias("label"), (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"))
    return _r(reports.cluster_snapshot(rows), "cx", "cy")


@query("WITH " + _T + ", p AS (SELECT frame, CAST(number AS VARCHAR) AS text, x + w / 2 AS px, y + h / 2 AS py FROM t WHERE row_ord % 2 = 0), b AS (SELECT frame, id, x - 200 AS l, y - 100 AS t, x + 200 AS r, y + 100 AS b FROM t WHERE row_ord % 2 = 1) SELECT p.frame, text, id FROM p JOIN b ON p.frame = b.frame AND px >= l AND px < r AND py >= b.t AND py < b")
def text_in_boxes(t):
    points = t.filter("row_ord % 2 = 0").select("frame", F.col("number").cast("string").alias("text"), (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"))
    tiles = t.filter("row_ord % 2 = 1").select("frame", "id", (F.col("x") - 200).alias("l"), (F.col("y") - 100).alias("t"), (F.col("x") + 200).alias("r"), (F.col("y") + 100).alias("b"))
    return reports.text_in_boxes(points, tiles)


@query("WITH " + _T + " SELECT a.frame, a.id AS match, a.x AS lx, a.y AS ly, b.x AS rx, b.y AS ry FROM t a JOIN t b ON b.frame = a.frame + 1 AND a.id = b.id")
def matched_points(t):
    side = lambda d: t.select((F.col("frame") - d).alias("frame"), F.col("id").alias("match"), "x", "y")
    return reports.matched_points(side(0), side(1), ("frame", "match"))


@query("WITH " + _T + " SELECT frame, id, x FROM t QUALIFY row_number() OVER (PARTITION BY frame ORDER BY x, id) <= 3")
def least_x(t):
    return reports.least_x(t, 3).select("frame", "id", "x")


_RUN = ", m AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY game, id ORDER BY frame) = 1 THEN 0 ELSE 1 END AS fresh FROM t), r AS (SELECT *, sum(fresh) OVER (PARTITION BY game, id ORDER BY frame) AS run FROM m)"


@query("WITH " + _T + _RUN + """, d AS (SELECT *, x + w / 2 - lag(x + w / 2) OVER o AS dx, y + h - lag(y + h) OVER o AS dy FROM r WINDOW o AS (PARTITION BY game, id, run ORDER BY frame)), a AS (SELECT *, count(dx) OVER p AS n, avg(dx) OVER p AS ax, avg(dy) OVER p AS ay FROM d WINDOW p AS (PARTITION BY game, id, run ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT game, id, frame, round(CASE WHEN n >= 2 THEN ax ELSE 0 END, 6) AS vx, round(CASE WHEN n >= 2 THEN ay ELSE 0 END, 6) AS vy FROM a""")
def mean_step(t):
    return _r(intervals.mean_step(t, 4, 2), "vx", "vy")


@query("WITH " + _T + _RUN + """, d AS (SELECT *, sqrt(pow(x - lag(x) OVER o, 2) + pow(y - lag(y) OVER o, 2) + pow(w - lag(w) OVER o, 2) + pow(h - lag(h) OVER o, 2)) AS step, row_number() OVER o AS k, lag(x, 2) OVER o AS before FROM r WINDOW o AS (PARTITION BY game, id, run ORDER BY frame))
SELECT game, id, frame, round(coalesce(avg(step) OVER (PARTITION BY game, id, run ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0), 6) AS speed, round(CASE WHEN k >= 3 THEN (x - before) / 3 ELSE 0 END, 6) AS x_speed FROM d""")
def history_speed(t):
    return _r(intervals.history_speed(t, 6, 3), "speed", "x_speed")


@query("WITH " + _T + ", g AS (SELECT game, max(frame) AS now FROM t GROUP BY 1), s AS (SELECT game, id, max(frame) AS last FROM t GROUP BY 1, 2) SELECT game, id, now - last AS age FROM s JOIN g USING (game) WHERE now - last >= 2")
def stale_tracks(t):
    return intervals.stale(t, t.groupBy("game").agg(F.max("frame").alias("now")), 2)


@query("WITH " + _T + ", f AS (SELECT DISTINCT game, frame FROM t WHERE frame % 4 = 0 OR frame % 28 = 2), l AS (SELECT *, lag(frame) OVER (PARTITION BY game ORDER BY frame) AS before FROM f) SELECT game, frame, before FROM l WHERE frame - before <> 4")
def batch_gaps(t):
    return intervals.contiguous(t.filter("frame % 4 = 0 or frame % 28 = 2"), 4)


@query()
def random_subsequence(t):
    return intervals.subsequence(t.groupBy("game", "frame").agg(F.count("*").alias("n")), 12, 5)


@query("WITH " + _T + " SELECT frame, id, CASE WHEN number - 3 <= 0 THEN number - 3 ELSE greatest(CAST(round_even((number - 3) * 0.3, 0) AS BIGINT), 1) END AS frames, round(x / 0.3, 6) AS speed FROM t")
def rate_scaled(t):
    return _r(t.select("frame", "id", reports.scaled_frames(F.col("number") - 3, 0.3).alias("frames"), reports.scaled_speed(F.col("x"), 0.3).alias("speed")), "speed")


@query("WITH " + _T + ", v AS (SELECT frame // 4 AS f, id, number, row_ord, round(score, 1) * 20 / greatest(1, CAST(w AS INT) - 25) * CASE WHEN id % 3 = 0 THEN 1.25 ELSE 1 END AS vote FROM t) SELECT f AS frame, id, number, round(vote, 9) AS vote FROM v QUALIFY row_number() OVER (PARTITION BY f, id ORDER BY vote DESC, row_ord) = 1")
def best_reading(t):
    """Regions of no width or less count as one wide; equal votes, of which there are many here, go to the first reading."""
    score = F.round(F.col("score").cast("double"), 1)
    rows = t.select(F.expr("frame div 4").alias("frame"), "id", "number", score.alias("score"), F.lit(20.0).alias("width"), (F.col("w") - 25).alias("roi_width"), F.when(F.col("id") % 3 == 0, 1.25).otherwise(1.0).alias("vote_scale"), F.col("row_ord").alias("ord"))
    return _r(jerseys.best_reading(rows), "vote", digits=9)


@query("WITH " + _T + ", r AS (SELECT frame, id, CASE WHEN id % 3 = 0 THEN number || 'x' ELSE CAST(number * 2 AS VARCHAR) END AS s, id / 20.0 AS d, score FROM t) SELECT frame, id, CASE WHEN d >= 0.5 AND score >= 0.3 AND regexp_full_match(s, '[0-9]+') AND CAST(s AS INT) < 100 THEN CAST(s AS INT) END AS reading, CASE WHEN regexp_full_match(s, '[0-9]{1,2}') AND CAST(s AS INT) > 0 THEN CAST(s AS INT) END AS jersey FROM r".replace("AND CAST(s AS INT) <", "AND TRY_CAST(s AS INT) <").replace("THEN CAST(s", "THEN TRY_CAST(s").replace("AND CAST(s AS INT) >", "AND TRY_CAST(s AS INT) >"))
def text_numbers(t):
    from .functions import text

    s = F.when(F.col("id") % 3 == 0, F.concat(F.col("number").cast("string"), F.lit("x"))).otherwise((F.col("number") * 2).cast("string"))
    return t.select("frame", "id", jerseys.readable(s, F.col("id") / 20, F.col("score").cast("double"), 0.5, 0.3).alias("reading"), text.jersey_number(s).alias("jersey"))


def _halves(t):
    a, b = t.filter("row_ord % 3 < 2"), t.filter("row_ord % 3 > 0").withColumns({"x": F.col("x") + 1, "y": F.col("y") + 1})
    return a, b


_AB = ", a AS (SELECT * FROM t WHERE row_ord % 3 < 2), b AS (SELECT * REPLACE (x + 1 AS x, y + 1 AS y) FROM t WHERE row_ord % 3 > 0)"


@query("WITH " + _T + _AB + " SELECT frame, id, x FROM a UNION ALL SELECT frame, id, x FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.frame = b.frame AND a.id = b.id)")
def track_union(t):
    return reports.track_union(*_halves(t)).select("frame", "id", "x")


@query("WITH " + _T + _AB + " SELECT frame, id, x FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.frame = b.frame AND a.id = b.id)")
def track_difference(t):
    return reports.track_difference(*_halves(t)).select("frame", "id", "x")


@query("WITH " + _T + _AB + f""", p AS (SELECT a.frame, a.id AS i, b.id AS j, a.number AS p, b.number * 2 % 70 AS q FROM a JOIN b USING (frame) WHERE 1 - {_OV} / (a.w * a.h + b.w * b.h - {_OV}) < 0.3)
SELECT 'a' AS side, frame, id FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.frame = a.frame AND p.i = a.id AND p.p <= p.q) UNION ALL SELECT 'b', frame, id FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.frame = b.frame AND p.j = b.id AND p.p > p.q)""")
def track_dedupe(t):
    a, b = _halves(t)
    a, b = reports.without_duplicates(a.withColumn("age", F.col("number")), b.withColumn("age", F.col("number") * 2 % 70), 0.3)
    return a.select(F.lit("a").alias("side"), "frame", "id").unionByName(b.select(F.lit("b").alias("side"), "frame", "id"))


@query("WITH " + _T + """, g AS (SELECT frame, id, x + w / 2 AS cx, y + h / 2 AS cy, x - lag(x) OVER (PARTITION BY game, id ORDER BY frame) AS vx FROM t), f AS (SELECT * FROM g WHERE vx IS NOT NULL),
c AS (SELECT frame, count(*) AS n, count(*) FILTER (WHERE vx >= 200) AS r, count(*) FILTER (WHERE vx <= -200) AS l, avg(vx) FILTER (WHERE vx >= 200) AS ar, avg(vx) FILTER (WHERE vx <= -200) AS al, max(cx) FILTER (WHERE vx >= 200) AS rx, first(cy ORDER BY cx DESC, id) FILTER (WHERE vx >= 200) AS ry, min(cx) FILTER (WHERE vx <= -200) AS lx, first(cy ORDER BY cx, id) FILTER (WHERE vx <= -200) AS ly FROM f GROUP BY 1),
d AS (SELECT frame, r / n > 0.5 AS right_, CASE WHEN r / n > 0.5 THEN ar ELSE al END AS v, CASE WHEN r / n > 0.5 THEN rx ELSE lx END AS ex, CASE WHEN r / n > 0.5 THEN ry ELSE ly END AS ey FROM c WHERE n >= 4 AND (r / n > 0.5 OR l / n > 0.5)),
q AS (SELECT frame, min(x) AS l, min(y) AS t, max(x + w) AS r, max(y + h) AS b FROM t GROUP BY 1)
SELECT frame, round((ex + (l + r) / 2) / 2 - (r - l) / 2, 6) AS l, round((ey + (t + b) / 2) / 2 - (b - t) / 2, 6) AS t, (v > 0 AND (l + r) / 2 < ex) OR (v < 0 AND (l + r) / 2 > ex) AS speeds, round(CASE WHEN (v > 0 AND (l + r) / 2 < ex) OR (v < 0 AND (l + r) / 2 > ex) THEN v * 0.3 ELSE 0 END, 6) AS push FROM d JOIN q USING (frame)""")
def breakaway(t):
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    moving = t.select("frame", "id", cx.alias("cx"), cy.alias("cy"), (F.col("x") - F.lag("x").over(W.partitionBy("game", "id").orderBy("frame"))).alias("vx")).filter("vx is not null")
    out = frames.breakaway(moving, frames.enclosing(t), 200.0, 0.5, 4, speed_ratio=0.3)
    return _r(out.select("frame", "l", "t", "speeds", "push"), "l", "t", "push")
