"""Worked examples of the column functions, operators, graphs and folds."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane import catalog
from tracklane.functions import boxes, text
from tracklane.operators import frames, groups, intervals, jerseys, media, training
from tracklane.plans import config
from tracklane.plans.graph import Graph, Node, barrier, checksums
from tracklane.sources import tables
from tracklane.streaming import folds, movers

SF = "/root/testdata/sf0.001"


def test_merge_intervals(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (7.0, 2.0), (30.0, 1.0)], "start double, duration double")
    assert sorted(map(tuple, intervals.merge_intervals(rows, 3).collect())) == [(0.0, 9.0), (30.0, 1.0)]
    assert intervals.merge_intervals(rows.limit(0), 3).count() == 0


def test_last_interval_holds_every_frame(spark):
    rows = spark.createDataFrame([(10, 1), (95, 1), (150, 1)], "frame long, id long")
    starts = spark.createDataFrame([(0,), (100,)], "start long")
    got = sorted(map(tuple, intervals.assign_intervals(rows, starts).select("interval", "frame").collect()))
    assert got == [(1, 10), (2, 10), (2, 95), (2, 150)]


def test_clock(spark):
    row = spark.range(1).select(text.format_hms(F.lit(3661.5)).alias("a"), text.parse_hms(F.lit("3:21")).alias("b"), text.parse_hms(F.lit("x")).alias("c"), text.parse_rate(F.lit("1/0")).alias("d")).first()
    assert tuple(row) == ("01:01:02", 201.0, None, 0.0)


def test_numbers(spark):
    row = spark.range(1).select(jerseys.trim_one_digit(F.array(F.lit(1), F.lit(7), F.lit(12))).alias("n"), boxes.panoramic_distance(F.lit(0.0), F.lit(1000.0), F.lit(1000.0)).alias("d")).first()
    assert row["n"] == [7, 12] and abs(row["d"] - 314.1592653589793) < 1e-9


def test_frequent_numbers_keeps_a_tenth(spark):
    rows = spark.createDataFrame([(1, f, 12) for f in range(10)] + [(1, 20, 7)], "id long, frame long, number int")
    assert sorted(r["number"] for r in jerseys.frequent_numbers(rows, 0.1).collect()) == [7, 12]


def test_valid_boxes(spark):
    rows = spark.createDataFrame([(5, 0.0, 0.0, 1.0, 1.0), (6, 2.0, 0.0, 1.0, 1.0), (7, float("nan"), 0.0, 1.0, 1.0), (8, 0.0, 0.0, float("inf"), 1.0), (9, None, 0.0, 1.0, 1.0)], "id long, l double, t double, r double, b double")
    assert [r["id"] for r in rows.filter(boxes.valid(boxes.cols("l", "t", "r", "b"))).collect()] == [5]


def test_evidence_voter():
    m = folds.EvidenceVoter(decay=0.95, over_current=1.4)
    s, seen = m.start(), []
    for frame, (number, score) in enumerate([(12, 0.9), (12, 0.9), (7, 0.1), (7, 1.0), (7, 1.0), (7, 1.0)]):
        s, out = m.step(s, (frame, number, score))
        seen.append(out[0][1])
    assert seen == [-1, 12, 12, 12, 12, 7]


def test_zones_wait_for_the_other_line():
    m = folds.Zones(40, 45, 55, 60)
    s, seen = m.start(), []
    for f, x in enumerate([50, 39, 43, 46, 61, 57, 30]):
        s, out = m.step(s, (f, x))
        seen.append(out[0][1])
    assert seen == ["middle", "left", "left", "middle", "right", "right", "left"]


def test_associations():
    m = folds.Associations()
    two = [(0.0, 0.0, 10.0, 20.0, 0, 0.9), (50.0, 50.0, 60.0, 70.0, 0, 0.95)]
    s, out = m.step(m.start(), 0, two)
    assert [o[1] for o in out] == [0, 1]
    s, out = m.step(s, 1, [(1.0, 0.0, 11.0, 20.0, 0, 0.9), (51.0, 50.0, 61.0, 70.0, 0, 0.95)])
    assert sorted(o[1] for o in out) == [0, 1]
    assert m.step(m.start(), 0, [(0.0, 0.0, 10.0, 20.0, 0, 0.6)])[1] == []
    s, out = m.step(s, 2, [(1.0, 0.0, 11.0, 20.0, 1, 0.9)])
    assert [o[1] for o in out] == [2]


def test_stream_equals_batch(spark, tmp_path):
    rows = catalog.tracks(spark, SF).filter("number between 1 and 99").select("id", "frame", "number", F.col("score").cast("double").alias("score"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = folds.fold_stream(stream, folds.EvidenceVoter(), "id").writeStream.format("memory").queryName("votes").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("votes").collect())) == sorted(map(tuple, folds.fold(rows, folds.EvidenceVoter(), "id").collect()))


def test_graph(spark):
    one = lambda d: d.withColumn("a", F.lit(1))
    two = lambda d: d.withColumn("b", F.lit(2))
    nodes = [Node("source", lambda d: d), Node("a", one, ["source"], {"a"}), Node("b", two, ["source"], {"b"}), Node("both", barrier, ["a", "b"], joins=True)]
    g = Graph(nodes)
    rows = spark.range(3).withColumnRenamed("id", "frame")
    made = g.run({"source": rows})
    assert set(made["both"].columns) == {"frame", "a", "b"} and made["both"].count() == 3 and g.degree("both") == 2
    assert checksums(made).count() == 4 and '"a" -> "both"' in g.dot()
    for bad in ([Node("x", one, ["x"])], [Node("x", one, ["y"])], [*nodes[:3], Node("both", barrier, ["a", "b"])]):
        with pytest.raises(ValueError):
            Graph(bad)
    with pytest.raises(ValueError):
        Graph([Node("source", one, outputs=set())]).run({"source": rows})


def test_config():
    base = {"a": {"b": 1, "c": 2}, "r": "GLOBAL.a.b", "loop": "GLOBAL.loop", "no": "GLOBAL.x"}
    got = config.resolve(config.merge(base, {"a": {"b": 3}}))
    assert got == {"a": {"b": 3, "c": 2}, "r": 3, "loop": "GLOBAL.loop", "no": "GLOBAL.x"} and base["a"]["b"] == 1
    assert config.override(base, "a.c", 5)["a"]["c"] == 5
    with pytest.raises(KeyError):
        config.override(base, "a.z", 5)


@pytest.mark.parametrize("n", [7, 10, 11, 13, 14])
def test_tracking_layouts(spark, tmp_path, n):
    line = ["3", "1", "1.0", "2.0", "3.0", "4.0", "0.9", "0", "-1", "{}"]
    line += {11: ["9"], 13: ["idle", "0.5", "2"], 14: ["9", "idle", "0.5", "2"]}.get(n, [])
    (tmp_path / "t.csv").write_text(",".join(line[:n]) + "\n")
    row = tables.with_defaults(tables.read_table(spark, str(tmp_path / "t.csv"), "tracking")).first()
    assert (row["Frame"], row["BBox_W"], row["JerseyInfo"], row["ActionLabel"]) == (3, 3.0, "{}", "idle" if n > 11 else "")


def test_tables(spark, tmp_path):
    assert tables.latest_version(["d/tracking.csv", "d/tracking-2.csv", "d/tracking-10.csv", "d/other-11.csv"], "tracking") == "d/tracking-10.csv"
    (tmp_path / "m.txt").write_text("0,1,1,1,1,1,1\n2,1,1,2,3,4,0.5,-1,-1,-1\nbad\n")
    rows = tables.read_mot(spark, str(tmp_path / "m.txt"))
    assert [tuple(r) for r in rows.collect()] == [(2, 1, 1.0, 2.0, 3.0, 4.0, 0.5)]
    tables.write_mot(rows, str(tmp_path / "out"))
    assert tables.read_mot(spark, str(tmp_path / "out")).count() == 1
    pose = spark.createDataFrame([(1, '{"predictions":[{"scores":[0.5]}]}'), (2, "{"), (3, None)], "Frame long, PoseJSON string")
    assert [r["pose"]["scores"] if r["pose"] else None for r in tables.pose_rows(pose).orderBy("Frame").collect()] == [[0.5], None, None]


@pytest.mark.parametrize("name", ["period_breaks", "roster_resolve", "iou_best_match", "interval_assign"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLE_SQL[name])
    cols = sorted(got.columns)
    key = lambda v: round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    assert sorted(tuple(key(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(key(dict(zip(want.columns, r))[c]) for c in cols) for r in want.fetchall())


def test_frames(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 5.0, 5.0, 10.0, 10.0), (1, 3, 20.0, 20.0, 5.0, 50.0)], "frame long, id long, x double, y double, w double, h double")
    assert [r["id"] for r in frames.non_overlapping(rows).collect()] == [3]
    assert sorted(r["id"] for r in frames.drop_largest(rows, 3).collect()) == [1, 2]
    assert [r["id"] for r in frames.min_height(rows, 20.0).collect()] == [3] and frames.min_height(rows, 99.0).count() == 3


def _brute_clusters(points, k):
    centres, member = points[:k].astype(float).tolist(), None
    while True:
        found = [min(range(k), key=lambda c: ((p[0] - centres[c][0]) ** 2 + (p[1] - centres[c][1]) ** 2, c)) for p in points]
        for c in set(found):
            inside = [p for p, m in zip(points, found) if m == c]
            centres[c] = [sum(p[0] for p in inside) / len(inside), sum(p[1] for p in inside) / len(inside)]
        if found == member:
            return found
        member = found


def test_clusters():
    rng = np.random.default_rng(1)
    for n, k in ((5, 3), (12, 2), (30, 3)):
        points = rng.normal(size=(n, 2)).round(3)
        assert groups.clusters(points, k, threshold=0).tolist() == _brute_clusters(points, k)


def test_end_outlier():
    boxes_ = np.array([[0, 0, 10, 10], [500, 0, 510, 10], [520, 0, 530, 10], [540, 0, 550, 10]], float)
    assert groups.end_outlier(boxes_) == 0 and groups.end_outlier(boxes_[::-1]) == 3
    assert groups.end_outlier(boxes_[1:], 2.0) is None and groups.end_outlier(np.repeat(boxes_[:1], 4, 0)) is None


def test_cluster_boxes(spark):
    rows = [(1, i, float(10 * i), 0.0, 4.0, 4.0) for i in range(4)] + [(1, 9, 900.0, 0.0, 4.0, 4.0)] + [(2, i, 0.0, 0.0, 1.0, 1.0) for i in range(3)]
    got = groups.cluster_boxes(spark.createDataFrame(rows, "frame long, id long, x double, y double, w double, h double"), outlier_ratio=None).collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 0.0, 34.0, 4.0)]


def test_pose_features_of_missing_poses(spark):
    rows = spark.createDataFrame([(1, '{"predictions":[{"scores":[0.5]}]}'), (2, "{"), (3, None), (4, '{"predictions":[{"bboxes":[[0,0,10,20]],"keypoint_scores":[[0.9,0.1]]}]}')], "Frame long, PoseJSON string")
    got = {r[0]: tuple(r)[1:] for r in training.pose_features(tables.pose_rows(rows), 100.0, 100.0, 2).collect()}
    assert got[2] == got[3] == (0.0,) * 8 and got[1] == (0.0,) * 6 + (0.5, 0.0)
    assert got[4] == (0.5, 0.05, 0.1, 0.0, 0.0, 0.2, 0.5, 0.5)


def test_layout_leaves_out_boxes_that_are_not_finite(spark):
    rows = [(1, 1, 50.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 0.0, 10.0, 10.0), (1, 3, float("nan"), 0.0, 1.0, 1.0), (2, 1, None, 0.0, 1.0, 1.0)]
    got = {r["frame"]: r["boxes"] for r in training.player_layout(spark.createDataFrame(rows, "frame long, id long, x double, y double, w double, h double"), 100.0, 100.0, 3).collect()}
    assert got == {1: [0.0, 0.0, 0.1, 0.1, 0.5, 0.0, 0.1, 0.1, 0.0, 0.0, 0.0, 0.0], 2: [0.0] * 12}


def test_split_tracks_refuses_an_eleventh_number(spark):
    rows = spark.createDataFrame([(7, 0, 12, 1), (7, 1, 14, 5)], "id long, sub int, number int, first_frame long")
    assert [r["track"] for r in jerseys.split_tracks(rows).collect()] == [7.0, 7.1]
    with pytest.raises(Exception, match="more than ten"):
        jerseys.split_tracks(rows.withColumn("sub", F.lit(10))).collect()


def test_loud_runs(spark):
    rows = spark.createDataFrame([(1, t, 9.0 if t in (3, 4, 5, 9) else 1.0) for t in range(12)], "game long, at long, energy double")
    assert [tuple(r) for r in media.loud_runs(rows, 0.5, 1, 2).collect()] == [(1, 3, 5)]
    assert media.loud_runs(rows.limit(0), 0.5, 1, 2).count() == 0


def test_null_boxes_share_nothing(spark):
    rows = spark.createDataFrame([(1, 1, None, 0.0, 9.0, 9.0), (1, 2, 0.0, 0.0, 9.0, 9.0)], "frame long, id long, x double, y double, w double, h double")
    assert sorted(r["id"] for r in frames.non_overlapping(rows).collect()) == [1, 2]
    got = {r[0] for r in rows.select(boxes.clamp(F.col("x"), F.lit(-1.0), F.lit(1.0))).collect()}
    assert got == {None, 0.0}


def _moves(machine, dests):
    s, out = machine.start(), []
    for f, d in enumerate(dests):
        s, rows = machine.step(s, (f, *d))
        out.append(rows[0][1:])
    return out


ARENA = (0.0, 0.0, 1000.0, 500.0)


def test_camera_box_reaches_a_resting_destination_and_stays_inside():
    mover = movers.CameraBox(ARENA, *(movers.Limits(s, s / 10, arrive=2) for s in (30.0, 15.0, 20.0, 10.0)))
    seen = _moves(mover, [(600.0, 200.0, 200.0, 100.0)] * 400)
    assert seen[-1] == pytest.approx((600.0, 200.0, 200.0, 100.0), abs=1.0)
    for x, y, w, h in seen:
        assert x >= -1e-6 and y >= -1e-6 and x + w <= 1000 + 1e-6 and y + h <= 500 + 1e-6
    for a, b in zip(seen, seen[1:]):
        assert abs((b[0] + b[2] / 2) - (a[0] + a[2] / 2)) <= 30 + 1e-6


def test_camera_box_brakes_evenly_where_the_direction_changes():
    r = movers.Limits(30.0, 100.0, brake=3, cooldown=2)
    a, speeds = dict(movers._STILL, v=30.0), []
    for _ in range(4):
        a = movers._tick(movers._steer(a, -50.0, r, False), r)
        speeds.append(a["v"])
    assert speeds == [20.0, 10.0, 0.0, -30.0] and a["cool"] == 0


def test_camera_box_keeps_its_aspect_and_bears_missing_destinations():
    mover = movers.CameraBox(ARENA, aspect=16 / 9, sticky=10.0, bands=(0.1, 0.1, 0.1, 0.1), smoothing=0.5)
    dests = [(300.0, 100.0, 160.0, 90.0), (None, 1.0, 1.0, 1.0), (float("nan"), 0.0, 1.0, 1.0), *[(10.0 * i, 50.0, 160.0, 90.0) for i in range(60)]]
    assert all(w / h == pytest.approx(16 / 9) for _, _, w, h in _moves(mover, dests))


def test_camera_box_of_few_players_looks_at_the_arena(spark):
    rows = [(1, 1, i, 100.0 * i, 50.0, 10.0, 20.0) for i in range(3)] + [(1, 2, i, 100.0 + 5 * i, 50.0, 10.0, 20.0) for i in range(6)]
    t = spark.createDataFrame(rows, "game long, frame long, id long, x double, y double, w double, h double")
    got = {r["frame"]: (r["x"], r["y"], r["w"], r["h"]) for r in movers.destinations(t, ARENA).collect()}
    assert got[1] == (0.0, 0.0, 1000.0, 500.0) and got[2][0] >= 100.0 and got[2][2] < 50.0
    assert movers.play(t.limit(0), [movers.CameraBox(ARENA)]).count() == 0
