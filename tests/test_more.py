"""Worked examples of records, sources, alignment, reports, trackers and graph tools."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane import catalog
from tracklane.functions import boxes, text
from tracklane.operators import jerseys, poses, reports, training
from tracklane.plans import config
from tracklane.plans import graph as G
from tracklane.sources import alignment, records, tables
from tracklane.streaming import folds

SF = "/root/testdata/sf0.001"


def test_detections_are_read_back(spark, tmp_path):
    rows = [(f, [[0.0, 1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0]], [0.9, 0.8], [1, 2]) for f in (1, 2, 3)]
    path = records.save_detections(spark.createDataFrame(rows, "frame long, bboxes array<array<double>>, scores array<double>, labels array<long>"), str(tmp_path), "run_")
    assert path.endswith("/run_detections.csv")
    got = [tuple(r) for r in tables.read_table(spark, path, "detections").orderBy("Frame", "BBox_X1").collect()]
    assert got == [(f, *b) for f in (1, 2, 3) for b in ((0.0, 1.0, 2.0, 3.0, 0.9, 1), (4.0, 5.0, 6.0, 7.0, 0.8, 2))]


def test_tracks_are_read_back_with_jersey_and_action(spark, tmp_path):
    rows = [(f, [1, 2], [[10.0 + f, 20.0, 40.0, 60.0], [0.0, 0.0, 5.0, 5.0]], [0.95, 0.5], [0, 0], [True, f != 2]) for f in (1, 2, 3)]
    samples = spark.createDataFrame(rows, "frame long, ids array<long>, bboxes array<array<double>>, scores array<double>, labels array<long>, mask array<boolean>")
    jersey = spark.createDataFrame([(1, 1, 12, 0.5, 1), (1, 1, 14, 0.6, 2)], "frame long, tracking_id long, number int, score double, ord int")
    action = spark.createDataFrame([(3, 1, "idle", 0.9, 4), (3, -1, "x", 1.0, 5)], "frame long, tracking_id long, label string, score double, label_index long")
    path = records.save_tracking(samples, str(tmp_path), None, jersey, action)
    got = tables.jersey_info(tables.read_table(spark, path, "tracking")).orderBy("Frame", "ID").collect()
    assert [(r["Frame"], r["ID"]) for r in got] == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)]
    assert (got[0]["BBox_X"], got[0]["BBox_W"], got[0]["BBox_H"]) == (11.0, 29.0, 40.0)
    assert got[0]["jersey"]["number"] == 14 and got[1]["jersey"] is None and got[1]["JerseyInfo"] == "{}"
    assert got[3]["ActionLabel"] == "idle" and (got[4]["ActionIndex"], got[4]["ActionScore"]) == (-1, 0.0)


def test_poses_actions_and_cameras_are_read_back(spark, tmp_path):
    frames = spark.createDataFrame([(1,), (2,)], "frame long")
    pose = spark.createDataFrame([(1, [([[1.0, 2.0]] * 17, [0.5] * 17)])], "frame long, p array<struct<k: array<array<double>>, s: array<double>>>")
    pose = pose.select("frame", F.transform("p", lambda p: F.struct(F.array(p["k"]).alias("keypoints"), F.array(p["s"]).alias("keypoint_scores"))).alias("predictions"))
    got = {r["Frame"]: r for r in tables.read_table(spark, records.save_pose(frames, pose, str(tmp_path)), "pose").collect()}
    assert got[2]["PoseJSON"] == '{"predictions":[]}'
    back = tables.pose_rows(spark.createDataFrame(list(got.values()))).filter("Frame = 1").first()["pose"]
    assert len(back["keypoints"][0]) == 17 and back["keypoint_scores"][0][0] == 0.5
    acts = spark.createDataFrame([(1, [(1, "idle", 0, 0.9)])], "frame long, actions array<struct<tracking_id: long, label: string, label_index: long, score: double>>")
    rows = tables.action_rows(tables.read_table(spark, records.save_actions(acts, str(tmp_path)), "actions")).collect()
    assert [(r["Frame"], r["tracking_id"], r["label"], r["score"]) for r in rows] == [(1, 1, "idle", 0.9)]
    boxes_ = spark.createDataFrame([(1, [0.0, 0.0, 100.0, 50.0])], "frame long, box array<double>")
    slow, fast = records.save_camera(boxes_, boxes_.withColumn("box", F.array(*map(F.lit, (10.0, 5.0, 90.0, 45.0)))), str(tmp_path), "a")
    assert tuple(tables.read_table(spark, fast, "camera").first()) == (1, 10.0, 5.0, 80.0, 40.0) and slow.endswith("/a-camera.csv")
    bundle = alignment.game_bundle(spark, str(tmp_path), tracking="actions.csv", camera="a-camera.csv")
    assert bundle["camera"].endswith("a-camera.csv") and bundle["pose"].endswith("pose.csv") and bundle["camera_fast"] is None
    assert alignment.game_bundle(spark, str(tmp_path / "none")) is None


def test_streams_are_appended_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = records.append_stream(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_iterables_as_a_source(spark):
    class Numbers(alignment.Rows):
        columns = "value int"
        make = staticmethod(lambda part, parts: iter(range(part, 7, parts)))

    spark.dataSource.register(Numbers)
    got = [tuple(r) for r in spark.read.format("numbers").options(parts=2, repeat=2, batch_size=3).load().orderBy("part", "batch", "value").collect()]
    assert len(got) == 14 and got[:3] == [(0, 0, 0), (0, 0, 2), (0, 0, 4)] and got[-1][0] == 1
    with pytest.raises(Exception, match="strict"):
        spark.read.format("numbers").option("strict", "true").load().collect()


def test_texts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 3, 1.0, 2.0, 3.0, 4.0, 0.5), (2, -1, 0.0, 0.0, 1.0, 1.0, 0.1)], "frame long, id long, x double, y double, w double, h double, score double")
    tables.write_mot(rows, str(tmp_path / "k"), kitti=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "k")).collect()] == ["0 3 pedestrian 0 0 -10 1.000000 2.000000 4.000000 6.000000 -10 -10 -10 -1000 -1000 -1000 -10"]
    tables.write_points(rows, str(tmp_path / "p"))
    assert tables.read_points(spark, str(tmp_path / "p")).count() == 2
    shifts = spark.createDataFrame([(1, 7, 0, 1.0, 9.0), (1, 7, 1, 100.0, float("inf"))], "game int, number int, shift int, start double, duration double")
    assert [r["line"] for r in reports.highlights(shifts).orderBy("shift").collect()] == ["00:00:00    00:00:10", "00:01:37    "]
    reports.write_highlights(shifts, str(tmp_path / "h"))
    assert spark.read.text(str(tmp_path / "h")).filter("number = 7").count() == 2
    both = reports.combined_stats({"home": spark.createDataFrame([("b", "1")], "player string, toi string"), "away": spark.createDataFrame([("a",)], "player string")}, "home")
    reports.write_tsv(both.coalesce(1), str(tmp_path / "t"))
    assert [tuple(r) for r in tables.read_tsv(spark, str(tmp_path / "t")).collect()] == [("a", "", "away"), ("b", "1", "home")]
    row = spark.createDataFrame([(29.97, "Ｈéllo  wörld")], "r double, s string").select(text.best_rational("r").alias("r"), text.normal_label(F.col("s"), "abcdefghijklmnopqrstuvwxyz", 20).alias("s")).first()
    assert row["r"] == "2997/100" and row["s"] == "elloworld"
    import pandas as pd

    assert list(reports.ascii_label(pd.Series(["Ｈé", None]))) == ["He", None]
    assert alignment.free_name(["a.wav", "a-1.wav"], "a.wav") == "a-2.wav" and alignment.free_name([], "b") == "b"


def test_shifts_join_neighbours_and_a_duration_that_equals_a_start(spark):
    starts = spark.createDataFrame([(1, s) for s in (0.0, 10.0, 20.0, 30.0)], "game int, start double")
    seen = spark.createDataFrame([(1, 0.0, 7), (1, 10.0, 7), (1, 30.0, 7), (1, 10.0, 8), (1, 0.0, 9), (1, 20.0, 9), (1, 20.0, 6)], "game int, start double, number int")
    got = {}
    for r in jerseys.shifts(seen, starts).orderBy("number", "shift").collect():
        got.setdefault(r["number"], []).append((r["start"], r["duration"]))
    assert got == {7: [(0.0, 20.0), (30.0, float("inf"))], 8: [(10.0, 10.0)], 9: [(0.0, 10.0), (20.0, 10.0)], 6: [(20.0, 10.0)]}
    odd = spark.createDataFrame([(1, 0.0, 5), (1, 20.0, 5)], "game int, start double, number int")
    joined = jerseys.shifts(odd, spark.createDataFrame([(1, s) for s in (0.0, 20.0, 40.0)], "game int, start double")).collect()
    assert [(r["start"], r["duration"]) for r in joined] == [(0.0, 40.0)]
    apart = jerseys.shifts(spark.createDataFrame([(1, 10.0, 5), (1, 30.0, 5)], "game int, start double, number int"), spark.createDataFrame([(1, s) for s in (10.0, 20.0, 30.0, 40.0)], "game int, start double")).collect()
    assert sorted((r["start"], r["duration"]) for r in apart) == [(10.0, 10.0), (30.0, 10.0)]
    quirk = jerseys.shifts(spark.createDataFrame([(1, 5.0, 5), (1, 30.0, 5)], "game int, start double, number int"), spark.createDataFrame([(1, s) for s in (5.0, 35.0 - 5.0, 40.0)], "game int, start double")).collect()
    assert [(r["start"], r["duration"]) for r in quirk] == [(5.0, 35.0)]


def test_pose_regions(spark):
    pts = [[float(10 * i), float(5 * i)] for i in range(17)]
    df = spark.createDataFrame([(pts, [0.9] * 17, 200.0), (pts, [0.9] * 6 + [0.1] * 11, 200.0), (pts, [0.1] * 17, 200.0)], "p array<array<double>>, s array<double>, w double")
    got = df.select(poses.torso_region(F.col("p"), F.col("s"), 1000, 1000).alias("t"), poses.side_view(F.col("p"), F.col("s"), F.col("w"), 0.01).alias("v"), poses.arm_region(F.col("p"), F.col("s"), 1000, 1000, "left").alias("a")).collect()
    assert tuple(got[0]["t"]) == (45, 20, 125, 60) and got[0]["v"] is None
    assert got[1]["t"] is None and got[1]["v"] == "left" and got[1]["a"] is None and got[2]["v"] is None
    pad = int(0.45 * np.hypot(20, 10))
    assert tuple(got[0]["a"]) == (50 - pad, 25 - int(0.25 * pad), 90 + pad, 45 + int(0.75 * pad))
    box = spark.range(1).select(F.array(*poses.torso_fallback(tuple(F.lit(float(v)) for v in (10, 20, 60, 120)), 1000, 1000)).alias("b")).first()["b"]
    assert box == [20, 45, 50, 115]


def _sum(cost, pairs, most):
    n, m = cost.shape
    return sum(cost[i, j] for i, j in pairs) + (n + m - 2 * len(pairs)) * most / 2


def test_optimal_pairs():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 3), (4, 2), (2, 5), (4, 4)):
        for _ in range(20):
            cost, most = rng.random((n, m)).round(2), 0.6
            got = folds.optimal_pairs(cost, most)
            assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
            best = min(_sum(cost, p, most) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for columns in itertools.permutations(range(m), k) for p in [list(zip(rows, columns))])
            assert _sum(cost, got, most) == pytest.approx(best)
    trap = np.array([[0.10, 0.11], [0.12, 0.9]])
    assert folds.greedy_pairs(trap, 0.95) == [(0, 0), (1, 1)] and folds.optimal_pairs(trap, 0.95) == [(0, 1), (1, 0)]


def test_user_ids_hide_tentative_tracks():
    m = folds.Associations(user_ids=True)
    box = lambda x, s: (float(x), 0.0, x + 10.0, 20.0, 0, s)
    s, out = m.step(m.start(), 0, [box(0, 0.9)])
    assert [o[1] for o in out] == [1]
    for f in (1, 2, 3):
        s, out = m.step(s, f, [box(0, 0.9), box(100, 0.9)])
        assert [o[1] for o in out] == ([1] if f < 3 else [1, 2])
    s, out = m.step(s, 0, [box(500, 0.9)])
    assert [o[1] for o in out] == [1]


def test_center_points():
    m = folds.CenterPoints(keep=1)
    s, out = m.step(m.start(), 1, [(0.0, 0.0, 10.0, 10.0, 0, 1.0)])
    s, out = m.step(s, 2, [(100.0, 0.0, 110.0, 10.0, 0, 1.0)])
    assert [o[1] for o in out] == [1] and len(s["tracks"]) == 2
    s, _ = m.step(s, 3, [])
    assert len(s["tracks"]) == 1


def test_gating_distance():
    mean, cov = np.array([10.0, 10.0, 0.5, 20.0, 0, 0, 0, 0]), np.eye(8)
    d = folds.gating_distance(mean, cov, np.array([mean[:4], mean[:4] + [1, 0, 0, 0]]))
    assert d[0] == 0 and d[1] == pytest.approx(1 / (1 + 1))


def test_a_tracker_streams_like_its_batch(spark, tmp_path):
    t = catalog.tracks(spark, SF)
    rows = t.select("game", "frame", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.lit(0).cast("long").alias("label"), F.col("score").cast("double").alias("score"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, folds.fold(rows, folds.Associations(assignment="optimal"), "game").collect()))
    q = folds.fold_stream(stream, folds.Associations(assignment="optimal"), "game", idle_ms=3_600_000).writeStream.format("memory").queryName("ids").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(60):  # time-outs keep such a query busy, so it never is at rest
        if spark.table("ids").count() == len(want):
            break
        time.sleep(1)
    q.stop()
    assert sorted(map(tuple, spark.table("ids").collect())) == want


def test_graph_names_the_lowest_ancestor():
    n = lambda name, *d, joins=False: G.Node(name, lambda *x: x[0], list(d), joins=joins)
    with pytest.raises(ValueError, match="several inputs"):
        G.Graph([n("a"), n("b", "a"), n("c", "a", "b")])
    g = G.Graph([n("a"), n("b", "a"), n("c", "b"), n("d", "b"), n("e", "c", "d", joins=True), n("f", "e")])
    assert g.two_paths("a", "e") == [["a", "b", "c", "e"], ["a", "b", "d", "e"]]
    assert '"b" -> "c" [color=red' in g.dot(g.two_paths("b", "e")) and "shape=diamond" in g.dot()


def test_audits(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 4).alias("frame"), F.col("id").alias("v"))
    made = {"a": rows, "b": rows.groupBy("frame").agg(F.sum("v").alias("s"))}
    G.write_audit(G.audit(made), str(tmp_path / "a"))
    (tmp_path / "a" / "part-x.json").write_text('{"frame": "bad\n')
    back = G.read_audit(spark, str(tmp_path / "a"))
    assert back.count() == 8 and G.unequal(G.audit(made), back).count() == 0
    other = {"a": rows.withColumn("v", F.when(F.col("v") == 5, 6).otherwise(F.col("v"))), "b": made["b"]}
    assert [tuple(r) for r in G.unequal(G.audit(other), back).collect()] == [(1, "a")]
    assert G.same_under_stress(spark, lambda: made)
    assert not G.same_under_stress(spark, lambda: {"x": rows.withColumn("p", F.lit(spark.conf.get("spark.sql.shuffle.partitions")))})


def test_settings(tmp_path):
    steps = [{"type": "a", "k": 1}, {"type": "b"}, {"type": "a"}]
    assert [k for k, _ in config.items({"pipeline": steps}, "a")] == [0, 2]
    assert config.with_items(steps, "a", {"k": 5}, "c")[2] == {"type": "c", "k": 5} and steps[0]["k"] == 1
    assert config.put({}, "x.y", 1) == {"x": {"y": 1}} and config.load("fractions.Fraction", numerator=3) == 3
    assert config.controller(None, None) == "rule" and config.controller("drivegpt", "m") == "gpt"
    with pytest.raises(ValueError):
        config.controller("drivegpt", None)
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("x: {y: 1, z: 2}\n")
    (tmp_path / "b.yaml").write_text("x: {y: 3}\n")
    assert config.read(str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"), str(tmp_path / "none.yaml")) == {"x": {"y": 3, "z": 2}}


def test_hashes_of_a_graph_cover_inputs():
    one = {"a": ("1", []), "b": ("2", ["a", "lib"]), "c": ("3", ["b", "a"])}
    two = one | {"a": ("9", [])}
    h, k = reports.hash_graph(one), reports.hash_graph(two)
    assert all(h[n] != k[n] for n in one) and reports.hash_graph(one | {"c": ("4", ["b", "a"])})["b"] == h["b"]
    with pytest.raises(ValueError):
        reports.hash_graph({"a": ("", ["b"]), "b": ("", ["a"])})


def test_models_and_table_functions(spark):
    rows = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [[0.0, 0.0], [1.0, 1.0]])], "frame long, w array<array<double>>")
    got = training.with_model(rows, "w", lambda a: a.mean(1), "cx double, cy double").orderBy("frame").collect()
    assert [(r["cx"], r["cy"]) for r in got] == [(2.0, 3.0), (0.5, 0.5)]
    assert training.transformed(rows, lambda p: p.assign(frame=p["frame"] + 1)).agg(F.sum("frame")).first()[0] == 5
    spark.udtf.register("split_track", jerseys.SplitTrack)
    assert [tuple(r) for r in spark.sql("SELECT * FROM split_track(7L, array(14, 12), array(5L, 1L))").collect()] == [(7.0, 12, 1), (7.1, 14, 5)]


def test_clamp_if_close(spark):
    assert spark.range(1).select(boxes.clamp_if_close(F.lit(10.05), F.lit(0.0), F.lit(10.0), 0.1)).first()[0] == 10.0
    with pytest.raises(Exception, match="far beyond"):
        spark.range(1).select(boxes.clamp_if_close(F.lit(11.0), F.lit(0.0), F.lit(10.0), 0.1)).collect()
