"""The play tick, sound, appearance, feedback models, tiles, poses and small functions, by worked examples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane.functions import boxes, text
from tracklane.operators import frames, joins, poses, ranks, sound, tiles, training
from tracklane.plans import graph as G
from tracklane.sources import tables
from tracklane.streaming import folds, movers

ARENA = (0.0, 0.0, 1000.0, 500.0)


def _tick(mover, rows, **more):
    """Boxes' centres and speeds of one mover over rows (cx, few, v, ex)."""
    machine = movers.PlayTick((mover,), **more)
    s, out = machine.start(), []
    for k, (cx, few, v, ex) in enumerate(rows):
        s, ((_, _, x, _, w, _),) = machine.step(s, (k, cx - 50, 200.0, 100.0, 100.0, few, v, ex, 250.0))
        out.append((x + w / 2, s["movers"][0]["axes"]["x"]["v"], s["movers"][0]["nonstop"]))
    return out


def _mover(**more):
    still = movers.Limits(0.0, 0.0)
    return movers.CameraBox(ARENA, movers.Limits(30.0, 3.0, brake=4), movers.Limits(15.0, 1.5), still, still, first=(450.0, 200.0, 550.0, 300.0), **more)


def test_a_breakaway_pushes_the_camera_and_runs_non_stop():
    plain = _tick(_mover(), [(500.0, False, None, None)] * 3)
    assert [c for c, _, _ in plain] == [500.0] * 3
    rush = _tick(_mover(), [(500.0, False, 100.0, 700.0)] * 3 + [(500.0, False, None, None)] * 4)
    assert rush[0][:2] == (512.0, 12.0)  # 9 by the push (three times the limit), 3 by the destination half way
    assert [n for _, _, n in rush] == [2, 2, 2, 1, 0, 0, 0]
    # the destination is behind from the fourth frame on: only when non-stop mode has ended does the box brake
    speeds = [v for _, v, _ in rush]
    assert speeds[2] > speeds[3] > 0 and speeds[6] < speeds[5]
    few = _tick(_mover(), [(500.0, True, 100.0, 700.0)])
    assert few[0][:2] == (509.0, 9.0)


def test_an_overshot_camera_brakes():
    fast = movers.CameraBox(ARENA, movers.Limits(30.0, 30.0), movers.Limits(15.0, 1.5), *(movers.Limits(0.0, 0.0),) * 2, first=(450.0, 200.0, 550.0, 300.0))
    rows = [(900.0, False, None, None)] * 2 + [(900.0, False, 50.0, 400.0)]
    braked = _tick(fast, rows, overshoot_brake=6)
    assert [v for _, v, _ in braked] == [30.0, 30.0, 25.0]
    slowed = _tick(fast, rows, overshoot_brake=0, overshoot_ratio=0.5)
    assert slowed[2][1] == 30.0  # the destination speeds it up again within the frame


def test_braking_after_non_stop_mode():
    quick = movers.CameraBox(ARENA, movers.Limits(30.0, 30.0), movers.Limits(15.0, 1.5), *(movers.Limits(0.0, 0.0),) * 2, first=(100.0, 200.0, 200.0, 300.0), after_nonstop=3)
    out = _tick(quick, [(900.0, False, 200.0, 900.0)] + [(900.0, False, None, None)] * 5, nonstop=1)
    assert [n for _, _, n in out][:3] == [1, 0, 0] and [round(v, 6) for _, v, _ in out][1:4] == [30.0, 20.0, 0.0]


def test_a_chain_of_movers_in_one_fold(spark):
    rows = [(1, f, i, 100.0 + 20 * f + 30 * i, 100.0 + i, 10.0, 20.0) for f in range(1, 30) for i in range(6)]
    t = spark.createDataFrame(rows, "game long, frame long, id long, x double, y double, w double, h double")
    chain = [movers.CameraBox(ARENA, movers.Limits(60.0, 20.0)), movers.CameraBox(ARENA, movers.Limits(30.0, 5.0), aspect=16 / 9)]
    all_ = movers.ticks(t, chain)
    last = sorted(map(tuple, movers.play(t, chain).select("frame", "x", "w").collect()))
    assert last == sorted(map(tuple, all_.filter("mover = 1").select("frame", "x", "w").collect())) and all_.count() == 58
    one = folds.fold(folds.fold(movers.destinations(t, ARENA), chain[0], "game"), chain[1], "game")
    assert last == sorted(map(tuple, one.select("frame", "x", "w").collect()))


def test_rushes_take_the_foremost_and_of_equals_the_least_id(spark):
    rows = [(1, i, c, 10.0 * i, v) for i, c, v in ((1, 50.0, 9.0), (3, 90.0, 9.0), (2, 90.0, 6.0), (4, 99.0, 1.0))]
    m = spark.createDataFrame(rows, "frame long, id long, cx double, cy double, vx double")
    assert [tuple(r) for r in frames.rushes(m, 5.0, 0.5, 4).collect()] == [(1, 8.0, 90.0, 20.0)]
    assert frames.rushes(m, 5.0, 0.5, 5).count() == 0 and frames.rushes(m, 5.0, 0.75, 4).count() == 0
    target = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "frame long, l double, t double, r double, b double")
    ahead = lambda at: frames.breakaway(m, target, 5.0, 0.5, 4, view=spark.createDataFrame([(1, at)], "frame long, cx double")).first()
    assert ahead(89.0)["speeds"] and not ahead(91.0)["speeds"] and ahead(91.0)["push"] == 0.0


def test_identity_outlasts_an_occlusion():
    looks = {1: [1.0, 0.0], 2: [0.0, 1.0]}

    def row(who, x):
        return (x, 0.0, x + 10, 10.0, 0, 0.9, looks[who])

    def run(machine):
        s, seen = machine.start(), []
        for f, found in enumerate([[row(1, 0.0), row(2, 100.0)], [row(1, 2.0), row(2, 102.0)], [], [], [row(2, 4.0), row(1, 104.0)]]):  # they have changed places unseen
            s, out = machine.step(s, f, found)
            seen.append({r[1]: round(r[2], 1) for r in out})
        return seen

    seen = run(folds.Reidentified(least=0.3))
    assert seen[1] == {0: 1.2, 1: 101.2} and seen[2] == {} and set(seen[4]) == {0, 1} and seen[4][0] > 50 > seen[4][1]
    by_place = run(folds.Reidentified(least=0.3, look_weight=0.0))
    assert by_place[4][0] < 50 < by_place[4][1]
    short = folds.Reidentified(keep=2)
    s, _ = short.step(short.start(), 0, [row(1, 0.0)])
    s, _ = short.step(s, 2, [])
    assert s["tracks"] == []
    s, out = short.step(s, 3, [row(1, 0.0)[:5] + (0.2, None)])
    assert out == []  # seen, but not surely enough for a new track
    assert folds.Reidentified(slots=1).step(short.start(), 0, [row(1, 0.0), row(2, 50.0)])[1][0][1] == 0


def test_outputs_are_fed_back_over_all_games_at_once(spark):
    rows = [(g, f, [float(g), float(f)]) for g in range(5) for f in range(1, 8 + g)]
    df = spark.createDataFrame(rows, "game long, frame long, features array<double>")

    def model(x):
        return np.stack([x[:, :, 1].mean(1) + 0.5 * x[:, -1, 2]], 1)

    got = {(r["game"], r["frame"]): r["outputs"][0] for r in training.autoregressive(df, model, 1, 3, (1.0,)).collect()}
    want = {}
    for g in range(5):
        y, past = 1.0, []
        for f in range(1, 8 + g):
            past = [*past[-2:], f]
            y = sum(past) / len(past) + 0.5 * y
            want[g, f] = y
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    one = training.autoregressive(df, lambda x: x[:, -1, -1:] * 0 + 1.0, 1, 1, (0.0,), residual=0.3).filter("game = 0").orderBy("frame").collect()
    assert [round(r["outputs"][0], 6) for r in one][:4] == [0.3, 0.6, 0.9, 1.0]
    assert training.autoregressive(df.limit(0), model, 1, 3).count() == 0


def test_whistles_and_lags(spark):
    rate, rng = 8000, np.random.default_rng(2)
    x = rng.normal(0, 0.01, 24_000)
    at = slice(9000, 13_000)
    x[at] += np.sin(2 * np.pi * 3000 * np.arange(24_000)[at] / rate)
    rows = lambda v: spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(v)], "game long, i long, v double")
    b = sound.blocks(rows(x), 700).cache()
    assert sum(len(r["samples"]) for r in b.collect()) == 24_000
    w = max(sound.whistles(b, rate, 2950.0, 3050.0, 0.05, 0.8, 512, 128, ("game",)).collect(), key=lambda r: r["end"] - r["start"])
    assert abs(w["start"] - 9000 / rate) < 0.05 and abs(w["end"] - 13_000 / rate) < 0.05
    energy = {r["frame"]: r["energy"] for r in sound.band_energy(b, rate, 2500.0, 3500.0, 512, 128, frames_a_task=37).collect()}
    padded = np.r_[np.zeros(256), x, np.zeros(512)]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(512) / 512)
    db = np.array([20 * np.log10(np.maximum(np.abs(np.fft.rfft(padded[128 * k : 128 * k + 512] * hann)), 1e-5)) for k in range(1 + 24_000 // 128)])
    bins = (np.arange(257) * rate / 512 >= 2500) & (np.arange(257) * rate / 512 <= 3500)
    want = np.maximum(db, db.max() - 80)[:, bins].mean(1)
    assert len(energy) == len(want) and max(abs(energy[k] - v) for k, v in enumerate(want)) < 1e-6
    a, c = x[:3000], np.r_[np.zeros(311), x[:2600]]
    lag = lambda p, q, **m: sound.best_lag(sound.blocks(rows(p), 512), sound.blocks(rows(q), 512), 512, **m).first()["lag"]
    assert lag(a + 0.1, c) == int(np.argmax(np.correlate(a + 0.1, c, "full"))) - len(c) + 1
    assert lag(c, a, together=1) == 311 and lag(a, c, most=400) == -311
    assert spark.range(1).select(*sound.frame_offsets(F.lit(-311), 8000.0, 25.0)).first()[1] == pytest.approx(311 / 320)


def test_tiles_do_not_overlap_and_keep_their_order(spark):
    rng = np.random.default_rng(3)
    rows = [(f, k, int(rng.integers(1, 300)), int(rng.integers(1, 300))) for f in range(20) for k in range(1, 2 + f)]
    df = spark.createDataFrame(rows, "frame long, id long, w long, h long").withColumn("ord", F.col("id"))
    got: dict = {}
    for r in tiles.packed(df).collect():
        got.setdefault(r["frame"], []).append(r)
    for f, found in got.items():
        size = {k: (w, h) for g, k, w, h in rows if g == f}
        assert {r["id"]: (r["r"] - r["l"], r["b"] - r["t"]) for r in found} == size
        for i, p in enumerate(found):
            assert p["r"] <= p["width"] and p["b"] <= p["height"]
            assert all(p["r"] <= q["l"] or q["r"] <= p["l"] or p["b"] <= q["t"] or q["b"] <= p["t"] for q in found[i + 1 :])
        order = [r["id"] for r in sorted(found, key=lambda r: (r["t"], r["l"]))]
        assert order == sorted(order)


def test_actions_and_poses(spark):
    got = spark.range(1).select(poses.chosen_action(F.array(*map(F.lit, (0.2, 0.7, 0.7, 0.1))), ["a", "b"], 3, 0.5).alias("a"), poses.chosen_action(F.array(*map(F.lit, (0.1, 0.2, 0.9))), ["a"], 1).alias("b"), poses.chosen_action(F.array(F.lit(0.4)), None, 1, 0.5).alias("c")).first()
    assert tuple(got["a"]) == ("b", 1, 0.7, [1, 2, 0], [0.7, 0.7, 0.2]) and got["b"]["label"] == "2" and got["c"] is None
    tracks = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 100.0, 0.0, 10.0, 10.0)], "frame long, id long, x double, y double, w double, h double")
    pose = spark.createDataFrame([(1, 7, [[0.0, 0.0], [10.0, 3.0]], [1.0, 1.0]), (1, 8, [[0.0, 0.0], [10.0, 9.0]], [1.0, 1.0])], "frame long, pose long, points array<array<double>>, scores array<double>")
    found = {r["id"]: r["points"] for r in poses.matched(tracks, pose).collect()}
    assert found == {1: [[0.0, 0.0], [10.0, 9.0]], 2: None}
    assert {r["id"] for r in poses.matched(tracks, pose, 0.9).filter("points is not null").collect()} == {1}


def test_numbers_along_an_order(spark):
    df = spark.createDataFrame([(k * 7 % 101, "x" if k % 2 else None) for k in range(101)], "k long, v string")
    assert [(r["n"], r["k"]) for r in ranks.numbered(df, "n", "k").orderBy("n").collect()] == [(k + 1, k) for k in range(101)]
    assert ranks.numbered(df.limit(0), "n", "k").count() == 0


def test_a_barrier_wants_each_key_once(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 1)], "frame long, a long"), spark.createDataFrame([(1, 5), (1, 6)], "frame long, b long")
    assert G.barrier(a, b).count() == 2
    with pytest.raises(Exception, match="same keys twice"):
        G.barrier(a, b, once=True).collect()
    assert G.barrier(a, b.limit(1), once=True).count() == 1


def test_training_side_layouts(spark, tmp_path):
    base = ["Frame", "ID", "BBox_X", "BBox_Y", "BBox_W", "BBox_H", "Scores", "Labels", "Visibility", "JerseyInfo"]
    assert tables.training_layout(8) == tables.training_layout(10) == base
    assert tables.training_layout(11)[-1] == "PoseIndex" and tables.training_layout(13)[-1] == "ActionIndex" and tables.training_layout(16)[10] == "PoseIndex"
    with pytest.raises(ValueError):
        tables.training_layout(12)
    (tmp_path / "a.csv").write_text("1,2,3,4,5,6,0.5,0,-1,{},9,run,0.5,3,extra\n")
    assert tuple(tables.read_training_tracks(spark, str(tmp_path / "a.csv")).first())[8:] == (-1, "{}", "run", 0.5, 3)
    (tmp_path / "b.csv").write_text("1,2,3,4,5,6\n")
    assert tuple(tables.read_training_tracks(spark, str(tmp_path / "b.csv")).first())[5:] == (6.0, None, None, None, None)


def test_extents_and_scales(spark):
    rows = spark.createDataFrame([("a", 10.0, 5.0, 5.0, 5.0), ("b", 100.0, -9.0, 2.0, 1.0), ("c", float("nan"), 1.0, 1.0, 1.0)], "game string, x double, y double, w double, h double")
    games = frames.max_extents(rows, keys=("game",))
    got = {r["game"]: (r["max_x"], r["max_y"]) for r in games.collect()}
    assert got == {"a": (15.0, 10.0), "b": (102.0, 1080.0), "c": (1920.0, 2.0)}
    assert tuple(frames.extents_over(games.filter("game <> 'c'")).first()) == (102.0, 1080.0) and tuple(frames.extents_over(games.limit(0)).first()) == (0.0, 0.0)
    assert [r["game"] for r in frames.beyond_scale(games, 102.0, 500.0).orderBy("game").collect()] == ["b", "c"]


def test_small_functions(spark, tmp_path):
    row = spark.range(1).select(
        F.struct(*[c.alias(n) for c, n in zip(boxes.rotated_size(F.lit(40.0), F.lit(20.0), F.lit(90.0)), "wh")]).alias("rotated"),
        F.struct(*[c.alias(n) for c, n in zip(boxes.center_aspect_height(tuple(F.lit(v) for v in (10.0, 20.0, 30.0, 60.0))), "xyah")]).alias("xyah"),
        boxes.is_close(F.lit(1.0), F.lit(1.0 + 1e-10)).alias("close"), boxes.is_close(F.lit(1.0), F.lit(1.1)).alias("far"), text.slug(F.lit(" Ice  Hockey: Game-7 ")).alias("slug"),
    ).first()
    assert row["close"] and not row["far"] and tuple(row["xyah"]) == (20.0, 40.0, 0.5, 40.0)
    assert all(math.isclose(a, b, abs_tol=1.0) for a, b in zip(row["rotated"], (20.0, 40.0)))
    assert row["slug"] == "ice-hockey-game-7"
    hosts = text.expand_hosts(spark.createDataFrame([("node[1-3,07]",), ("one",)], "l string"), "l")
    assert sorted(r["host"] for r in hosts.collect()) == ["node07", "node1", "node2", "node3", "one"]
    (tmp_path / "lines.txt").write_text("a\n\n# b\nc\n")
    counted = tables.count_lines(spark, str(tmp_path / "lines.txt"))
    assert counted.first()["n"] == 2


def test_as_of_and_overlaps(spark):
    rng = np.random.default_rng(6)
    left = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 200), rng.integers(0, 300, 200))]
    right = [(int(g), float(x), k) for k, (g, x) in enumerate(zip(rng.integers(0, 2, 60), rng.integers(20, 300, 60)))]
    a, b = spark.createDataFrame(left, "game long, at double"), spark.createDataFrame(right, "game long, at double, v long").withColumn("k", F.col("v"))

    def want(g, x, within=1e9):
        before = [(r[1], r[2]) for r in right if r[0] == g and r[1] <= x]
        return max(before)[1] if before and x - max(before)[0] <= within else None

    key = lambda r: (*r[:2], -1 if r[2] is None else r[2])
    for span in (1.0, 7.0, 1000.0):
        assert sorted(map(key, joins.as_of(a, b, "at", ("v",), span, order="k").collect())) == sorted(key((g, x, want(g, x))) for g, x in left)
    near = joins.as_of(a, b, "at", ("v",), 9.0, order="k", within=4.0).collect()
    assert sorted(map(key, near)) == sorted(key((g, x, want(g, x, 4.0))) for g, x in left)
    assert {r["v"] for r in joins.as_of(a, b.limit(0), "at", ("v",), 9.0).collect()} == {None}
    spans = [(g, x, x + (i % 5) * 4) for i, (g, x) in enumerate(left)]
    s = spark.createDataFrame([(g, p, q, i) for i, (g, p, q) in enumerate(spans)], "game long, start double, end double, i long")
    for width in (3.0, 50.0):
        got = sorted((r["i"], r["i_"]) for r in joins.overlapping(s, s, width).collect())
        assert got == sorted((i, j) for i, x in enumerate(spans) for j, y in enumerate(spans) if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
