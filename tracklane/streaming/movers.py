"""A camera box that follows destinations under limits of speed, and the play tick that makes the destinations.

The mover is a machine for `folds.fold` and `folds.fold_stream`: keys are games, whose frames follow one another. Its output
has the columns of its input, so movers are chained by folding again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import boxes
from ..operators import groups
from . import folds


@dataclass(frozen=True)
class Limits:
    """How one axis may change, in pixels and frames.

    `brake`: frames of even braking to a stop at a change of direction (0: the speed is halved instead). `cancel`: turning
    back again ends the braking, after `patience` frames. `cooldown`: frames without new braking. `arrive`: frames in which
    the destination should not be overrun (0: no limit); `rest`: speed under which arriving ends. `grow`: factor of the
    acceleration upwards. `soften`: a change of direction pushes with a quarter.
    """

    speed: float
    push: float
    brake: int = 0
    soften: bool = True
    cancel: bool = False
    patience: int = 0
    cooldown: int = 0
    arrive: int = 0
    rest: float = 0.0
    grow: float = 1.0


_STILL = {"v": 0.0, "brake": 0, "slow": 0.0, "toward": 0.0, "against": 0, "cool": 0}


def _sign(v: float) -> float:
    return (v > 0) - (v < 0)


def _clip(v: float, lo: float, hi: float) -> float:
    return max(lo, min(v, hi))


def _steer(a: dict, away: float, r: Limits, only_faster: bool, nonstop: bool = False) -> dict:
    """The axis after a look at how far away its destination is; sizes are held back from overrunning only while getting faster. In non-stop mode a change of direction does not brake."""
    a, push = dict(a), away
    if not nonstop and not a["brake"] and not a["cool"] and away * a["v"] < 0:
        fast = abs(a["v"]) >= r.speed / 6
        if r.brake and fast:
            a.update(brake=r.brake, slow=-a["v"] / r.brake, toward=_sign(away))
        else:
            a["v"] = a["v"] / 2 if fast else 0.0
            push = away / 4 if r.soften else away
    if a["brake"]:
        if r.cancel and away and _sign(away) == -a["toward"]:
            a["against"] += 1
            if a["against"] >= r.patience:
                a.update(brake=0, slow=0.0, against=0, cool=r.cooldown)
        else:
            a["against"], push = 0, a["slow"]
    before, most = a["v"], r.push * (r.grow if push > 0 else 1.0)
    v = _clip(before + _clip(push, -most, most), -r.speed, r.speed)
    if r.arrive and away and _sign(v) == _sign(away) and (not only_faster or abs(v) > abs(before)):
        v = _clip(v, -abs(away) / r.arrive, abs(away) / r.arrive)
        if r.rest and abs(away) <= r.rest * r.arrive and abs(v) <= r.rest:
            v = 0.0
    if only_faster and a["brake"] and abs(v) < abs(a["slow"]):
        v = 0.0
    a["v"] = v
    return a


def _braking(a: dict, frames: int) -> dict:
    """The axis brought to a stop over so many frames."""
    return {**a, "brake": frames, "slow": -a["v"] / frames, "toward": _sign(a["v"])}


def _tick(a: dict, r: Limits) -> dict:
    """The axis a frame later: braking that has run its frames has stopped it."""
    a = dict(a)
    if a["brake"]:
        a["brake"] -= 1
        if not a["brake"]:
            a.update(v=0.0, slow=0.0, cool=r.cooldown)
    a["cool"] = max(0, a["cool"] - 1)
    return a


@dataclass(frozen=True)
class CameraBox:
    """Follows destinations (TLWH, one a frame) inside an arena (TLBR).

    `sticky`: the box's width over the distance of the destination under which it stops, until the destination is `loose`
    times so far away; None: never. `first`: the box at the start; None: the arena. In non-stop mode, which a push can begin, neither stickiness nor a change of
    direction stops the box; if it is fast when that ends, it brakes for `after_nonstop` frames. `bands`: shares of the size by which a destination must be larger (width, height) or
    smaller (width, height) to change it; None: any. A destination that is not finite steers nothing; the box drifts on.
    """

    arena: tuple[float, float, float, float]
    across: Limits = field(default_factory=lambda: Limits(30.0, 3.0))
    down: Limits = field(default_factory=lambda: Limits(15.0, 1.5))
    width: Limits = field(default_factory=lambda: Limits(10.0, 1.0, grow=2.0))
    height: Limits = field(default_factory=lambda: Limits(5.0, 0.5, grow=2.0))
    least: tuple[float, float] = (10.0, 10.0)
    aspect: float | None = None
    smoothing: float = 0.0
    sticky: float | None = None
    loose: float = 2.0
    bands: tuple[float, float, float, float] | None = None
    margin: float = 0.0
    first: tuple[float, float, float, float] | None = None
    after_nonstop: int = 0

    output = "frame bigint, x double, y double, w double, h double"
    columns = ("frame", "x", "y", "w", "h")

    def start(self) -> dict:
        """Still, over the first box."""
        return {"box": list(self.first or self.arena), "axes": {k: dict(_STILL) for k in "xywh"}, "aim": None, "held": False, "fixed": False, "nonstop": 0}

    def pushed(self, s: dict, accel: float, scale: float, nonstop: int) -> dict:
        """Sideways faster, under limits times `scale`, and non-stop for so many frames."""
        fast = lambda v, r: _clip(v, -r.speed * scale, r.speed * scale)
        most, x, y = self.across.push * scale, s["axes"]["x"], s["axes"]["y"]
        axes = {**s["axes"], "x": {**x, "v": fast(x["v"] + _clip(accel, -most, most), self.across)}, "y": {**y, "v": fast(y["v"], self.down)}}
        return {**s, "axes": axes, "nonstop": nonstop + 1 if nonstop else 0}

    def braked(self, s: dict, frames: int, ratio: float) -> dict:
        """Sideways braked to a stop over so many frames; without any, slowed down to the ratio at once."""
        x = s["axes"]["x"]
        return {**s, "axes": {**s["axes"], "x": _braking(x, frames) if frames else {**x, "v": x["v"] * ratio}}}

    def _blocked(self, box: list[float], way: tuple[float, float]) -> tuple[bool, bool]:
        """Axes on which the box stands at an edge of the arena and would go further."""
        a, m = self.arena, self.margin
        return tuple((box[i] <= a[i] - m and way[i] < 0.1) or (box[i + 2] >= a[i + 2] + m and way[i] > -0.1) for i in (0, 1))

    def _stick(self, box: list[float]) -> float:
        """Distance under which the box stops: less near the middle of the arena, where play is fast."""
        wide = self.arena[2] - self.arena[0]
        bell = math.exp(-(((box[0] + box[2]) / 2 - (self.arena[0] + self.arena[2]) / 2) ** 2) / (2 * (wide / 8) ** 2))
        return min((box[2] - box[0]) / self.sticky, self.across.speed * 5 + 6 * (1 - bell))

    def _steered(self, s: dict, dest: tuple[float, ...]) -> dict:
        box, axes = s["box"], dict(s["axes"])
        w, h = box[2] - box[0], box[3] - box[1]
        grow_w, grow_h = dest[2] - w, dest[3] - h
        fixed = False
        if self.bands:
            up_w, up_h, low_w, low_h = self.bands
            past = lambda d, up, low: d > up or d < -low
            fixed = not (past(grow_w, up_w * w, low_w * w) or grow_h > up_h * h)
            grow_w, grow_h = grow_w * past(grow_w, up_w * w, low_w * w), grow_h * past(grow_h, up_h * h, low_h * h)
        if not fixed:
            axes["w"], axes["h"] = _steer(axes["w"], grow_w, self.width, True), _steer(axes["h"], grow_h, self.height, True)
        aim = [dest[0] + dest[2] / 2, dest[1] + dest[3] / 2]
        if self.smoothing and s["aim"]:
            aim = [p + min(1.0, self.smoothing) * (q - p) for p, q in zip(s["aim"], aim, strict=True)]
        away = [aim[0] - (box[0] + box[2]) / 2, aim[1] - (box[1] + box[3]) / 2]
        for i, stop in enumerate(self._blocked(box, tuple(away))):
            if stop:
                away[i], axes["xy"[i]] = 0.0, {**axes["xy"[i]], "v": 0.0}
        held = s["held"]
        if self.sticky and not s["nonstop"]:
            far, near = math.hypot(*away), self._stick(box)
            loose = self.loose if self.loose >= 1 else 1 / max(self.loose, 1e-3)
            if far >= near * loose if held else far <= near:
                held = not held
                for k in "xy":
                    axes[k] = {**axes[k], "v": 0.0}
        going = s["nonstop"] > 0
        axes["x"], axes["y"] = _steer(axes["x"], away[0], self.across, False, going), _steer(axes["y"], away[1], self.down, False, going)
        return {**s, "box": box, "axes": axes, "aim": aim, "held": held, "fixed": fixed}

    def _advanced(self, s: dict) -> dict:
        v = {k: a["v"] for k, a in s["axes"].items()}
        dx, dy = (0.0, 0.0) if s["held"] and not s["nonstop"] else (v["x"], v["y"])
        dw, dh = (0.0, 0.0) if s["fixed"] else (v["w"], v["h"])
        a, b = self.arena, s["box"]
        most = a[2] - a[0], a[3] - a[1]
        cx, cy = (b[0] + b[2]) / 2 + dx, (b[1] + b[3]) / 2 + dy
        w, h = max(b[2] - b[0] + dw, self.least[0]), max(b[3] - b[1] + dh, self.least[1])
        about = lambda cx, cy, w, h: [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]
        now, left = dict(s["axes"]), max(0, s["nonstop"] - 1)
        if s["nonstop"] and not left and self.after_nonstop and abs(v["x"]) >= self.across.speed / 6:
            now["x"] = _braking(now["x"], self.after_nonstop)
        axes = {k: _tick(x, r) for (k, x), r in zip(now.items(), (self.across, self.down, self.width, self.height), strict=True)}
        for k, stop in zip("xy", self._blocked(about(cx, cy, w, h), (axes["x"]["v"], axes["y"]["v"])), strict=True):
            if stop:
                axes[k]["v"] = 0.0
        box = [_clip(p, a[i % 2], a[i % 2 + 2]) for i, p in enumerate(about(cx, cy, w, h))]
        cx, cy, w, h = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, box[2] - box[0], box[3] - box[1]
        if self.aspect:
            w, h = max(w, h * self.aspect), max(h, w / self.aspect)
        shrink = min([1.0, *(m / v for m, v in zip(most, (w, h), strict=True) if v > m)])
        box = about(cx, cy, w * shrink, h * shrink)
        for i, k in enumerate("xy"):
            shift = max(0.0, a[i] - box[i]) or min(0.0, a[i + 2] - box[i + 2])
            if abs(shift) > 1e-9:
                box[i], box[i + 2], axes[k]["v"] = box[i] + shift, box[i + 2] + shift, axes[k]["v"] / 2
        return {**s, "box": box, "axes": axes, "nonstop": left}

    def step(self, s: dict, row: tuple) -> tuple[dict, list[tuple]]:
        frame, *dest = row
        if all(d is not None and math.isfinite(d) for d in dest):
            s = self._steered(s, tuple(float(d) for d in dest))
        s = self._advanced(s)
        l, t, r, b = s["box"]
        return s, [(int(frame), l, t, r - l, b - t)]


def destinations(tracks: DataFrame, arena: tuple[float, float, float, float], min_players: int = 4, scale: float = 1.0, game: str = "game") -> DataFrame:
    """game, frame and TLWH of where to look in each frame: the box about the largest clusters, scaled and cut to the arena.

    Frames of fewer than `min_players` boxes, and those too small for clusters, look at the whole arena.
    """
    counts = tracks.groupBy(game, "frame").agg(F.count("*").alias("_n"))
    found = groups.cluster_boxes(tracks, keys=(game, "frame"))
    bounds = tuple(F.lit(float(v)) for v in arena)
    near = boxes.clamp_box(boxes.scaled(boxes.cols("l", "t", "r", "b"), scale, scale), bounds)
    pick = F.col("l").isNotNull() & (F.col("_n") >= min_players)
    box = boxes.tlbr_to_tlwh(tuple(F.when(pick, a).otherwise(b) for a, b in zip(near, bounds, strict=True)))
    return counts.join(found, [game, "frame"], "left").select(game, "frame", *[c.alias(n) for c, n in zip(box, "xywh", strict=True)])


@dataclass(frozen=True)
class PlayTick:
    """A chain of movers in one fold, with a breakaway's feedback on the first one.

    The first mover follows the destination (TLWH), each other one the mover before. Where the players rush (mean speed `v`, foremost
    centre `ex`, `ey`; null where they don't), the destination is moved to the foremost, or half way, unless the frame has too `few`
    players. If the foremost is ahead of the first mover's box of the frame before, that mover gets a share of the group's speed under limits
    times `scale` and runs non-stop for some frames; else it has overshot, and brakes over `overshoot_brake` frames or, if these are 0,
    to a ratio of its speed.
    """

    movers: tuple[CameraBox, ...]
    speed_ratio: float = 0.3
    scale: float = 3.0
    nonstop: int = 2
    overshoot_brake: int = 6
    overshoot_ratio: float = 0.7
    average: bool = True

    output = "frame bigint, mover int, x double, y double, w double, h double"
    columns = ("frame", "x", "y", "w", "h", "few", "v", "ex", "ey")

    def start(self) -> dict:
        return {"movers": [m.start() for m in self.movers]}

    def _rushed(self, s: dict, v: float, ex: float) -> dict:
        lead, mover = self.movers[0], s["movers"][0]
        at = (mover["box"][0] + mover["box"][2]) / 2
        if (v > 0 and at < ex) or (v < 0 and at > ex):
            mover = lead.pushed(mover, v * self.speed_ratio, self.scale, self.nonstop)
        else:
            mover = lead.braked(mover, self.overshoot_brake, self.overshoot_ratio)
        return {"movers": [mover, *s["movers"][1:]]}

    def step(self, s: dict, row: tuple) -> tuple[dict, list[tuple]]:
        frame, x, y, w, h, few, v, ex, ey = row
        if v is not None and math.isfinite(v):
            s = self._rushed(s, v, ex)
            if not few:
                cx, cy = ((x + w / 2 + ex) / 2, (y + h / 2 + ey) / 2) if self.average else (ex, ey)
                x, y = cx - w / 2, cy - h / 2
        out, states, dest = [], [], (x, y, w, h)
        for k, (mover, state) in enumerate(zip(self.movers, s["movers"], strict=True)):
            state, ((_, *dest),) = mover.step(state, (frame, *dest))
            states.append(state)
            out.append((int(frame), k, *dest))
        return {"movers": states}, out


def play(tracks: DataFrame, movers: list[CameraBox], min_players: int = 4, scale: float = 1.0, game: str = "game", rush: DataFrame | None = None, **settings) -> DataFrame:
    """The last mover's box in each frame; each mover follows the one before, the first follows the players.

    `rush` (game, frame, v, ex, ey of `frames.rushes`) adds the breakaways' feedback, by the settings of PlayTick.
    """
    rows = ticks(tracks, movers, min_players, scale, game, rush, **settings)
    return rows.filter(F.col("mover") == len(movers) - 1).drop("mover")


def ticks(tracks: DataFrame, movers: list[CameraBox], min_players: int = 4, scale: float = 1.0, game: str = "game", rush: DataFrame | None = None, **settings) -> DataFrame:
    """game, frame, mover, x, y, w, h: the boxes of all movers, as `play` has the last one's."""
    rows = destinations(tracks, movers[0].arena, min_players, scale, game)
    few = tracks.groupBy(game, "frame").agg((F.count("*") < min_players).alias("few"))
    rows = rows.join(few, [game, "frame"])
    if rush is None:
        rows = rows.select("*", *[F.lit(None).cast("double").alias(c) for c in ("v", "ex", "ey")])
    else:
        rows = rows.join(rush.select(game, "frame", "v", "ex", "ey"), [game, "frame"], "left")
    return folds.fold(rows, PlayTick(tuple(movers), **settings), game)
