"""State machines over ordered rows of a key: one pure step each, for batches (applyInPandas) and streams (applyInPandasWithState, the state as JSON)."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


class EvidenceVoter:
    """A track's number by decayed evidence, with hysteresis against changing it."""

    output = "frame bigint, number int"
    columns = ("frame", "number", "score")

    def __init__(self, decay: float = 0.92, least: float = 1.0, over_current: float = 1.35, over_second: float = 1.05):
        self.decay, self.least, self.over_current, self.over_second = decay, least, over_current, over_second

    def start(self) -> dict:
        return {"scores": {}, "current": -1, "last": None}

    def step(self, s: dict, row: tuple) -> tuple[dict, list[tuple]]:
        frame, number, score = row
        if number > 0:
            k = self.decay ** max(1, frame - s["last"]) if s["last"] is not None else 1.0
            scores = {n: v * k for n, v in s["scores"].items() if v * k >= 1e-4}
            scores[str(number)] = scores.get(str(number), 0.0) + max(score, 0.0)
            current, ranked = s["current"], sorted(scores.items(), key=lambda x: -x[1])  # of equals the first seen
            best, top = int(ranked[0][0]), ranked[0][1]
            second = ranked[1][1] if len(ranked) > 1 else 0.0
            if current < 0:  # the first number needs only enough evidence
                current = best if top >= self.least else current
            elif best != current and top >= self.least and top >= self.over_second * second and top >= self.over_current * scores.get(str(current), 0.0):
                current = best
            s = {"scores": scores, "current": current, "last": frame}
        return s, [(frame, s["current"])]


class Zones:
    """Left, middle or right of a box's centre, with start lines apart from stop lines."""

    output = "frame bigint, zone string"
    columns = ("frame", "cx")

    def __init__(self, left_start: float, left_stop: float, right_stop: float, right_start: float):
        self.lines = left_start, left_stop, right_stop, right_start

    def start(self) -> dict:
        return {"zone": "middle"}

    def step(self, s: dict, row: tuple) -> tuple[dict, list[tuple]]:
        frame, cx = row
        left_start, left_stop, right_stop, right_start = self.lines
        zone = s["zone"]
        if (zone == "left" and cx > left_stop) or (zone == "right" and cx < right_stop):
            zone = "middle"
        if zone == "middle":
            zone = "left" if cx < left_start else "right" if cx > right_start else "middle"
        return {"zone": zone}, [(frame, zone)]


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(hi - lo, 0, None).prod(2)
    union = (a[:, 2:] - a[:, :2]).prod(1)[:, None] + (b[:, 2:] - b[:, :2]).prod(1)[None] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def greedy_pairs(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs by the least remaining cost up to `most`, the first of equals in the order of rows."""
    cost, out = cost.astype(float).copy(), []
    while cost.size:
        i, j = np.unravel_index(np.argmin(cost), cost.shape)
        if not cost[i, j] <= most:
            break
        out.append((int(i), int(j)))
        cost[i, :], cost[:, j] = np.inf, np.inf
    return out


def optimal_pairs(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """One-to-one pairs, each of cost up to `most`, that leave the least sum where a row or column left alone costs half of `most`.

    So a pair counts by what it costs less than `most`, and only rows and columns with such pairs matter. A row first takes its best column, if
    that is free; shortest augmenting paths, each of which ends in a free column or leaves one of its rows alone, settle the others.
    """
    gain = np.asarray(cost, float) - most
    useful = gain < 0
    rows, columns = np.flatnonzero(useful.any(1)), np.flatnonzero(useful.any(0))
    if not rows.size:
        return []
    c = np.where(useful, gain, np.inf)[np.ix_(rows, columns)].tolist()
    m, inf = columns.size, np.inf
    row_of, column_of, u, v, waiting = [-1] * m, [-1] * len(c), [min(r) for r in c], [0.0] * m, []
    for i, r in enumerate(c):
        j = r.index(u[i])
        if row_of[j] < 0:
            row_of[j], column_of[i] = i, j
        else:
            waiting.append(i)
    for start in waiting:
        dist, way, open_, seen = [inf] * m, [-1] * m, set(range(m)), []
        i, far, alone, last = start, 0.0, inf, start
        while True:
            seen.append((i, far))
            if far - u[i] < alone:
                alone, last = far - u[i], i
            r, base, end, least = c[i], far - u[i], -1, inf
            for j in open_:
                d = base + r[j] - v[j]
                if d < dist[j]:
                    dist[j], way[j] = d, i
                if dist[j] < least or (dist[j] == least and j < end):
                    end, least = j, dist[j]
            if least >= alone or row_of[end] < 0:
                break
            open_.remove(end)
            i, far = row_of[end], least
        total = min(alone, least)
        for i, far in seen:
            u[i] += total - far
            if column_of[i] >= 0:
                v[column_of[i]] -= total - far
        if least >= alone:  # the path's last row is left alone, its column is free
            end, column_of[last] = column_of[last], -1
        while end >= 0:
            i = way[end]
            row_of[end], column_of[i], end = i, end, column_of[i]
    return [(int(rows[i]), int(columns[j])) for i, j in enumerate(column_of) if j >= 0]


_MOTION = np.eye(8) + np.eye(8, k=4)


def gating_distance(mean: np.ndarray, cov: np.ndarray, measured: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distance of measurements (centre x, y, aspect, height) from a track's predicted one."""
    h = mean[3]
    s = cov[:4, :4] + np.diag(np.square([h / 20, h / 20, 1e-1, h / 20]))
    d = measured - mean[:4]
    return np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d)


class Associations:
    """Track ids of boxes frame by frame: confident boxes first, then tentative tracks, then weak boxes; motion at constant velocity.

    `assignment` is greedy or optimal. With `user_ids`, tracks that were never confirmed stay hidden and the others are
    numbered from 1 in the order of their confirmation; frame 0 starts anew.
    """

    output = "frame bigint, id bigint, x1 double, y1 double, x2 double, y2 double, label bigint, score double"
    columns = ("frame", "x1", "y1", "x2", "y2", "label", "score")

    def __init__(self, init: float = 0.7, low: float = 0.1, high: float = 0.6, iou_high: float = 0.1, iou_low: float = 0.5, iou_tentative: float = 0.3, keep: int = 30, confirm: int = 3, assignment: str = "greedy", user_ids: bool = False):
        self.pairs, self.user_ids = {"greedy": greedy_pairs, "optimal": optimal_pairs}[assignment], user_ids
        self.init, self.low, self.high, self.ious, self.keep, self.confirm = init, low, high, (iou_high, iou_tentative, iou_low), keep, confirm

    def start(self) -> dict:
        return {"next": 0, "tracks": [], "names": {}, "named": 0}

    def _born(self, s: dict, d: tuple, frame: int, state: str) -> dict:
        box = np.array(d[:4])
        w, h = box[2] - box[0], box[3] - box[1]
        mean = [float((box[0] + box[2]) / 2), float((box[1] + box[3]) / 2), float(w / h) if h else 0.0, float(h), 0.0, 0.0, 0.0, 0.0]
        std = [h / 10, h / 10, 1e-2, h / 10, h / 16, h / 16, 1e-5, h / 16]
        s["next"] += 1
        return {"id": s["next"] - 1, "state": state, "label": d[4], "last": frame, "hits": 1, "mean": mean, "cov": np.diag(np.square(std)).tolist()}

    @staticmethod
    def _predict(tracks: list[dict], frame: int) -> None:
        """All tracks of a frame at once; a confirmed one that missed the frame before loses half its growth."""
        m, p = np.array([t["mean"] for t in tracks]), np.array([t["cov"] for t in tracks])
        missed = np.array([t["state"] != "tentative" and t["last"] < frame - 1 for t in tracks])
        m[missed, 7] /= 2
        h = m[:, 3]
        q = np.square(np.stack([h / 20, h / 20, np.full_like(h, 1e-2), h / 20, h / 160, h / 160, np.full_like(h, 1e-5), h / 160], 1))
        m, p = m @ _MOTION.T, _MOTION @ p @ _MOTION.T
        p[:, range(8), range(8)] += q
        for t, mean, cov in zip(tracks, m, p, strict=True):
            t["mean"], t["cov"] = mean, cov

    def _update(self, t: dict, d: tuple, frame: int) -> None:
        m, p = np.asarray(t["mean"]), np.asarray(t["cov"])
        h = m[3]
        r = np.diag(np.square([h / 20, h / 20, 1e-1, h / 20]))
        s = p[:4, :4] + r
        gain = np.linalg.solve(s, p[:4, :]).T
        z = np.array([(d[0] + d[2]) / 2, (d[1] + d[3]) / 2, (d[2] - d[0]) / (d[3] - d[1]) if d[3] > d[1] else 0.0, d[3] - d[1]])
        t["mean"], t["cov"] = m + gain @ (z - m[:4]), p - gain @ s @ gain.T
        t["hits"] += 1
        t["last"] = frame
        if t["state"] == "lost" or (t["state"] == "tentative" and t["hits"] >= self.confirm):
            t["state"] = "tracking"

    def _match(self, tracks: list[dict], found: list[tuple], least: float, weigh: bool) -> list[tuple[int, int]]:
        """Pairs of an overlap of `least` or more, of one label each."""
        if not tracks or not found:
            return []
        m = np.array([t["mean"][:4] for t in tracks])
        w = m[:, 2] * m[:, 3]
        boxes = np.stack([m[:, 0] - w / 2, m[:, 1] - m[:, 3] / 2, m[:, 0] + w / 2, m[:, 1] + m[:, 3] / 2], 1)
        o = _iou(boxes, np.array([d[:4] for d in found]))
        if weigh:
            o = o * np.array([d[5] for d in found])
        other = np.array([t["label"] for t in tracks])[:, None] != np.array([d[4] for d in found])[None]
        return self.pairs(1 - o + 1e6 * other, 1 - least)

    def step(self, s: dict, frame: int, found: list[tuple]) -> tuple[dict, list[tuple]]:
        """found: (x1, y1, x2, y2, label, score) of one frame."""
        if self.user_ids and frame == 0:
            s = self.start()
        s = s | {"tracks": [dict(t) for t in s["tracks"]], "names": dict(s["names"])}
        tracks, out = s["tracks"], []
        if not tracks:
            for d in found:
                if d[5] > self.init:
                    tracks.append(self._born(s, d, frame, "tracking"))
                    out.append((tracks[-1]["id"], d))
        elif found:
            first, second = [d for d in found if d[5] > self.high], [d for d in found if self.low < d[5] <= self.high]
            self._predict(tracks, frame)
            sure, new = [t for t in tracks if t["state"] != "tentative"], [t for t in tracks if t["state"] == "tentative"]
            for pool, least, weigh in ((sure, self.ious[0], True), (new, self.ious[1], True)):
                pairs = self._match(pool, first, least, weigh)
                for i, j in pairs:
                    self._update(pool[i], first[j], frame)
                    out.append((pool[i]["id"], first[j]))
                first = [d for j, d in enumerate(first) if j not in {b for _, b in pairs}]
            left = [t for t in sure if t["last"] == frame - 1]
            weak = self._match(left, second, self.ious[2], False)
            born = [self._born(s, d, frame, "tentative") for d in first]
            out += [(t["id"], d) for t, d in zip(born, first, strict=True)]
            for i, j in weak:
                self._update(left[i], second[j], frame)
                out.append((left[i]["id"], second[j]))
            tracks += born
        for t in tracks:
            if t["state"] == "tracking" and t["last"] < frame:
                t["state"] = "lost"
        s["tracks"] = [t for t in tracks if not (t["state"] == "lost" and frame - t["last"] >= self.keep) and not (t["state"] == "tentative" and t["last"] < frame)]
        if self.user_ids:
            for t in tracks:  # a confirmed track keeps its number for as long as it lives
                if t["state"] == "tracking" and str(t["id"]) not in s["names"]:
                    s["named"] += 1
                    s["names"][str(t["id"])] = s["named"]
            alive = {str(t["id"]) for t in s["tracks"]}
            out = [(s["names"][str(i)], d) for i, d in out if str(i) in s["names"]]
            s["names"] = {k: v for k, v in s["names"].items() if k in alive}
        return s, [(frame, i, *d) for i, d in out]


class CenterPoints(Associations):
    """Track ids by the overlap of boxes whose corner moves at constant velocity: each frame the best pairs, one after another; a track unmatched for more than `keep` frames ends."""

    def __init__(self, least: float = 0.3, keep: int = 30):
        self.least, self.keep = least, keep

    def start(self) -> dict:
        return {"next": 0, "id": [], "x": [], "p": [], "box": [], "missed": []}

    def step(self, s: dict, frame: int, found: list[tuple]) -> tuple[dict, list[tuple]]:
        """All tracks at once. Both axes are alike and apart, so `p` holds one's variances of place and speed and, between them, their covariance."""
        ids, missed = np.asarray(s["id"], int), np.asarray(s["missed"], int) + 1
        x, p, box = (np.asarray(s[k], float).reshape(-1, n) for k, n in (("x", 4), ("p", 3), ("box", 4)))
        about = lambda c, b: np.concatenate([c - (b[:, 2:] - b[:, :2]) / 2, c + (b[:, 2:] - b[:, :2]) / 2], 1)
        x = np.concatenate([x[:, :2] + x[:, 2:], x[:, 2:]], 1)
        p = np.stack([p[:, 0] + 2 * p[:, 1] + p[:, 2] + 0.01, p[:, 1] + p[:, 2], p[:, 2] + 0.01], 1)
        box, out = about(x[:, :2], box), []
        boxes = np.array([d[:4] for d in found], float).reshape(-1, 4)
        pairs = greedy_pairs(1 - _iou(box, boxes), 1 - self.least)
        if pairs:
            i, j = np.array(pairs).T
            gain = p[i, :2] / (p[i, :1] + 0.1)
            off = boxes[j, :2] - x[i, :2]
            x[i] += np.concatenate([gain[:, :1] * off, gain[:, 1:] * off], 1)
            p[i] -= np.stack([gain[:, 0] * p[i, 0], gain[:, 0] * p[i, 1], gain[:, 1] * p[i, 1]], 1)
            box[i], missed[i] = about(x[i, :2], boxes[j]), 0
            out = [(t, found[k]) for t, k in zip(ids[i].tolist(), j.tolist(), strict=True)]
        taken = {j for _, j in pairs}
        new = [j for j in range(len(found)) if j not in taken]
        fresh = list(range(s["next"], s["next"] + len(new)))
        out += [(t, found[j]) for t, j in zip(fresh, new, strict=True)]
        b, keep = boxes[new], np.r_[missed <= self.keep, np.ones(len(new), bool)]
        made = {"id": fresh, "x": np.concatenate([b[:, :2], np.zeros((len(new), 2))], 1), "p": np.tile([1000.0, 0.0, 1000.0], (len(new), 1)), "box": b, "missed": [0] * len(new)}
        held = {"id": ids, "x": x, "p": p, "box": box, "missed": missed}
        return {"next": s["next"] + len(new)} | {k: np.concatenate([held[k], made[k]])[keep].astype(held[k].dtype) for k in held}, [(frame, i, *d) for i, d in out]


class Reidentified(Associations):
    """Track ids by overlap and appearance: a row's `look` is a vector, compared by its cosine with what the track looked like.

    Similarity is the mean of both, by their weights; pairs of one label are matched by the least sum of costs, up to 1 less `least`.
    Lost tracks cost `lost_cost` more and end `keep` frames after their last match. A matched track's box and look move by their momenta
    towards the row's. Unmatched rows from `init` on begin tracks; a track's first free slot, of `slots`, decides its place in the output. Each frame gives all its tracked boxes. Without
    looks only the overlap counts.
    """

    output = "frame bigint, id bigint, x1 double, y1 double, x2 double, y2 double, label bigint, score double"
    columns = ("frame", "x1", "y1", "x2", "y2", "label", "score", "look")

    def __init__(self, init: float = 0.7, low: float = 0.1, least: float = 0.1, keep: int = 30, iou_weight: float = 0.5, look_weight: float = 0.5, box_momentum: float = 0.6, look_momentum: float = 0.2, lost_cost: float = 0.05, slots: int = 128, weigh: bool = True):
        self.init, self.low, self.least, self.keep, self.weights = init, low, least, keep, (max(0.0, iou_weight), max(0.0, look_weight))
        self.box_momentum, self.look_momentum, self.lost_cost, self.slots, self.weigh = box_momentum, look_momentum, lost_cost, slots, weigh

    def start(self) -> dict:
        return {"next": 0, "tracks": []}

    def _similar(self, tracks: list[dict], found: list[tuple]) -> np.ndarray:
        o = _iou(np.array([t["box"] for t in tracks]).reshape(-1, 4), np.array([d[:4] for d in found]).reshape(-1, 4))
        if self.weigh:
            o = o * np.array([d[5] for d in found])
        by_iou, by_look = self.weights
        if any(d[6] is None for d in found) or any(t["look"] is None for t in tracks):
            by_look = 0.0
        if not by_iou + by_look:
            by_iou = 1.0
        if not by_look:
            return o
        unit = lambda v: v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-6)
        looks = unit(np.array([t["look"] for t in tracks], float)) @ unit(np.array([d[6] for d in found], float)).T
        return (o * by_iou + looks * by_look) / (by_iou + by_look)

    def step(self, s: dict, frame: int, found: list[tuple]) -> tuple[dict, list[tuple]]:
        """found: (x1, y1, x2, y2, label, score, look) of one frame."""
        found = [d for d in found if d[5] >= self.low]
        tracks = [dict(t) for t in s["tracks"]]
        pairs = []
        if tracks and found:
            cost = 1 - self._similar(tracks, found) + self.lost_cost * np.array([[t["lost"]] for t in tracks])
            other = np.array([t["label"] for t in tracks])[:, None] != np.array([d[4] for d in found])[None]
            pairs = optimal_pairs(cost + 1e6 * other, 1 - min(max(self.least, 0.0), 1.0))
        taken = {j for _, j in pairs}
        near = lambda old, new, m: [p * (1 - m) + q * m for p, q in zip(old, new, strict=True)]
        for t in tracks:
            t["lost"] = True
        for i, j in pairs:
            t, d = tracks[i], found[j]
            look = t["look"] if d[6] is None else list(d[6]) if t["look"] is None else near(t["look"], d[6], self.look_momentum)
            tracks[i] = t | {"box": near(t["box"], d[:4], self.box_momentum), "look": look, "label": d[4], "score": d[5], "last": frame, "lost": False}
        tracks = [t for t in tracks if not (t["lost"] and frame - t["last"] >= self.keep)]
        free = sorted(set(range(self.slots)) - {t["slot"] for t in tracks})
        new = [d for j, d in enumerate(found) if j not in taken and d[5] >= self.init][: len(free)]
        for slot, d in zip(free, new, strict=False):
            tracks.append({"id": s["next"], "slot": slot, "box": list(d[:4]), "look": None if d[6] is None else list(d[6]), "label": d[4], "score": d[5], "last": frame, "lost": False})
            s = s | {"next": s["next"] + 1}
        tracks.sort(key=lambda t: t["slot"])
        return {"next": s["next"], "tracks": tracks}, [(frame, t["id"], *t["box"], t["label"], t["score"]) for t in tracks if not t["lost"]]


class RecentVotes:
    """A track's number by decayed votes over the last `window` frames; older votes leave the state."""

    output = "frame bigint, number int, votes double"
    columns = ("frame", "number", "score")

    def __init__(self, window: int = 30, decay: float = 0.9, two_digit: float = 0.61, one_digit: float = 0.39):
        self.window, self.decay, self.biases = window, decay, (one_digit, two_digit)

    def start(self) -> dict:
        return {"votes": []}

    def step(self, s: dict, row: tuple) -> tuple[dict, list[tuple]]:
        frame, number, score = row
        votes = [v for v in s["votes"] if frame - v[0] <= self.window] + [[int(frame), int(number), float(score)]]
        sums: dict[int, float] = {}
        for f, n, v in votes:
            sums[n] = sums.get(n, 0.0) + v * self.decay ** (frame - f) * self.biases[n >= 10]
        best = min(sums, key=lambda n: (-round(sums[n], 9), n))
        return {"votes": votes}, [(frame, best, sums[best])]


def padded(rows: DataFrame, slots: int, keys: tuple[str, ...] = ("game", "frame")) -> DataFrame:
    """keys, slot, id, x1, y1, x2, y2, valid, num_tracks: a frame's first tracks by id in a fixed number of slots, empty ones with id -1."""
    w = W.partitionBy(*keys)
    ranked = rows.withColumns({"slot": F.row_number().over(w.orderBy("id")) - 1, "num_tracks": F.least(F.count("*").over(w), F.lit(slots))}).filter(F.col("slot") < slots)
    box = ["x1", "y1", "x2", "y2"]
    held = ranked.groupBy(*keys, "num_tracks").agg(F.array_sort(F.collect_list(F.struct("slot", "id", *box))).alias("_e"))  # one pass over rows, which may be a fold's
    found = held.select(*keys, "num_tracks", "_e", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")).withColumn("_e", F.try_element_at("_e", F.col("slot") + 1))
    return found.select(*keys, "slot", F.coalesce("_e.id", F.lit(-1)).alias("id"), *[F.coalesce(f"_e.{c}", F.lit(0.0)).alias(c) for c in box], F.col("_e.id").isNotNull().alias("valid"), "num_tracks")


def _fold(machine, state: dict, pdf: pd.DataFrame) -> tuple[dict, list[tuple]]:
    out: list[tuple] = []
    pdf = pdf.sort_values("frame", kind="stable")
    if isinstance(machine, Associations):
        pdf = pdf[pdf["frame"].notna()]
        at = pdf["frame"].to_numpy()
        found = list(zip(*(pdf[c].tolist() for c in machine.columns[1:]), strict=True))
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist() if len(at) else []
        for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
            state, rows = machine.step(state, int(at[a]), [r for r in found[a:b] if r[0] is not None])
            out += rows
        return state, out
    for row in pdf[list(machine.columns)].itertuples(index=False):
        state, rows = machine.step(state, tuple(row))
        out += rows
    return state, out


def _names(machine) -> list[str]:
    return [c.split()[0] for c in machine.output.split(", ")]


def fold(rows: DataFrame, machine, key: str) -> DataFrame:
    """A key's rows in the order of their frames, through the machine."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, out = _fold(machine, machine.start(), pdf)
        made = pd.DataFrame(out, columns=_names(machine))
        made.insert(0, key, pdf[key].iloc[0])
        return made

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *machine.columns).groupBy(key).applyInPandas(run, f"{key} {kind}, {machine.output}")


def fold_stream(rows: DataFrame, machine, key: str, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream whose batches bring a key's frames in order. A key without rows for `idle_ms` milliseconds loses its state."""

    def run(k, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        s = json.loads(state.get[0]) if state.exists else machine.start()
        pdf = pd.concat(list(parts))
        s, out = _fold(machine, s, pdf)
        state.update((json.dumps(s, default=lambda a: a.tolist()),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        made = pd.DataFrame(out, columns=_names(machine))
        made.insert(0, key, k[0])
        yield made

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *machine.columns).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {machine.output}", "state string", "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")


def event_windows(rows: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """Counts and sums of tumbling windows of event time; with a watermark, late rows of a stream are dropped."""
    timed = rows.withWatermark("ts", watermark) if watermark else rows
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(rows: DataFrame, gap: str, key: str, watermark: str | None = None) -> DataFrame:
    """A key's sessions: runs of event times less than the gap apart, with first and last time, count and sum."""
    timed = rows.withWatermark("ts", watermark) if watermark else rows
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), "last", "n", "total")
