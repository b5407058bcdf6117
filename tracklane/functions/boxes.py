"""Box geometry as columns. A box is four columns: TLWH (left, top, width, height) or TLBR (left, top, right, bottom)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

Box = tuple[Column, Column, Column, Column]


def cols(*names: str) -> Box:
    return tuple(F.col(n) for n in names)


def tlwh_to_tlbr(b: Box) -> Box:
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def tlbr_to_tlwh(b: Box) -> Box:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def center(b: Box) -> tuple[Column, Column]:
    """Centre of a TLBR box."""
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def track_center(x, y, w, h, faithful: bool = True) -> tuple[Column, Column]:
    """Centre of a TLWH box; the analytics being rebuilt add half of y, not of the height, unless not faithful."""
    return x + w / 2, y + (y if faithful else h) / 2


def size(b: Box) -> tuple[Column, Column]:
    return b[2] - b[0], b[3] - b[1]


def aspect_ratio(b: Box) -> Column:
    return (b[2] - b[0]) / (b[3] - b[1])


def clamp(v, lo, hi) -> Column:
    """Between lo and hi; null stays null."""
    return F.when(v.isNotNull(), F.greatest(F.least(v, hi), lo))


def clamp_box(b: Box, bounds: Box) -> Box:
    return clamp(b[0], bounds[0], bounds[2]), clamp(b[1], bounds[1], bounds[3]), clamp(b[2], bounds[0], bounds[2]), clamp(b[3], bounds[1], bounds[3])


def box_at(cx, cy, w, h) -> Box:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def scaled(b: Box, sx, sy) -> Box:
    (cx, cy), (w, h) = center(b), size(b)
    return box_at(cx, cy, w * sx, h * sy)


def shifted(b: Box, dx, dy) -> Box:
    return b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy


def shift_into(b: Box, bounds: Box) -> Box:
    """Moved, not cut, so that it lies flush inside the bounds; the left and top edges win."""
    over = lambda lo, hi, first, last: F.when(lo < first, first - lo).when(hi > last, last - hi).otherwise(F.lit(0.0))
    return shifted(b, over(b[0], b[2], bounds[0], bounds[2]), over(b[1], b[3], bounds[1], bounds[3]))


def scaled_into(box, bounds):
    """The box, scaled down to fit the bounds and moved inside them; sizes below 1 count as 1."""
    w, h = (F.greatest(v, F.lit(1.0)) for v in size(box))
    bw, bh = (F.greatest(v, F.lit(1.0)) for v in size(bounds))
    scale = F.least(F.lit(1.0), bw / w, bh / h)
    half = w * scale / 2, h * scale / 2
    at = [clamp(c, lo + d, hi - d) for c, d, lo, hi in zip(center(box), half, bounds[:2], bounds[2:], strict=True)]
    return at[0] - half[0], at[1] - half[1], at[0] + half[0], at[1] + half[1]


def fit_inside(b: Box, w, h) -> Box:
    """Shrunk alike in both directions to fit (0, 0, w, h), then its centre clamped."""
    (cx, cy), (bw, bh) = center(b), size(b)
    k = F.least(F.lit(1.0), w / bw, h / bh)
    bw, bh = bw * k, bh * k
    return box_at(clamp(cx, bw / 2, w - bw / 2), clamp(cy, bh / 2, h - bh / 2), bw, bh)


def with_aspect(b: Box, ratio) -> Box:
    """The shorter side grown to the ratio, about the centre."""
    (cx, cy), (w, h) = center(b), size(b)
    return box_at(cx, cy, F.greatest(w, h * ratio), F.greatest(h, w / ratio))


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def intersection(a: Box, b: Box) -> Column:
    """Area that two TLBR boxes share; null where a coordinate is."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    known = F.lit(True)
    for c in (*a, *b):
        known &= c.isNotNull()
    return F.when(known, side(0, 2) * side(1, 3))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union of TLBR boxes; zero for an empty union."""
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def center_aspect_height(b: Box) -> tuple[Column, Column, Column, Column]:
    (cx, cy), (w, h) = center(b), size(b)
    return cx, cy, w / h, h


def finite(*values: Column) -> Column:
    """All are numbers, none null."""
    fine = F.lit(True)
    for v in values:
        fine &= ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(fine, F.lit(False))


def valid(b: Box) -> Column:
    """Finite and not inverted."""
    return F.coalesce((b[2] >= b[0]) & (b[3] >= b[1]), F.lit(False)) & finite(*b)


def panoramic_distance(x1, x2, width, rink_width: float = 200.0) -> Column:
    """Length of the arc between two columns of a half-circle panorama."""
    c = width / 2
    angle = lambda x: math.pi / 2 * ((x - c) / c)
    return rink_width / 2 * F.abs(angle(x1) - angle(x2))


def rotated_size(w, h, degrees) -> tuple[Column, Column]:
    s, c = F.abs(F.sin(F.radians(degrees))), F.abs(F.cos(F.radians(degrees)))
    return w * c + h * s, w * s + h * c


def is_close(a, b, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def side_of_line(px, py, x1, y1, x2, y2) -> Column:
    """Sign of a point's place: positive where the turn from the line to the point has a positive cross product."""
    return F.signum((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1))


def gaussian_weight(x, mean, std) -> Column:
    return F.exp(-0.5 * ((x - mean) / std) * ((x - mean) / std))


def shift_flags(b: Box, w, h) -> tuple[Box, Column, Column]:
    """The box moved flush into a frame of w by h, and whether it moved along x and y; its far side may not reach w or h."""
    bounds = (F.lit(0.0), F.lit(0.0), w, h)
    return shift_into(b, bounds), (b[0] < 0) | (b[2] >= w), (b[1] < 0) | (b[3] >= h)


def on_edges(b: Box, bounds: Box) -> Box:
    """Whether the left, top, right and bottom edges lie on or outside those of the bounds."""
    return b[0] <= bounds[0], b[1] <= bounds[1], b[2] >= bounds[2], b[3] >= bounds[3]


def overshoots(b: Box, bounds: Box, dx, dy, epsilon: float = 0.01) -> tuple[Column, Column]:
    """Whether a move in these directions would push the box beyond an edge that it lies on, along x and y."""
    left, top, right, bottom = on_edges(b, bounds)
    return (left & (dx < epsilon)) | (right & (dx > -epsilon)), (top & (dy < epsilon)) | (bottom & (dy > -epsilon))


def scaled_within(b: Box, sx, sy, bounds: Box) -> Box:
    """Scaled about its centre and cut to the bounds; one pixel is left where nothing would be."""
    s = scaled(b, sx, sy)

    def side(lo, hi, first, last):
        lo, hi = F.greatest(lo, first), F.least(hi, last)
        gone = lo >= hi
        return F.when(gone & (lo >= last), last - 1).otherwise(lo), F.when(gone, F.when(lo < last, lo + 1).otherwise(last)).otherwise(hi)

    (l, r), (t, o) = side(s[0], s[2], bounds[0], bounds[2]), side(s[1], s[3], bounds[1], bounds[3])
    return l, t, r, o


def clamp_if_close(v, lo, hi, epsilon) -> Column:
    """Clamped where it lies beyond by no more than epsilon; an error where it lies further away."""
    return F.when((v < lo - epsilon) | (v > hi + epsilon), F.raise_error(F.lit("a value far beyond its bounds")).cast("double")).otherwise(clamp(v, lo, hi))


def from_center_aspect_height(cx, cy, aspect, h) -> Box:
    return box_at(cx, cy, aspect * h, h)


def line(x1, y1, x2, y2) -> tuple[Column, Column]:
    """(slope, intercept); null for a vertical line."""
    slope = F.when(x2 != x1, (y2 - y1) / (x2 - x1))
    return slope, y1 - slope * x1


def beside_line(px, py, x1, y1, x2, y2) -> Column:
    """-1 left of the line at the point's own height, 1 right of it, 0 on it; null for level and vertical lines."""
    slope, start = line(x1, y1, x2, y2)
    at = F.try_divide(py - start, slope)
    return F.when(px < at, -1).when(px > at, 1).when(px == at, 0)


def y_up(y, image_height) -> Column:
    return image_height - y


def slow_aspect(x, y, w, h, aspect: float) -> Box:
    """TLWH in 0..1 with its centre and height, the width from the aspect, moved inside."""
    high = clamp(F.greatest(h, F.lit(1e-6)), F.lit(1e-6), F.lit(min(1.0, 1.0 / aspect)))
    wide = clamp(high * aspect, F.lit(1e-6), F.lit(1.0))
    cx = clamp(x + F.greatest(w, F.lit(1e-6)) / 2, wide / 2, 1 - wide / 2)
    cy = clamp(y + F.greatest(h, F.lit(1e-6)) / 2, high / 2, 1 - high / 2)
    return cx - wide / 2, cy - high / 2, wide, high


def unit_box(x, y, w, h) -> Box:
    """TLWH cut to 0..1."""
    one = lambda v: clamp(v, F.lit(0.0), F.lit(1.0))
    return one(x), one(y), one(x + w) - one(x), one(y + h) - one(y)


def letterbox(w, h, width: int, height: int) -> tuple[Column, Column, Column, Column, Column]:
    """(new width, new height, ratio, padding left, padding above) of a picture shrunk or grown into a frame; sizes round half to even."""
    ratio = F.least(F.lit(float(height)) / h, F.lit(float(width)) / w)
    nw, nh = F.bround(w * ratio), F.bround(h * ratio)
    return nw, nh, ratio, (width - nw) / 2, (height - nh) / 2


def click_box(cx, cy, w, h, width: float, height: float, least: float = 0.25) -> Box:
    """TLWH of a box about a clicked point: shrunk alike, down to `least`, until it fits the frame, then moved inside."""
    outside = (cx < 0) | (cx > width) | (cy < 0) | (cy > height)
    px = F.when(outside, clamp(cx, F.lit(0.0), F.lit(width - 1.0))).otherwise(cx)
    py = F.when(outside, clamp(cy, F.lit(0.0), F.lit(height - 1.0))).otherwise(cy)
    room = F.least(F.lit(1.0), 2 * px / w, 2 * (width - px) / w, 2 * py / h, 2 * (height - py) / h)
    k = F.greatest(room, F.lit(least))
    nw, nh = w * k, h * k
    inside = lambda v, most: clamp(v, F.lit(0.0), F.greatest(most, F.lit(0.0)))
    return inside(px - nw / 2, width - nw), inside(py - nh / 2, height - nh), nw, nh


def anchor_deltas(x, y, w, h, ax, ay, aw, ah) -> Box:
    """Centre offsets in anchor sizes and logarithms of size ratios."""
    return (x - ax) / aw, (y - ay) / ah, F.log(w / aw), F.log(h / ah)


def from_deltas(dx, dy, dw, dh, ax, ay, aw, ah) -> Box:
    return aw * dx + ax, ah * dy + ay, aw * F.exp(dw), ah * F.exp(dh)


def polygon_center(points: Column) -> tuple[Column, Column]:
    """Mean of the corners of an array of (x, y) arrays."""
    mean = lambda i: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[i]) / F.size(points)
    return mean(0), mean(1)


def scaled_polygon(points: Column, k) -> Column:
    cx, cy = polygon_center(points)
    return F.transform(points, lambda p: F.array(cx + (p[0] - cx) * k, cy + (p[1] - cy) * k))


def scaled_polygon_y(points: Column, above, below) -> Column:
    """Corners with y beyond the centre's moved by the one ratio, others by the other."""
    _, cy = polygon_center(points)
    return F.transform(points, lambda p: F.array(p[0], cy + (p[1] - cy) * F.when(p[1] > cy, above).otherwise(below)))


def in_polygon(px, py, points: Column) -> Column:
    """Whether a ray to the right crosses the polygon's sides an odd number of times."""
    n = F.size(points)

    def crosses(i):
        a, b = F.element_at(points, i), F.element_at(points, F.when(i == n, F.lit(1)).otherwise(i + 1))
        return F.when(((a[1] > py) != (b[1] > py)) & (px < (b[0] - a[0]) * (py - a[1]) / (b[1] - a[1]) + a[0]), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), crosses), F.lit(0), lambda s, c: s + c) % 2 == 1


def gaussian_profile(x, length: int, wide: bool = False, invert: bool = False) -> Column:
    """Weight, from 0 to 1, of a column of a picture: a bell about one beyond the middle, as wide as an eighth of the picture or as all of it."""
    std = float(length) if wide else length / 8.0
    at = lambda v: F.exp(-((v - 1.0) * (v - 1.0)) / (2 * std * std))
    ends = [math.exp(-((v - 1.0) ** 2) / (2 * std * std)) for v in (-length / 2, length / 2)]
    top = max(math.exp(-((k - length / 2 - 1.0) ** 2) / (2 * std * std)) for k in range(length + 1))
    spot = F.floor(clamp(x, F.lit(0.0), F.lit(float(length - 1)))) - length / 2
    value = (at(spot) - min(ends)) / (top - min(ends))
    return 1 - value if invert else value
