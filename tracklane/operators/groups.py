"""Which boxes of a frame belong together: k-means clusters, ends and outliers.

A frame's boxes (at most some dozens) travel as one array, so an Arrow batch holds many frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


def without_extremes(rows: DataFrame, largest: bool = True, ends: bool = True, min_ends: int = 10, min_rows: int = 4) -> DataFrame:
    """Without each frame's largest box and, of `min_ends` boxes or more, the boxes of least and greatest centre.

    Centres are cut to whole numbers; the smallest id goes first among equals. Frames of fewer than `min_rows` boxes stay whole.
    """
    w, cx, area = W.partitionBy("frame"), (F.col("x") + F.col("w") / 2).cast("bigint"), F.col("w") * F.col("h")
    first = lambda by: F.row_number().over(w.orderBy(by, "id")) == 1
    gone = F.lit(False)
    if largest:
        gone |= first(area.desc()) & (area > 0)
    if ends:
        gone |= (first(cx.asc()) | first(cx.desc())) & (F.count("*").over(w) >= min_ends)
    return rows.withColumn("_gone", gone & (F.count("*").over(w) >= min_rows)).filter("not _gone").drop("_gone")


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)


def clusters(points: np.ndarray, k: int, threshold: float = 0.001, loops: int = 500) -> np.ndarray:
    """Cluster of each point, seeded with the first k; ends once at most the threshold's share of points has moved."""
    centres, member = points[:k].astype(float), np.full(len(points), -1)
    for _ in range(loops + 1):
        found = _nearest(points, centres)
        moved, member = np.mean(found != member), found
        for c in np.unique(member):
            centres[c] = points[member == c].mean(0)
        if moved <= threshold:
            break
    return member


def end_outlier(boxes: np.ndarray, ratio: float = 1.0) -> int | None:
    """The leftmost, else the rightmost, of TLBR boxes, if its centre lies further from the next one than `ratio` widths of all others."""
    mid = (boxes[:, 0] + boxes[:, 2]) / 2
    for end in (mid.argmin(), mid.argmax()):
        gaps = np.abs(mid - mid[end])
        others = np.delete(boxes, end, 0)
        if gaps.any() and gaps[gaps > 0].min() > ratio * (others[:, 2].max() - others[:, 0].min()):
            return int(end)
    return None


def cluster_boxes(rows: DataFrame, sizes: tuple[int, ...] = (3, 2), outlier_ratio: float | None = 1.0, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """keys, l, t, r, b: the box about the largest clusters for each k; only k below the number of boxes less one count.

    Boxes are taken in the order of their ids; a frame of too few boxes for any k has no row. From clusters of more than
    three an outlying end box is left out, unless the ratio is None.
    """
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", *[F.col(c).cast("double").alias(c) for c in "xywh"]))).alias("b")).filter(F.size("b") > min(sizes) + 1)
    flat = packed.select(*keys, F.flatten(F.transform("b", lambda b: F.array(b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"]))).alias("b"))

    def around(boxes: np.ndarray) -> np.ndarray:
        return np.concatenate([boxes[:, :2].min(0), boxes[:, 2:].max(0)])

    def one(boxes: np.ndarray) -> np.ndarray:
        points, found = (boxes[:, :2] + boxes[:, 2:]) / 2, []
        for k in (k for k in sizes if len(boxes) > k + 1):
            member = clusters(points, k)
            kept = boxes[member == np.bincount(member).argmax()]
            out = end_outlier(kept, outlier_ratio) if outlier_ratio is not None and len(kept) > 3 else None
            found.append(around(kept if out is None else np.delete(kept, out, 0)))
        return around(np.array(found))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = np.array([one(np.asarray(b, float).reshape(-1, 4)) for b in pdf["b"]]).reshape(-1, 4)
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), pd.DataFrame(made, columns=list("ltrb"))], axis=1)

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return flat.mapInPandas(run, f"{kinds}, l double, t double, r double, b double")
