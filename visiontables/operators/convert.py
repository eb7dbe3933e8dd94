"""Annotation sets to one label form: image_id, cls, xc, yc, bw, bh (or corner points), all relative to the image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from visiontables.functions import boxes as B
from visiontables.operators import labels as L
from visiontables.operators import regions as R

# Type numbers that carry a class, in class order (fixed values).
XVIEW_TYPES = [11, 12, 13, 15, 17, 18, 19, 20, 21, 23, 24, 25, 26, 27, 28, 29, 32, 33, 34, 35, 36, 37, 38, 40, 41, 42, 44, 45, 47, 49, 50, 51,
               52, 53, 54, 55, 56, 57, 59, 60, 61, 62, 63, 64, 65, 66, 71, 72, 73, 74, 76, 77, 79, 83, 84, 86, 89, 91, 93, 94]
# Image size that one driving set uses throughout (fixed values).
ARGOVERSE_W, ARGOVERSE_H = 1920.0, 1200.0


def _labels(df: DataFrame, cls: Column, b: B.Box, *keep: str) -> DataFrame:
    return df.select("image_id", *keep, cls.cast("int").alias("cls"), *b.named("xc", "yc", "bw", "bh"))


def _ltwh_n(w: Column, h: Column, names=("left", "top", "width", "height")) -> B.Box:
    c = B.ltwh_to_xywh(B.box(names=names))
    return B.Box(c[0] / w, c[1] / h, c[2] / w, c[3] / h)


def _first_equal(df: DataFrame, pos: str) -> DataFrame:
    """Of equal boxes of an image the first stays; counted with a partial aggregate."""
    return df.groupBy("image_id", "cls", "xc", "yc", "bw", "bh").agg(F.min(pos).alias(pos))


def from_coco(ann: DataFrame, pos: str = "ann_id", cls91to80: bool = True) -> DataFrame:
    """Annotation rows joined with their image: crowds and empty boxes dropped, equal boxes kept once."""
    cls = L.coco91_to_80(F.col("category_id")) if cls91to80 else F.col("category_id") - 1
    rows = ann.where(~F.coalesce("iscrowd", F.lit(False)))
    out = _labels(rows, cls, _ltwh_n(F.col("img_w"), F.col("img_h")), pos).where("bw > 0 AND bh > 0")
    return _first_equal(out, pos)


def from_dota(lines: DataFrame, classes: dict[str, int]) -> DataFrame:
    """Four corners and a class name per line, to class number and relative corners."""
    number = F.try_element_at(F.create_map(*[F.lit(v) for kv in classes.items() for v in kv]), F.col("class_name"))
    corners = [(F.col(f"x{i}") / F.col("img_w")).alias(f"x{i}") for i in range(1, 5)] + [(F.col(f"y{i}") / F.col("img_h")).alias(f"y{i}") for i in range(1, 5)]
    return lines.select("image_id", "line", number.alias("cls"), *corners).where("cls IS NOT NULL")


def from_sku(rows: DataFrame, keep: str) -> DataFrame:
    return _labels(rows, F.lit(0), B.xyxy_to_xywhn(B.box(), F.col("img_w"), F.col("img_h")), keep)


def from_visdrone(rows: DataFrame, keep: str) -> DataFrame:
    return _labels(rows.where("score <> 0"), F.col("category") - 1, _ltwh_n(F.col("img_w"), F.col("img_h")), keep)


def xview_class(type_id: Column) -> Column:
    return L.remap_class(type_id, {t: i for i, t in enumerate(XVIEW_TYPES)})


def from_xview(rows: DataFrame, keep: str) -> DataFrame:
    """Boxes as ``x1,y1,x2,y2`` text; rows with another shape or an unused type are dropped."""
    parts = F.split("bounds_imcoords", ",")
    nums = F.transform(parts, lambda p: F.trim(p).try_cast("int").cast("double"))
    d = rows.withColumn("_n", nums).where((F.size("_n") == 4) & ~F.exists("_n", lambda v: v.isNull()))
    b = B.Box(*[F.col("_n")[i] for i in range(4)])
    return _labels(d, xview_class(F.col("type_id")), B.xyxy_to_xywhn(b, F.col("img_w"), F.col("img_h"), clip=True), keep).where("cls IS NOT NULL")


def from_voc(rows: DataFrame, names: list[str], keep: str) -> DataFrame:
    """Difficult objects and unknown names dropped; centres lie one pixel towards the origin."""
    cls = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")) - 1
    w, h = F.col("img_w"), F.col("img_h")
    b = B.Box(((F.col("xmin") + F.col("xmax")) / 2.0 - 1) / w, ((F.col("ymin") + F.col("ymax")) / 2.0 - 1) / h,
              (F.col("xmax") - F.col("xmin")) / w, (F.col("ymax") - F.col("ymin")) / h)
    return _labels(rows.where("difficult <> 1"), cls, b, keep).where("cls >= 0")


def from_argoverse(rows: DataFrame, keep: str) -> DataFrame:
    return _labels(rows, F.col("category_id"), _ltwh_n(F.lit(ARGOVERSE_W), F.lit(ARGOVERSE_H)), keep)


def from_signs(rows: DataFrame, names: list[str], keep: str) -> DataFrame:
    """Traffic-sign objects: unknown categories dropped, all four numbers clipped to 0..1."""
    cls = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("category")) - 1
    b = B.xyxy_to_xywhn(B.box(names=("xmin", "ymin", "xmax", "ymax")), F.col("img_w"), F.col("img_h"))
    return _labels(rows, cls, B.Box(*[B.clamp(c, 0, 1) for c in b]), keep).where("cls >= 0")


def from_objects365(rows: DataFrame, keep: str) -> DataFrame:
    b = B.ltwh_to_xyxy(B.box(names=("left", "top", "width", "height")))
    return _labels(rows, F.col("category_id"), B.xyxy_to_xywhn(b, F.col("img_w"), F.col("img_h"), clip=True), keep)


def tile_labels(objects: DataFrame, keep: str, size: int = 256, gap: int = 64, min_iof: float = 0.7) -> DataFrame:
    """Objects moved to the tiles that hold them: tile name and box relative to the part of the tile in the image."""
    hits = R.tile_objects(objects, ((size, gap),), min_iof)
    tw = F.least(F.col("tile.x2"), F.col("w")) - F.col("tile.x1")
    th = F.least(F.col("tile.y2"), F.col("h")) - F.col("tile.y1")
    name = F.concat(F.col("image_id").cast("string"), F.lit("__"), (F.col("tile.x2") - F.col("tile.x1")).cast("string"), F.lit("__"),
                    F.col("tile.x1").cast("string"), F.lit("___"), F.col("tile.y1").cast("string"))
    moved = B.shift(B.box(), -F.col("tile.x1"), -F.col("tile.y1"))
    return hits.select(keep, "cls", name.alias("tile_name"), (moved.x1 / tw).alias("x1"), (moved.y1 / th).alias("y1"), (moved.x2 / tw).alias("x2"), (moved.y2 / th).alias("y2"))


def _outline(parts: list[np.ndarray]) -> np.ndarray:
    """One closed walk through polygons that follow each other.

    Neighbours are joined by a bridge between their closest points. The walk goes once round the first polygon, over the
    bridges along each polygon to the next bridge, once round the last one, and back along the other side of each polygon.
    """
    if len(parts) == 1:
        return parts[0]
    bridges = []
    for near, far in zip(parts, parts[1:]):
        distance = np.linalg.norm(near[:, None, :] - far[None, :, :], axis=2)
        bridges.append(divmod(int(np.argmin(distance)), len(far)))

    def along(polygon: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Points from ``start`` on to ``stop``, all the way round if they are the same."""
        steps = (stop - start) % len(polygon) or len(polygon)
        return polygon[(start + np.arange(steps + 1)) % len(polygon)]

    there = [along(parts[0], bridges[0][0], bridges[0][0])]
    back: list[np.ndarray] = []
    for polygon, (_, came), (leaves, _) in zip(parts[1:-1], bridges, bridges[1:]):
        there.append(along(polygon, came, leaves) if came != leaves else polygon[[came]])
        back.append(along(polygon, leaves, came))
    last = bridges[-1][1]
    return np.concatenate([*there, along(parts[-1], last, last), *reversed(back)])


@F.pandas_udf(TY.ArrayType(TY.DoubleType()))
def merge_segments(polygons: pd.Series) -> pd.Series:
    """Several polygons of one object (each a flat x, y list) chained into one flat outline."""
    return polygons.map(lambda ps: _outline([np.asarray(p, dtype=float).reshape(-1, 2) for p in ps]).ravel().tolist())
