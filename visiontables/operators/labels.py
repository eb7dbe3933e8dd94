"""Row-wise work on labels and detections: scaling, class maps, simple filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.functions import geometry as G

# Category numbers 1..91 that the 80-class set leaves out (fixed values).
UNUSED_91 = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91)


def _class_map(pairs) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs for v in pair])


def remap_class(cls: Column, mapping: dict[int, int]) -> Column:
    """Look a class up in a bounded mapping; NULL where the mapping has no entry or says -1 (drop)."""
    return F.try_element_at(_class_map((k, v) for k, v in mapping.items() if v != -1), cls.cast("int"))


def coco91_to_80(cls: Column) -> Column:
    used = [c for c in range(1, 92) if c not in UNUSED_91]
    return remap_class(cls, {c: i for i, c in enumerate(used)})


def coco80_to_91(cls: Column) -> Column:
    used = [c for c in range(1, 92) if c not in UNUSED_91]
    return remap_class(cls, dict(enumerate(used)))


def normalize(b: B.Box, w: Column, h: Column) -> B.Box:
    return B.Box(b[0] / w, b[1] / h, b[2] / w, b[3] / h)


def denormalize(b: B.Box, w: Column, h: Column) -> B.Box:
    return scale_instance(b, w, h)


def scale_instance(b: B.Box, sx, sy) -> B.Box:
    return B.Box(b[0] * sx, b[1] * sy, b[2] * sx, b[3] * sy)


def scale_points(pts: Column, from_hw, to_hw, normalize: bool = False, padding: bool = True) -> Column:
    """Undo letterboxing of points and clip them to the image."""
    fh, fw = [c if isinstance(c, Column) else F.lit(float(c)) for c in from_hw]
    th, tw = [c if isinstance(c, Column) else F.lit(float(c)) for c in to_hw]
    gain = F.least(fh / th, fw / tw)
    px, py = ((fw - tw * gain) / 2, (fh - th * gain) / 2) if padding else (F.lit(0.0), F.lit(0.0))

    def place(v, pad, bound):
        out = B.clamp((v - pad) / gain, 0, bound)
        return out / bound if normalize else out

    return G.map_points(pts, lambda x: place(x, px, tw), lambda y: place(y, py, th))


def clip_keypoints(kpts: Column, w: Column, h: Column) -> Column:
    """Clip joints to the image; a joint that was outside loses its visibility."""
    def fix(p):
        out = (p["x"] < 0) | (p["x"] > w) | (p["y"] < 0) | (p["y"] > h)
        return F.struct(B.clamp(p["x"], 0, w).alias("x"), B.clamp(p["y"], 0, h).alias("y"),
                        F.when(out, F.lit(0.0)).otherwise(p["c"]).alias("c"))

    return F.transform(kpts, fix)


def mean_point(pts: Column) -> Column:
    n = F.size(pts)

    def total(axis):
        return F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p[axis])

    return F.struct(F.try_divide(total("x"), n).alias("x"), F.try_divide(total("y"), n).alias("y"))


def filter_detections(df: DataFrame, min_conf: float, classes: Sequence[int] | None = None) -> DataFrame:
    kept = df.where(F.col("conf") > min_conf)
    return kept.where(F.col("cls").isin(list(classes))) if classes is not None else kept


def best_class(scores: Column) -> tuple[Column, Column]:
    """Index of the best score (first on ties) and the score."""
    top = F.array_max(scores)
    return (F.array_position(scores, top) - 1).cast("int"), top


def multi_label(df: DataFrame, scores: str, min_score: float) -> DataFrame:
    """One row per class whose score is above the threshold."""
    rest = [c for c in df.columns if c != scores]
    return df.select(*rest, F.posexplode(scores).alias("cls", "score")).where(F.col("score") > min_score)


def include_classes(df: DataFrame, classes: Sequence[int] | None = None, single_cls: bool = False) -> DataFrame:
    out = df.where(F.col("cls").isin(list(classes))) if classes is not None else df
    return out.withColumn("cls", F.lit(0)) if single_cls else out


def zone_filter(df: DataFrame, polygon) -> DataFrame:
    """Objects whose centre is inside the convex hull of a fixed polygon."""
    hull = planar_hull(polygon)
    b = B.box()
    return df.where(G.point_in_polygon((b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, hull))


def planar_hull(points) -> list[tuple[float, float]]:
    """Convex hull of a handful of configuration points."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def sweep(seq):
        out: list[tuple[float, float]] = []
        for x, y in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    return sweep(pts) + sweep(pts[::-1])


def top_classes(df: DataFrame, scores: str, keys: Sequence[str], k: int = 5, softmax: bool = True) -> DataFrame:
    """The k best classes of each row with their (softmax) score, ties to the lower class."""
    ranked = F.slice(F.array_sort(F.transform(scores, lambda v, i: F.struct((-v.cast("double")).alias("n"), i.alias("cls")))), 1, k)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double")))
    d = df.select(*keys, total.alias("_t"), F.posexplode(ranked).alias("rank", "_r"))
    value = F.exp(-F.col("_r.n")) / F.col("_t") if softmax else -F.col("_r.n")
    return d.select(*keys, "rank", F.col("_r.cls").alias("cls"), value.alias("p"))
