"""Overlap joins, suppression and matching between boxes of the same image.

Pairs are found through grid cells: a box is copied to the cells it touches and boxes meet only inside a cell, so a
crowded image is spread over its cells instead of being one join key. A pair is produced once, in the cell that
holds the left-top corner of the overlap.

Spark's size estimate of a table does not know how many copies ``explode`` makes, so a side that looks small enough to be
broadcast may fill the driver: joins of copies ask for a sort-merge join, which adaptive execution still splits where it is skewed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.functions.assignment import assign
from visiontables.operators.stages import discard, materialize

CELL = 128
#: Boxes of one image that are folded in one array, at most.
FOLD = 1000
THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def _span(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.greatest(F.floor(low / size), F.floor(high / size)))


def to_cells(df: DataFrame, reach: B.Box, size: float = CELL) -> DataFrame:
    """One copy of each row per grid cell that ``reach`` touches, in columns _cx, _cy."""
    return (df.withColumn("_cx", F.explode(_span(reach.x1, reach.x2, size)))
            .withColumn("_cy", F.explode(_span(reach.y1, reach.y2, size))))


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def overlap_pairs(a: DataFrame, b: DataFrame, on: Sequence[str] = ("image_id",), extra: Column | None = None,
                  size: float = CELL) -> DataFrame:
    """Pairs of rows that share ``on`` and whose x1..y2 boxes overlap; other columns get prefixes a_ and b_."""
    left = to_cells(prefixed(a, "a_", on), B.box("a_"), size)
    right = to_cells(prefixed(b, "b_", on), B.box("b_"), size)
    p, q = B.box("a_"), B.box("b_")
    home = ((F.col("_cx") == F.floor(F.greatest(p.x1, q.x1) / size)) & (F.col("_cy") == F.floor(F.greatest(p.y1, q.y1) / size)))
    out = left.join(right.hint("merge"), [*on, "_cx", "_cy"]).where(B.overlaps(p, q) & home)
    return (out.where(extra) if extra is not None else out).drop("_cx", "_cy")


def overlap_join(a: DataFrame, b: DataFrame, threshold: float, on: Sequence[str] = ("image_id",),
                 metric: Callable[[B.Box, B.Box], Column] = B.iou, extra: Column | None = None) -> DataFrame:
    """Overlap join: pairs with metric at or above a positive threshold, the metric in column ``overlap``."""
    pairs = overlap_pairs(a, b, on, extra).withColumn("overlap", metric(B.box("a_"), B.box("b_")))
    return pairs.where(F.col("overlap") >= threshold)


def crowds(rows: DataFrame, by: Sequence[str], fold: int = FOLD) -> DataFrame | None:
    """The groups of more than ``fold`` rows, written, or None where there is none."""
    found = materialize(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > fold).select(*by), "crowded")
    return None if found.isEmpty() else found


# --- matching ----------------------------------------------------------------------------------------------------

def _best(pairs: DataFrame, key: str, other: str, carry: Sequence[str] = ()) -> DataFrame:
    """Per ``key`` the pair of largest overlap, ties to the smaller ``other``; aggregated map-side."""
    top = F.max_by(F.struct(other, "overlap", *carry), F.struct(F.col("overlap"), -F.col(other))).alias("_t")
    return pairs.groupBy(key).agg(top).select(key, f"_t.{other}", "_t.overlap", *[f"_t.{c}" for c in carry])


def match_candidates(dets: DataFrame, gts: DataFrame, min_overlap: float = THRESHOLDS[0],
                     metric: Callable[[B.Box, B.Box], Column] = B.iou) -> DataFrame:
    """Each detection's best ground truth of its class: (det_id, gt_id, overlap, conf).

    Only where an image is crowded do boxes meet in cells; without crowds they meet in their image and class and are not copied.
    """
    on = ("image_id", "cls")
    a, b = dets.select(*on, "det_id", "conf", "x1", "y1", "x2", "y2"), gts.select(*on, "gt_id", "x1", "y1", "x2", "y2")
    if any(crowds(side, on[:1]) is not None for side in (a, b)):
        pairs = overlap_join(a, b, min_overlap, on=on, metric=metric)
    else:
        met = prefixed(a, "a_", on).join(prefixed(b, "b_", on).hint("merge"), list(on)).where(B.overlaps(B.box("a_"), B.box("b_")))
        pairs = met.withColumn("overlap", metric(B.box("a_"), B.box("b_"))).where(F.col("overlap") >= min_overlap)
    pairs = pairs.select(F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"), "overlap", F.col("a_conf").alias("conf"))
    return _best(pairs, "det_id", "gt_id", ["conf"])


def match_for_ap(candidates: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """True positives as rows (thr, det_id, gt_id).

    Each ground truth takes, per threshold, the most confident of the detections that chose it; one aggregate per
    threshold over the same groups replaces a sort per threshold. The candidates, one a detection at most, are fewer bytes than the
    aggregates, so they move and not these.
    """
    order = F.struct(-F.col("conf"), F.col("det_id").alias("det_id"))
    best = candidates.repartition("gt_id").groupBy("gt_id").agg(*[
        F.min(F.when(F.col("overlap") >= t, order)).alias(f"_t{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(i).alias("thr"), F.col(f"_t{i}.det_id").alias("det_id")) for i in range(len(thresholds))])
    return best.select("gt_id", F.explode(rows).alias("r")).select("r.thr", "r.det_id", "gt_id").where("det_id IS NOT NULL")


def true_positive_table(dets: DataFrame, matches: DataFrame, n_thresholds: int = len(THRESHOLDS)) -> DataFrame:
    """Every detection with its hit flags: (det_id, cls, conf, tp array<int>)."""
    hits = matches.groupBy("det_id").agg(F.expr("bit_or(shiftleft(1L, thr))").alias("_hits"))
    bits = F.coalesce("_hits", F.lit(0).cast("bigint"))
    flags = F.array(*[F.getbit(bits, F.lit(i)).cast("int") for i in range(n_thresholds)])
    return dets.select("det_id", "cls", "conf").join(hits, "det_id", "left").select("det_id", "cls", "conf", flags.alias("tp"))


def match_for_confusion(dets: DataFrame, gts: DataFrame, conf: float | None = 0.25, iou: float = 0.45,
                        oriented: bool = False) -> DataFrame:
    """Class-blind one-to-one pairs: best ground truth per detection, then best detection per ground truth."""
    conf = confusion_conf(conf, oriented)
    pairs = overlap_join(dets.where(F.col("conf") > conf).select("image_id", "det_id", "cls", "x1", "y1", "x2", "y2"),
                         gts.select("image_id", "gt_id", "cls", "x1", "y1", "x2", "y2"), iou)
    pairs = pairs.where(F.col("overlap") > iou).select(
        F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"), "overlap",
        F.col("a_cls").alias("pred"), F.col("b_cls").alias("actual"))
    per_det = _best(pairs, "det_id", "gt_id", ["pred", "actual"])
    return _best(per_det, "gt_id", "det_id", ["pred", "actual"])


def confusion_conf(conf: float | None, oriented: bool = False) -> float:
    """The validation default stands for 0.25."""
    return 0.25 if conf is None or conf == (0.01 if oriented else 0.001) else conf


def optimal_match(pairs: DataFrame, group: str, row: str, col: str, cost: str, limit: float) -> DataFrame:
    """Least-cost one-to-one matching inside each group of candidate pairs cheaper than ``limit``.

    A group is one frame's pairs; its size is bounded by the detections a frame may hold.
    """
    schema = f"{group} bigint, {row} bigint, {col} bigint, {cost} double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, i = np.unique(pdf[row].to_numpy(), return_inverse=True)
        cols, j = np.unique(pdf[col].to_numpy(), return_inverse=True)
        c = np.full((len(rows), len(cols)), limit)
        np.minimum.at(c, (i, j), pdf[cost].to_numpy())
        hit = assign(c, limit)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(hit), row: [rows[i] for i, _ in hit],
                             col: [cols[j] for _, j in hit], cost: [c[i, j] for i, j in hit]})

    return pairs.where(F.col(cost) < limit).select(group, row, col, cost).groupBy(group).applyInPandas(solve, schema)


# --- suppression -------------------------------------------------------------------------------------------------

def suppress_fast(dets: DataFrame, threshold: float, on: Sequence[str] = ("image_id", "cls"),
                  overlap: Callable[[str, str], Column] | None = None, reach: B.Box | None = None,
                  size: float = CELL, fold: int = FOLD, extra: Sequence[Column] = ()) -> DataFrame:
    """Drop a box when any better box of its group overlaps it by at least ``threshold``.

    An anti join stops at the first better box, so crowded places cost no list of pairs. A group of up to ``fold`` boxes is one join
    key and its boxes move once, before what is only needed to compare them (``reach``, and ``extra`` for ``overlap``) is computed;
    those of a larger one are copied to the cells they touch, and a pair is tested in one cell only.
    """
    overlap = overlap or (lambda a, b: B.iou(B.box(a), B.box(b)))
    bounds = ("_rx1", "_ry1", "_rx2", "_ry2")
    bounded = lambda rows: rows.select("*", *extra, *(reach or B.box()).named(*bounds))
    better = (F.col("b_conf") > F.col("a_conf")) | ((F.col("b_conf") == F.col("a_conf")) & (F.col("b_det_id") < F.col("a_det_id")))
    # the cheap test of the bounds comes first
    mine, its = B.box("a_", bounds), B.box("b_", bounds)

    same = reduce(lambda x, y: x & y, [F.col("a_" + k) == F.col("b_" + k) for k in on])
    # a number that is never NULL as key, and a test that is never NULL: Spark derives no filters from them, so both sides of the join are one shuffle
    group = F.when(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in on]), F.xxhash64(*on)).otherwise(F.xxhash64("det_id"))

    def beaten(rows: DataFrame, keys: Sequence[str], near: Column, how: str) -> DataFrame:
        clash = F.coalesce(same & near & B.overlaps(mine, its) & better & (overlap("a_", "b_") >= threshold), F.lit(False))
        met = reduce(lambda x, y: x & y, [F.col("a_" + k) == F.col("b_" + k) for k in keys])
        return prefixed(rows, "a_").join(prefixed(rows, "b_").hint("merge"), met & clash, how)

    def whole(rows: DataFrame) -> DataFrame:
        moved = bounded(rows.withColumn("_group", group).repartition("_group"))
        return beaten(moved, ["_group"], F.lit(True), "left_anti").select(*[F.col("a_" + c).alias(c) for c in dets.columns])

    crowded = crowds(dets, on, fold)
    if crowded is None:
        return whole(dets)
    home = (F.col("a__cx") == F.floor(F.greatest(mine.x1, its.x1) / size)) & (F.col("a__cy") == F.floor(F.greatest(mine.y1, its.y1) / size))
    crowd = dets.join(crowded, list(on), "left_semi").select(*dets.columns)
    spread = to_cells(bounded(crowd), B.box("", bounds), size)
    lost = beaten(spread, [*on, "_cx", "_cy"], home, "left_semi").select(F.col("a_det_id").alias("det_id")).distinct()
    kept = crowd.join(lost, "det_id", "left_anti").select(*dets.columns)
    return whole(dets.join(crowded, list(on), "left_anti").select(*dets.columns)).unionByName(kept)


def suppress_rotated(dets: DataFrame, threshold: float, on: Sequence[str] = ("image_id", "cls")) -> DataFrame:
    """Fast suppression of oriented boxes by probabilistic IoU.

    Overlap t bounds the centre distance by k * (m1 + m2), m the longer side, so squares of half side k*m must meet:
    cells stay exact although the Gaussians have no edge.
    """
    k = math.sqrt(-4 * math.log(1 - (1 - threshold) ** 2) / 12) + 1e-3
    r = F.greatest("w", "h") * k + 1e-3
    reach = B.Box(F.col("cx") - r, F.col("cy") - r, F.col("cx") + r, F.col("cy") + r)
    shape = lambda p: tuple(F.col(f"{p}{c}") for c in ("_sa", "_sb", "_sc"))
    gauss = lambda a, b: B.gaussian_overlap(F.col(f"{a}cx") - F.col(f"{b}cx"), F.col(f"{a}cy") - F.col(f"{b}cy"), shape(a), shape(b))
    return suppress_fast(dets, threshold, on, gauss, reach, extra=B.spread_columns(B.obb()))


def top_boxes(dets: DataFrame, n: int, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """The n most confident boxes of each group (a group limit runs before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(F.col("conf").desc(), F.col("det_id"))
    return dets.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def nms_greedy(dets: DataFrame, iou: float = 0.45, conf: float | None = None, max_det: int | None = None,
               max_nms: int | None = None, agnostic: bool = False, by: Sequence[str] = ("image_id",), fold: int = FOLD) -> DataFrame:
    """Greedy suppression: keep a box while its IoU with every kept box of its class is at most ``iou``.

    Boxes go by falling confidence, ties by det_id. Nothing is cut unless asked for: ``max_nms`` bounds the boxes of one group
    before, ``max_det`` the kept ones. A group of up to ``fold`` boxes is folded in one array; the boxes of a larger one, be they
    all of the table, are decided in rounds over the pairs that overlap.
    """
    rows = dets.where(F.col("conf") > conf) if conf is not None else dets
    rows = top_boxes(rows, max_nms, by) if max_nms is not None else rows
    crowded = materialize(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > fold).select(*by), "crowded")
    if crowded.isEmpty():
        return _folded(rows, iou, max_det, agnostic, by).select(*dets.columns)
    kept = _by_rounds(rows.join(crowded, list(by), "left_semi"), iou, agnostic, by)
    kept = top_boxes(kept, max_det, by) if max_det is not None else kept
    return _folded(rows.join(crowded, list(by), "left_anti"), iou, max_det, agnostic, by).unionByName(kept).select(*dets.columns)


def _folded(rows: DataFrame, iou: float, max_det: int | None, agnostic: bool, by: Sequence[str]) -> DataFrame:
    item = F.struct((-F.col("conf")).alias("neg"), "det_id", *[c for c in rows.columns if c not in by and c != "det_id"])
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("_all"))

    def sbox(s):
        return B.Box(s["x1"], s["y1"], s["x2"], s["y2"])

    def clash(k, b):
        return (_share(sbox(k), sbox(b)) > iou) if agnostic else (k["cls"] == b["cls"]) & (_share(sbox(k), sbox(b)) > iou)

    def step(acc, b):
        full = F.exists(acc, lambda k: clash(k, b))
        if max_det is not None:
            full = (F.size(acc) >= max_det) | full
        return F.when(full, acc).otherwise(F.array_append(acc, b))

    kept = F.aggregate("_all", F.slice("_all", 1, 0), step)
    return lists.select(*by, F.explode(kept).alias("b")).select(*by, "b.*").drop("neg")


def _share(a: B.Box, b: B.Box) -> Column:
    inter = B.intersection(a, b)
    return inter / (B.area(a) + B.area(b) - inter)


def _by_rounds(rows: DataFrame, iou: float, agnostic: bool, by: Sequence[str]) -> DataFrame:
    """The boxes that greedy suppression keeps, as a fixpoint over edges from a box to each better one that it clashes with.

    A better box without edges of its own is kept, so those that lead to it are lost, with all edges from and to them; whoever
    has no edge left is kept. Rounds grow with the longest chain of boxes that decide over each other.
    """
    on = list(by) if agnostic or "cls" in by else [*by, "cls"]
    slim = rows.select(*on, "det_id", "conf", "x1", "y1", "x2", "y2")
    better = (F.col("b_conf") > F.col("a_conf")) | ((F.col("b_conf") == F.col("a_conf")) & (F.col("b_det_id") < F.col("a_det_id")))
    clash = overlap_pairs(slim, slim, on, better).where(_share(B.box("a_"), B.box("b_")) > iou)
    edges = materialize(clash.select(F.col("a_det_id").alias("worse"), F.col("b_det_id").alias("better")), "clashes")
    lost, stages = [], [edges]
    while not edges.isEmpty():
        open_ = edges.select(F.col("worse").alias("better")).distinct()
        gone = materialize(edges.join(open_, "better", "left_anti").select("worse").distinct(), "lost")
        lost.append(gone)
        left = edges.join(gone, "worse", "left_anti").join(gone.withColumnRenamed("worse", "better"), "better", "left_anti")
        edges = materialize(left.select("worse", "better"), "clashes")
        stages.append(edges)
    for stage in stages:
        discard(stage)
    if not lost:
        return rows
    every = reduce(DataFrame.unionAll, lost).withColumnRenamed("worse", "det_id")
    return rows.join(every, "det_id", "left_anti").select(*rows.columns)


def nms_batched(dets: DataFrame, iou: float = 0.45, max_nms: int | None = None) -> DataFrame:
    """Greedy suppression of each class of an image on its own."""
    return nms_greedy(dets, iou, max_nms=max_nms, agnostic=True, by=("image_id", "cls"))


def merge_tiles(dets: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Move tile detections (tile name ``image__size__x___y``) back to their image and suppress doubles."""
    placed = dets.select(
        "det_id", F.regexp_extract("tile", r"^(.*?)__", 1).alias("image"), "cls", "conf",
        (F.col("cx") + F.regexp_extract("tile", r"(\d+)___(\d+)", 1).cast("double")).alias("cx"),
        (F.col("cy") + F.regexp_extract("tile", r"(\d+)___(\d+)", 2).cast("double")).alias("cy"), "w", "h", "theta")
    return suppress_rotated(placed, threshold, on=("image", "cls"))


# --- box rules that need a partner table -------------------------------------------------------------------------

def paste_candidates(src: DataFrame, dst: DataFrame, max_ioa: float = 0.30) -> DataFrame:
    """Source boxes that cover less than ``max_ioa`` of every target box of the image."""
    hits = overlap_join(src, dst, max_ioa, metric=B.ioa)
    return src.join(hits.select(F.col("a_src_id").alias("src_id")).distinct(), "src_id", "left_anti")


def free_areas(areas: DataFrame, boxes: DataFrame) -> DataFrame:
    """Areas that no box of the image touches."""
    hits = overlap_pairs(areas, boxes).select(F.col("a_area_id").alias("area_id")).distinct()
    return areas.join(hits.hint("merge"), "area_id", "left_anti")


def erased_boxes(areas: DataFrame, boxes: DataFrame, min_ioa: float = 0.1) -> DataFrame:
    """Boxes of which some area covers at least ``min_ioa``."""
    return overlap_join(areas, boxes, min_ioa, metric=B.ioa)


def tracker_cost(tracks: DataFrame, dets: DataFrame, on: Sequence[str] = ("image_id",), proximity: float = 0.5,
                 appearance: float = 0.25) -> DataFrame:
    """Cost of overlapping track/detection pairs; a pair that does not overlap costs 1 and is left out.

    ``iou_cost`` is 1 - IoU, ``fused_cost`` weighs it with the detection score, ``cost`` is the lesser of that and half
    the appearance distance where both gates let appearance speak (column ``feat`` on both sides, optional).
    """
    pairs = overlap_pairs(tracks, dets, on).withColumn("iou_cost", 1 - B.iou(B.box("a_"), B.box("b_"), eps=1e-7))
    pairs = pairs.withColumn("fused_cost", 1 - (1 - F.col("iou_cost")) * F.col("b_conf"))
    if "feat" not in tracks.columns:
        return pairs.withColumn("cost", F.col("fused_cost"))
    from visiontables.functions.pose import cosine
    looks = F.greatest(F.lit(0.0), 1 - cosine(F.col("a_feat"), F.col("b_feat"))) / 2
    gated = F.when((looks > 1 - appearance) | (F.col("iou_cost") > 1 - proximity), F.lit(1.0)).otherwise(looks)
    return pairs.withColumn("looks_cost", gated).withColumn("cost", F.least("fused_cost", "looks_cost"))


# --- candidates of the other tasks -------------------------------------------------------------------------------

def _reach_pairs(dets: DataFrame, gts: DataFrame, det_reach: B.Box, gt_reach: B.Box) -> DataFrame:
    names = ("x1", "y1", "x2", "y2")
    a = dets.select(*[c for c in dets.columns if c not in names], *det_reach.named(*names))
    b = gts.select(*[c for c in gts.columns if c not in names], *gt_reach.named(*names))
    return overlap_pairs(a, b, ("image_id", "cls"))


def _candidates(pairs: DataFrame, overlap: Column, least: float) -> DataFrame:
    p = pairs.select(F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"), overlap.alias("overlap"), F.col("a_conf").alias("conf"))
    return _best(p.where(F.col("overlap") >= least), "det_id", "gt_id", ["conf"])


def oriented_candidates(dets: DataFrame, gts: DataFrame, least: float = THRESHOLDS[0]) -> DataFrame:
    """As ``match_candidates`` for oriented boxes; squares bound how far apart boxes of that overlap can be."""
    k = math.sqrt(-4 * math.log(1 - (1 - least) ** 2) / 12) + 1e-3
    r = F.greatest("w", "h") * k + 1e-3
    reach = B.Box(F.col("cx") - r, F.col("cy") - r, F.col("cx") + r, F.col("cy") + r)
    ready = [d.select("*", *B.spread_columns(B.obb())) for d in (dets, gts)]
    shape = lambda p: tuple(F.col(f"{p}{c}") for c in ("_sa", "_sb", "_sc"))
    gauss = B.gaussian_overlap(F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy"), shape("b_"), shape("a_"))
    return _candidates(_reach_pairs(*ready, reach, reach), gauss, least)


def pose_candidates(dets: DataFrame, gts: DataFrame, least: float = THRESHOLDS[0], sigmas: list[float] | None = None,
                    joints: tuple[Callable[[str], Column], Callable[[str], Column]] | None = None) -> DataFrame:
    """As ``match_candidates`` by keypoint similarity (column kpts on both sides, area from the truth box).

    Similarity t needs one joint nearer than sqrt(-8 ln t) * sigma * sqrt(area), so the joints' extents, widened by
    that much, must meet. ``joints`` gives each side's keypoints from its other columns under a prefix; they are then made where they are
    compared and do not move. The best pair is found before the threshold is asked, else similarity would be computed twice.
    """
    from visiontables.functions import geometry as G
    from visiontables.functions import pose as P
    on, names = ("image_id", "cls"), ("_rx1", "_ry1", "_rx2", "_ry2")
    mine, its = joints or (lambda p: F.col(f"{p}kpts"), lambda p: F.col(f"{p}kpts"))
    far = math.sqrt(-8 * math.log(least)) * max(sigmas or P.OKS_SIGMAS) + 1e-3

    def bounded(rows: DataFrame, kpts: Column, grow: Column) -> DataFrame:
        box = rows.select("*", B.let(kpts, G.points_box).alias("_box"))
        return box.select(*rows.columns, *[(F.col(f"_box.{c}") + s * grow).alias(n) for c, s, n in zip(("x1", "y1", "x2", "y2"), (-1, -1, 1, 1), names)])

    a = bounded(dets, mine(""), F.lit(0.5))
    b = bounded(gts.withColumn("area", B.area(B.box()) * 0.53), its(""), F.sqrt("area") * far + 0.5)
    p, q = B.box("a_", names), B.box("b_", names)
    left, right, home = prefixed(a, "a_", on), prefixed(b, "b_", on), F.lit(True)
    keys = list(on)
    if any(crowds(side, on[:1]) is not None for side in (dets, gts)):
        left, right, keys = to_cells(left, p), to_cells(right, q), [*on, "_cx", "_cy"]
        home = (F.col("_cx") == F.floor(F.greatest(p.x1, q.x1) / CELL)) & (F.col("_cy") == F.floor(F.greatest(p.y1, q.y1) / CELL))
    met = left.join(right.hint("merge"), keys).where(B.overlaps(p, q) & home)
    pairs = met.select(F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"), B.let(its("b_"), lambda k: P.oks(k, mine("a_"), F.col("b_area"), sigmas)).alias("overlap"), F.col("a_conf").alias("conf"))
    return _best(pairs, "det_id", "gt_id", ["conf"]).where(F.col("overlap") >= least)


def mask_candidates(ious: DataFrame, dets: DataFrame, least: float = THRESHOLDS[0]) -> DataFrame:
    """As ``match_candidates`` from mask IoUs (det_id, gt_id, iou)."""
    p = ious.where(F.col("iou") >= least).join(dets.select("det_id", "conf").hint("merge"), "det_id")
    return _best(p.select("det_id", "gt_id", F.col("iou").alias("overlap"), "conf"), "det_id", "gt_id", ["conf"])
