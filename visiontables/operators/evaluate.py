"""Detection metrics: confusion, precision-recall curves, average precision and their summaries.

A class may hold most of the rows and most of its rows one confidence, so no curve is computed by one window per class:
running totals go over parts of equal depth, and the curves are read at a fixed number of grid points. Of each part only the
first and the last row of a grid cell go on to the aggregate that fills the grid.
"""

from __future__ import annotations

import re
from itertools import chain, count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.operators.match import confusion_conf
from visiontables.operators.ordered import grid_cell, interpolate_on_grid, running_over_parts, sorted_parts
from visiontables.operators.stages import materialize

EPS = 1e-16
PART = ("_part", "_id")


def _neighbour(value: str, step: int) -> Column:
    """``value`` of the row before (-1) or behind (1) along the part, NULL at its ends."""
    return F.lag(value, -step).over(Window.partitionBy("cls", "_part").orderBy("_id"))


def precision_recall(tp_table: DataFrame, totals: DataFrame, n: int = 10) -> DataFrame:
    """Per detection the running hits and their precision and recall at each threshold.

    ``tp_table``: det_id, cls, conf, tp array<int>; ``totals``: cls, n_l (ground truths). Classes without ground truth
    are left out, as they have no recall. Columns _part and _id keep the place along the order. Only the sorted rows are written, their
    hits as bits; the curves follow from them wherever they are read.
    """
    bits = sum((F.shiftleft(F.col("tp")[i].cast("bigint"), i) for i in range(n)), F.lit(0).cast("bigint"))
    rows = sorted_parts(tp_table.select("det_id", "cls", "conf", bits.alias("_hits")), ["cls"], [F.col("conf").desc(), F.col("det_id").asc()])
    aggs = {f"_tp{i}": ("sum", F.getbit("_hits", F.lit(i))) for i in range(n)}
    joined = running_over_parts(rows, ["cls"], {**aggs, "rank": ("sum", F.lit(1))}).join(totals.select("cls", "n_l"), "cls")
    hits = F.array(*[F.col(f"_tp{i}") for i in range(n)])
    return _with_rates(joined.withColumn("rank", F.col("rank").cast("bigint")).withColumn("tpc", hits), n)


def _with_rates(rows: DataFrame, n: int, *more: str) -> DataFrame:
    """Hits, precision and recall of rows that hold their bits, running hits and rank."""
    return rows.select(
        "cls", "det_id", "conf", F.array(*[F.getbit("_hits", F.lit(i)).cast("int") for i in range(n)]).alias("tp"), "rank", "n_l", "tpc",
        F.transform("tpc", lambda h: h / F.col("rank")).alias("precision"),
        F.transform("tpc", lambda h: h / (F.col("n_l") + EPS)).alias("recall"), *more, "_hits", *PART)


def precision_envelope(pr: DataFrame, n: int = 10) -> DataFrame:
    """Add ``env``: the largest precision at this or any lower confidence, per threshold; merged from the parts' own maxima.

    What follows from the running hits does not move with them.
    """
    aggs = {f"_e{i}": ("max", F.col("tpc")[i] / F.col("rank")) for i in range(n)}
    run = running_over_parts(pr.select("cls", "det_id", "conf", "rank", "n_l", "tpc", "_hits", *PART), ["cls"], aggs, backwards=True)
    env = F.array(*[F.col(f"_e{i}") for i in range(n)])
    return _with_rates(run.select("*", env.alias("env")), n, "env")


def pr_points(env: DataFrame, steps: int = 101) -> DataFrame:
    """Envelope precision at even recalls: (cls, thr, g, x, y)."""
    cells = F.transform("recall", lambda x: grid_cell(x, steps))
    near = env.select("cls", "rank", "recall", "env", cells.alias("_c"), *PART).select("*", _neighbour("_c", -1).alias("_was"), _neighbour("_c", 1).alias("_next"))
    same = lambda c, i: F.coalesce(F.get(c, i) == F.get("_c", i), F.lit(False))
    all_ = F.transform("recall", lambda x, i: F.struct(i.alias("thr"), x.alias("r"), F.get("env", i).alias("p"), (same("_was", i) & same("_next", i)).alias("inner")))
    knot = lambda thr, r, p, rank: F.struct(thr.alias("thr"), r.alias("r"), p.alias("p"), rank.cast("bigint").alias("rank"))
    own = F.transform(F.filter(all_, lambda k: ~k["inner"]), lambda k: knot(k["thr"], k["r"], k["p"], F.col("rank")))
    # the first row brings the ends of all curves along
    start = F.transform("recall", lambda _, i: knot(i, F.lit(0.0), F.lit(1.0), F.lit(0)))
    end = F.transform("recall", lambda _, i: knot(i, F.lit(1.0), F.lit(0.0), F.lit(2 ** 62)))
    knots = near.select("cls", F.explode(F.when(F.col("rank") == 1, F.concat(own, start, end)).otherwise(own)).alias("k")).select("cls", "k.*")
    return interpolate_on_grid(knots, ["cls", "thr"], F.col("r"), F.col("p"), F.col("rank"), steps)


def average_precision(env: DataFrame) -> DataFrame:
    """(cls, thr, ap): area under the envelope read at 101 recalls."""
    weight = F.when((F.col("g") == 0) | (F.col("g") == 100), F.lit(0.005)).otherwise(F.lit(0.01))
    return pr_points(env).groupBy("cls", "thr").agg(F.sum(F.col("y") * weight).alias("ap"))


def continuous_ap(env: DataFrame, n: int = 10) -> DataFrame:
    """Area under the envelope by recall steps: each hit adds its recall step times the envelope there."""
    sums = env.groupBy("cls").agg(*[F.sum(F.get("tp", F.lit(i)) * F.get("env", F.lit(i)) / (F.col("n_l") + EPS)).alias(f"_{i}") for i in range(n)])
    return sums.select("cls", F.posexplode(F.array(*[F.col(f"_{i}") for i in range(n)])).alias("thr", "ap")).where("ap is not null")


def confidence_curves(pr: DataFrame, steps: int = 1000, thr: int = 0) -> DataFrame:
    """Precision, recall and F1 over even confidences: (cls, i, px, p, r, f1)."""
    last = steps - 1
    x = 1 - F.col("conf")

    both = F.struct(F.col("precision")[thr].alias("p"), F.col("recall")[thr].alias("r"))
    near = pr.withColumn("_c", grid_cell(x, steps)).select("*", _neighbour("_c", -1).alias("_was"), _neighbour("_c", 1).alias("_next"))
    inner = F.coalesce((F.col("_was") == F.col("_c")) & (F.col("_next") == F.col("_c")), F.lit(False))
    knots = near.where(~inner).select("cls", "rank", x.alias("x"), F.explode(F.array(
        F.struct(F.lit("p").alias("kind"), both["p"].alias("y")), F.struct(F.lit("r").alias("kind"), both["r"].alias("y")))).alias("v"))
    grid = interpolate_on_grid(knots.select("cls", "rank", "x", "v.kind", "v.y"), ["cls", "kind"], F.col("x"), F.col("y"), F.col("rank"),
                               steps, left=float("nan"))
    # above the highest confidence precision reads 1 and recall 0
    value = F.when(F.isnan("y"), F.when(F.col("kind") == "p", F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.col("y"))
    wide = grid.groupBy("cls", (F.lit(last) - F.col("g")).alias("i")).agg(
        F.max(F.when(F.col("kind") == "p", value)).alias("p"), F.max(F.when(F.col("kind") == "r", value)).alias("r"))
    p, r = F.col("p"), F.col("r")
    return wide.select("cls", "i", (F.col("i") / last).alias("px"), "p", "r", (2 * p * r / (p + r + EPS)).alias("f1"))


def box_smooth(curve: DataFrame, value: str, fraction: float = 0.1, n: int = 1000) -> DataFrame:
    """Box filter over a curve of n points in column i, edge values repeated."""
    width = round(n * fraction * 2) // 2 + 1
    half = width // 2
    w = Window.orderBy("i").rowsBetween(-half, half)
    whole = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i = F.col("i")
    low = F.greatest(F.lit(half) - i, F.lit(0)) * F.first(value).over(whole)
    high = F.greatest(i + half - (n - 1), F.lit(0)) * F.last(value).over(whole)
    return curve.withColumn("smooth", (F.sum(value).over(w) + low + high) / width)


def best_f1(curves: DataFrame, totals: DataFrame, n: int = 1000) -> DataFrame:
    """Per class precision, recall, F1 and counts at the confidence where the smoothed mean F1 peaks."""
    n_classes = totals.agg(F.count("*")).scalar()
    mean = curves.groupBy("i").agg(F.sum("f1").alias("s")).select("i", (F.col("s") / n_classes).alias("m"))
    peak = box_smooth(mean, "m", 0.1, n).agg(F.max_by("i", F.struct("smooth", -F.col("i"))).alias("i"))
    at = curves.join(peak, "i").select("cls", "p", "r", "f1")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p", "r", "f1")]
    full = totals.join(at, "cls", "left").select("cls", "n_l", *zero)
    tp = F.bround(F.col("r") * F.col("n_l"))
    return full.withColumn("tp", tp).withColumn("fp", F.bround(F.col("tp") / (F.col("p") + EPS) - F.col("tp")))


def ap_per_class(tp_table: DataFrame, totals: DataFrame) -> DataFrame:
    """Per class AP at ten thresholds and the best-F1 point; classes without detections score 0."""
    pr = precision_recall(materialize(tp_table, "hits"), totals)
    ap = average_precision(precision_envelope(pr)).groupBy("cls").agg(
        F.max(F.when(F.col("thr") == 0, F.col("ap"))).alias("ap50"), F.max(F.when(F.col("thr") == 5, F.col("ap"))).alias("ap75"),
        F.avg("ap").alias("ap"))
    best = best_f1(confidence_curves(pr), totals)
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ap50", "ap75", "ap")]
    return best.join(ap, "cls", "left").select("cls", "n_l", "p", "r", "f1", "tp", "fp", *zero)


def class_totals(gts: DataFrame) -> DataFrame:
    return gts.groupBy("cls").agg(F.count("*").alias("n_l"), F.count_distinct("image_id").alias("n_images"))


def detection_metrics(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.avg("p").alias("mp"), F.avg("r").alias("mr"), F.avg("ap50").alias("map50"), F.avg("ap75").alias("map75"),
                         F.avg("ap").alias("map")).withColumn("fitness", F.col("map"))


def task_metrics(box: DataFrame, task: DataFrame | None = None) -> DataFrame:
    """Summary of a pose or segment run: box and task means side by side, fitness their sum; box only without ``task``."""
    b = detection_metrics(box)
    if task is None:
        return b
    names = ("mp", "mr", "map50", "map75", "map")
    t = detection_metrics(task).select(F.struct(*names, "fitness").alias("t")).scalar()
    return b.withColumn("_t", t).select(*names, *[F.col(f"_t.{c}").alias(f"task_{c}") for c in names], (F.col("fitness") + F.col("_t.fitness")).alias("fitness"))


# --- confusion ---------------------------------------------------------------------------------------------------

def confusion_matrix(dets: DataFrame, gts: DataFrame, pairs: DataFrame, nc: int, conf: float | None = 0.25,
                     oriented: bool = False) -> DataFrame:
    """Long form (pred, actual, n) with background = nc; ``pairs`` from match_for_confusion."""
    used = dets.where(F.col("conf") > confusion_conf(conf, oriented))
    hit = pairs.select("pred", "actual")
    spurious = used.join(pairs.select("det_id"), "det_id", "left_anti").select(F.col("cls").alias("pred"), F.lit(nc).alias("actual"))
    missed = gts.join(pairs.select("gt_id"), "gt_id", "left_anti").select(F.lit(nc).alias("pred"), F.col("cls").alias("actual"))
    return hit.unionByName(spurious).unionByName(missed).groupBy("pred", "actual").agg(F.count("*").alias("n"))


def confusion_classify(df: DataFrame, pred: str, actual: str) -> DataFrame:
    return df.groupBy(F.col(pred).alias("pred"), F.col(actual).alias("actual")).agg(F.count("*").alias("n"))


def confusion_summary(matrix: DataFrame, names: list[str], normalize: bool = False, digits: int = 5) -> DataFrame:
    """Wide form, one row per predicted class; ``names`` include the background for detection."""
    clean = clean_names(names)
    total = Window.partitionBy("actual")
    value = F.col("n") / (F.sum("n").over(total) + 1e-9) if normalize else F.col("n").cast("double")
    labels = F.array(*[F.lit(c) for c in clean])
    wide = (matrix.withColumn("v", value).groupBy("pred").pivot("actual", list(range(len(clean)))).agg(F.first("v")))
    every = matrix.sparkSession.range(len(clean)).select(F.col("id").cast("int").alias("pred"))
    return every.join(wide, "pred", "left").select(
        F.get(labels, F.col("pred")).alias("Predicted"),
        *[F.round(F.coalesce(F.col(str(i)), F.lit(0.0)), digits).alias(c) for i, c in enumerate(clean)])


def clean_names(names: list[str]) -> list[str]:
    """Names of ASCII letters, digits and underscores; one that differs from an earlier one in case only, or not at all, is numbered."""
    out: dict[str, str] = {}
    for safe in (re.sub("[^0-9A-Za-z_]", "_", name) for name in names):
        numbered = chain([safe], (f"{safe}_{k}" for k in count(1)))
        free = next(name for name in numbered if name.casefold() not in out)
        out[free.casefold()] = free
    return list(out.values())


def tp_fp(matrix: DataFrame, nc: int, classify: bool = False) -> DataFrame:
    same = F.col("pred") == F.col("actual")
    rows = matrix if classify else matrix.where(F.col("pred") < nc)
    return rows.groupBy(F.col("pred").alias("cls")).agg(
        F.sum(F.when(same, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~same, F.col("n")).otherwise(0)).alias("fp"))


def topk_accuracy(df: DataFrame, ranked: str, target: str, k: int = 5) -> DataFrame:
    """Share of rows whose target is first, or among the first k, of a ranked class list; fitness is their mean."""
    hit1 = F.get(ranked, F.lit(0)) == F.col(target)
    hitk = F.array_contains(F.slice(ranked, 1, k), F.col(target))
    out = df.agg(F.avg(hit1.cast("int")).alias("top1"), F.avg(hitk.cast("int")).alias(f"top{k}"))
    return out.withColumn("fitness", (F.col("top1") + F.col(f"top{k}")) / 2)


def binary_stats(df: DataFrame, keys: list[str], score: Column, truth: Column, threshold: Column) -> DataFrame:
    """Counts and rates of ``score >= threshold`` against a boolean truth."""
    yes = score >= threshold
    counts = df.groupBy(*keys).agg(
        F.count_if(truth & yes).alias("tp"), F.count_if(~truth & yes).alias("fp"),
        F.count_if(~truth & ~yes).alias("tn"), F.count_if(truth & ~yes).alias("fn"))
    return counts.select("*", *rate_columns())


def rate_columns() -> list[Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    one = F.lit(1)
    precision, recall = tp / F.greatest(tp + fp, one), tp / F.greatest(tp + fn, one)
    tnr = tn / F.greatest(tn + fp, one)
    f1 = F.when(precision + recall > 0, 2.0 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).otherwise(F.lit(0.0))
    return [((tp + tn) / F.greatest(tp + fp + tn + fn, one)).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), (0.5 * (recall + tnr)).alias("balanced_accuracy")]


def calibrate_threshold(df: DataFrame, label: str, score: str, truth: str, default: float, min_samples: int = 1) -> DataFrame:
    """Best score threshold per label by F1, then balanced accuracy, precision, accuracy, then the lowest threshold.

    Scores are reduced to counts per distinct value first; running totals over those give every candidate's table.
    """
    counts = df.groupBy(label, F.col(score).alias("thr")).agg(
        F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    totals = counts.groupBy(label).agg(F.sum("pos").alias("n_correct"), F.sum("neg").alias("n_incorrect"))
    ends = totals.select(label, F.explode(F.array(F.lit(0.0), F.lit(100.0))).alias("thr"), F.lit(0).cast("bigint").alias("pos"),
                         F.lit(0).cast("bigint").alias("neg"))
    points = counts.unionByName(ends).groupBy(label, "thr").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranked = sorted_parts(points, [label], [F.col("thr").desc()])
    cum = running_over_parts(ranked, [label], {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))})
    table = cum.join(totals, label).withColumn("fn", F.col("n_correct") - F.col("tp")).withColumn("tn", F.col("n_incorrect") - F.col("fp"))
    rated = table.select("*", *rate_columns())
    key = F.struct("f1", "balanced_accuracy", "precision", "accuracy", (-F.col("thr")).alias("low"))
    best = rated.groupBy(label).agg(F.max_by(F.struct("thr", "f1", "balanced_accuracy"), key).alias("b"), F.first("n_correct").alias("n_correct"),
                                    F.first("n_incorrect").alias("n_incorrect"))
    few = (F.col("n_correct") < min_samples) | (F.col("n_incorrect") < min_samples)
    return best.select(
        label, F.when(few, F.lit(float(default))).otherwise(F.col("b.thr")).alias("threshold"),
        F.when(few, "fallback_default").otherwise("calibrated").alias("status"), F.when(few, "insufficient_samples").alias("reason"),
        F.when(~few, F.col("b.f1")).alias("f1"), F.when(~few, F.col("b.balanced_accuracy")).alias("balanced_accuracy"),
        "n_correct", "n_incorrect")
