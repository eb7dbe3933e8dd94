"""Pose sequences: resampling, comparison with a reference library, gates, scored rows.

A sequence is one clip and is held as an array once normalised; everything across clips is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.functions import pose as P


def assemble(poses: DataFrame, keys: Sequence[str] = ("seq_id",), frame: str = "frame", conf: float = 0.2) -> DataFrame:
    """One row per sequence: normalised frames in order, frame count. Frames of an unusual joint count are left out."""
    sizes = poses.groupBy(*keys, F.size("kpts").alias("_k")).agg(F.count("*").alias("_n"), F.min(frame).alias("_f"))
    usual = sizes.groupBy(*keys).agg(F.max_by("_k", F.struct(F.col("_n"), -F.col("_f"))).alias("_k"))
    kept = poses.join(usual, list(keys)).where(F.size("kpts") == F.col("_k"))
    norm = kept.select(*keys, frame, P.normalize_pose(F.col("kpts"), conf).alias("pts"))
    item = F.sort_array(F.collect_list(F.struct(frame, "pts")))
    return norm.groupBy(*keys).agg(item.alias("_l")).select(*keys, F.transform("_l", lambda s: s["pts"]).alias("frames"), F.size("_l").alias("n"))


def pad_frames(frames: Column, length: int, joints: int = 17) -> Column:
    """Frames without any joint behind the last one, up to ``length``."""
    empty = F.array_repeat(F.lit(None).cast("struct<x:double,y:double>"), joints)
    return F.concat(frames, F.array_repeat(empty, F.greatest(F.lit(0), length - F.size(frames))))


def joint_rows(seqs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Normalised joints as rows (keys, i, j, x, y), missing ones with NULLs."""
    f = seqs.select(*keys, "n", F.posexplode("frames").alias("i", "_f"))
    return f.select(*keys, "n", "i", F.posexplode("_f").alias("j", "_p")).select(*keys, "n", "i", "j", "_p.x", "_p.y")


def resample(rows: DataFrame, keys: Sequence[str], target: Column, length: int | None = None) -> DataFrame:
    """Fill gaps (edges nearest, inside linear, nothing seen: 0) and read each joint at ``target`` even moments.

    Input and output rows: keys, n, i, j, x, y. Each row serves the target moments that lie between it and the next. The moments
    spread over the clip, or over ``length`` frames: a clip that ends before has no rows for the moments behind its last frame.
    """
    w = Window.partitionBy(*keys, "j").orderBy("i")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col("x").isNotNull(), F.struct("i", "x", "y"))
    d = rows.withColumn("_p", F.last(here, True).over(back)).withColumn("_n", F.first(here, True).over(ahead))

    def filled(c):
        p, q = F.col("_p"), F.col("_n")
        t = F.try_divide(F.col("i") - p["i"], q["i"] - p["i"])
        return F.coalesce(F.col(c), p[c] + (q[c] - p[c]) * t, p[c], q[c], F.lit(0.0))

    d = d.select(*keys, "n", "i", "j", filled("x").alias("x"), filled("y").alias("y")).withColumn("_t", target)
    d = d.withColumn("_x1", F.lead("x").over(w)).withColumn("_y1", F.lead("y").over(w))
    steps, span = F.col("_t") - 1, (F.col("n") if length is None else F.lit(length)) - 1
    first = F.when(span > 0, F.ceil(F.try_divide(F.col("i") * steps, span))).otherwise(F.lit(0))
    after = F.when((span == 0) | (F.col("i") == span), F.col("_t")).otherwise(F.ceil(F.try_divide((F.col("i") + 1) * steps, span)))
    d = d.withColumn("_lo", first.cast("int")).withColumn("_hi", (F.least(after, F.col("_t")) - 1).cast("int")).where("_lo <= _hi")
    d = d.withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
    t = F.coalesce(F.try_divide(F.col("_k") * span, steps) - F.col("i"), F.lit(0.0))
    t = F.when((span == 0) | F.col("_x1").isNull(), F.lit(0.0)).otherwise(t)
    blend = lambda c: (F.col(c) + F.coalesce(F.col(f"_{c}1") - F.col(c), F.lit(0.0)) * t).alias(c)
    return d.select(*keys, F.col("_t").alias("n"), F.col("_k").alias("i"), "j", blend("x"), blend("y"))


def to_frames(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, n, i, j, x, y) back to one array of frames per key."""
    per = rows.groupBy(*keys, "n", "i").agg(F.sort_array(F.collect_list(F.struct("j", "x", "y"))).alias("_f"))
    per = per.select(*keys, "n", "i", F.transform("_f", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("pts"))
    seq = per.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("i", "pts"))).alias("_l"))
    return seq.select(*keys, "n", F.transform("_l", lambda s: s["pts"]).alias("frames"))


def _resampled(seqs: DataFrame, keys: Sequence[str], target: Column) -> DataFrame:
    out = to_frames(resample(joint_rows(seqs, keys), keys, target), keys)
    return out.withColumn("angles", P.family_angles(F.col("frames"), F.col("technique"))).withColumn("vec", P.flat(F.col("frames")))


def pair_parts(pairs: DataFrame) -> DataFrame:
    """Similarity parts of dense pairs (u_vec, r_vec, u_angles, r_angles): all but the warping distance."""
    def dot(start):
        # x values sit at even positions, y values at odd ones
        prod = F.zip_with("u_vec", "r_vec", lambda a, b: a * b)
        return F.aggregate(F.filter(prod, lambda _, i: i % 2 == start), F.lit(0.0), lambda acc, v: acc + v)

    def norm(c):
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v))

    d = pairs.withColumn("_dx", dot(0)).withColumn("_dy", dot(1)).withColumn("_n", norm("u_vec") * norm("r_vec"))
    tiny = (norm("u_vec") < 1e-6) | (norm("r_vec") < 1e-6)
    plain = F.when(tiny, F.lit(0.0)).otherwise(F.try_divide(F.col("_dx") + F.col("_dy"), F.col("_n")))
    flipped = F.when(tiny, F.lit(0.0)).otherwise(F.try_divide(F.col("_dy") - F.col("_dx"), F.col("_n")))
    d = d.withColumn("cos_plain", plain).withColumn("cos_mirror", flipped)
    d = d.withColumn("use_mirror", F.col("cos_mirror") > F.col("cos_plain")).withColumn("cosine_similarity", F.greatest("cos_plain", "cos_mirror"))
    sign = F.when(F.col("use_mirror"), F.lit(-1.0)).otherwise(F.lit(1.0))
    d = d.withColumn("u_best", F.transform("u_vec", lambda v, i: F.when(i % 2 == 0, v * sign).otherwise(v)))
    sq = F.zip_with("u_best", "r_vec", lambda a, b: (a - b) * (a - b))
    d = d.withColumn("_sq", sq)
    gaps = F.transform(F.sequence(F.lit(0), F.floor(F.size("_sq") / 2).cast("int") - 1), lambda k: F.sqrt(F.get("_sq", k * 2) + F.get("_sq", k * 2 + 1)))
    total = F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v)
    d = d.withColumn("mean_pose_distance", F.try_divide(total, F.floor(F.size("_sq") / 2)))
    d = d.withColumn("angle_error", P.angle_error(F.col("u_angles"), F.col("r_angles")))
    return d.drop("_dx", "_dy", "_n", "_sq", "cos_plain", "cos_mirror")


def final_score(d: DataFrame) -> DataFrame:
    part = lambda c, full: F.greatest(F.lit(0.0), 100.0 * (1.0 - F.col(c) / full))
    s = (0.35 * (F.col("cosine_similarity") + 1.0) * 50.0 + 0.25 * F.coalesce(part("dtw_distance", 0.8), F.lit(0.0))
         + 0.25 * part("angle_error", 90.0) + 0.15 * part("mean_pose_distance", 0.8))
    return d.withColumn("score", F.least(F.greatest(s, F.lit(0.0)), F.lit(100.0)))


def compare_to_references(users: DataFrame, refs: DataFrame, joints: int = 17) -> DataFrame:
    """Every user sequence against every angle of its technique, with all metrics and the score.

    ``users``: seq_id, technique, frames, n. ``refs``: technique, angle, frames, n. A sequence is resampled once per
    distinct reference length of its technique, not once per reference.
    """
    lengths = refs.select("technique", F.greatest(F.lit(4), F.col("n")).alias("target")).distinct()
    u = users.join(lengths, "technique")
    u = _resampled(u, ["seq_id", "technique", "target"], F.col("target"))
    r = refs.withColumn("target", F.greatest(F.lit(4), F.col("n")))
    r = _resampled(r, ["technique", "angle", "target"], F.col("target"))
    pairs = u.select("seq_id", "technique", "target", F.col("vec").alias("u_vec"), F.col("angles").alias("u_angles")).join(
        r.select("technique", "target", "angle", F.col("vec").alias("r_vec"), F.col("angles").alias("r_angles")), ["technique", "target"])
    dtw = P.dtw_udf(joints)
    return final_score(pair_parts(pairs).withColumn("dtw_distance", dtw("u_best", "r_vec"))).drop("u_vec", "r_vec", "u_best", "u_angles", "r_angles")


def compare_frames(users: DataFrame, refs: DataFrame) -> DataFrame:
    """Every user sequence against every angle of its technique frame by frame, over the frames that both have: similarity parts.

    Gaps are filled as in ``compare_to_references``, but nothing is resampled and nothing warped.
    """
    u, r = _resampled(users, ["seq_id", "technique"], F.col("n")), _resampled(refs, ["technique", "angle"], F.col("n"))
    pairs = u.select("seq_id", "technique", F.col("vec").alias("u_vec"), F.col("angles").alias("u_angles")).join(
        r.select("technique", "angle", F.col("vec").alias("r_vec"), F.col("angles").alias("r_angles")), "technique")
    both = F.least(F.size("u_vec"), F.size("r_vec"))
    return pair_parts(pairs.withColumns({c: F.slice(c, F.lit(1), both) for c in ("u_vec", "r_vec")}))


METRICS = ["score", "cosine_similarity", "dtw_distance", "angle_error", "mean_pose_distance", "use_mirror"]


def best_reference(compared: DataFrame) -> DataFrame:
    """The best angle per sequence; of equal scores the first angle."""
    best = F.min_by(F.struct("angle", *METRICS), F.struct(-F.col("score"), "angle")).alias("b")
    return compared.where("score IS NOT NULL").groupBy("seq_id", "technique").agg(best).select("seq_id", "technique", F.col("b.angle").alias("reference_angle"), *[F.col(f"b.{m}").alias(m) for m in METRICS])


def score_rows(users: DataFrame, best: DataFrame, thresholds: DataFrame | None = None, default: float = 60.0) -> DataFrame:
    """Rows for the metrics table: best angle, threshold of the label or the default, decision, feedback."""
    d = users.join(best, ["seq_id", "technique"])
    if thresholds is not None:
        d = d.join(thresholds, "technique", "left")
    limit = F.coalesce(F.col("threshold"), F.lit(default)) if thresholds is not None else F.lit(default)
    notes = P.feedback(F.col("technique"), F.get("frames", F.size("frames") - 1), F.col("score"))
    d = d.withColumn("score_threshold", limit).withColumn("_f", notes)
    return d.select("seq_id", "technique", "reference_angle", "score", "score_threshold", (F.col("score") >= F.col("score_threshold")).alias("is_correct"),
                    *METRICS[1:], F.get("_f", F.lit(0)).alias("feedback_1"), F.coalesce(F.get("_f", F.lit(1)), F.lit("")).alias("feedback_2"))


def gate_columns(d: DataFrame, min_score: float, low: float, high: float) -> DataFrame:
    """``passes_gate``: good enough or nothing to compare with; ``passes_band``: inside the seed band or no seeds.

    Input columns ``gate_score`` and ``seed_score``, NULL where there is no reference.
    """
    return (d.withColumn("passes_gate", F.col("gate_score").isNull() | (F.col("gate_score") >= min_score))
            .withColumn("passes_band", F.col("seed_score").isNull() | F.col("seed_score").between(low, high)))


def capture_gate(d: DataFrame, min_energy: float, min_closure: float) -> DataFrame:
    """First failing rule of each candidate that came out of its cooldown: energy, closure, score, band; or saved."""
    reason = (F.when(F.col("energy") < min_energy, "low_motion").when(F.col("closure") < min_closure, "no_return")
              .when(~F.col("passes_gate"), "low_score").when(~F.col("passes_band"), "outside_band").otherwise("saved"))
    return d.withColumn("decision", reason)


def best_candidate(d: DataFrame, keys: Sequence[str], min_energy: float, min_closure: float) -> DataFrame:
    """Best window per key among those that pass: match score (else motion) plus 15 x closure; first on ties."""
    base = F.coalesce("gate_score", "seed_score", F.least(F.lit(100.0), F.col("energy") * 100.0))
    ok = d.where((F.col("energy") >= min_energy) & (F.col("closure") >= min_closure) & F.col("passes_gate") & F.col("passes_band"))
    ok = ok.withColumn("selection_score", base + 15.0 * F.col("closure"))
    best = F.max_by(F.struct("seq_id", "selection_score"), F.struct(F.col("selection_score"), -F.col("seq_id"))).alias("b")
    return ok.groupBy(*keys).agg(best).select(*keys, "b.seq_id", "b.selection_score")


def closest_frame(frame: Column, ref_frames: Column) -> Column:
    """struct(dist, idx) of the first reference frame at the least distance."""
    return F.array_min(F.transform(ref_frames, lambda f, i: F.struct(P.frame_distance(frame, f).alias("dist"), i.alias("idx"))))


def top_errors(d: DataFrame, keys: Sequence[str], current: str, reference: str, technique: Column, n: int = 3, least: float = 0.12) -> DataFrame:
    """Worst joints of a frame against its reference frame, among those that matter for the technique."""
    arms, legs = [5, 6, 7, 8, 9, 10], [11, 12, 13, 14, 15, 16]
    arr = lambda v: F.array(*[F.lit(i) for i in v])
    focus = F.when(F.contains(technique, F.lit("kick")), arr(legs)).when(
        technique.isin("jab", "cross", "hook", "uppercut", "elbow_strike"), arr(arms)).otherwise(arr(arms + legs))
    rows = d.withColumn("joint", F.explode(focus)).withColumn("error", P.distance(F.get(current, F.col("joint")), F.get(reference, F.col("joint"))))
    w = Window.partitionBy(*keys).orderBy(F.col("error").desc(), "joint")
    return (rows.where("error IS NOT NULL").withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= n) & (F.col("error") >= least))
            .select(*keys, "rank", "joint", "error"))


def catalogue_score(pairs: DataFrame, joints: int = 17, dims: int = 3, dtw_weight: float = 0.7, length_weight: float = 0.3, stop: float | None = None) -> DataFrame:
    """Match of raw sequences (u_raw, r_raw flat with all coordinates; u_n, r_n): warping distance and length ratio.

    ``stop`` gives up on a pair whose running sum passes it.
    """
    dtw = P.dtw_udf(joints, dims, missing=float("inf"), stop=stop)
    d = pairs.withColumn("dtw", dtw("u_raw", "r_raw"))
    warped = F.coalesce(F.greatest(F.lit(0.0), 100.0 - F.col("dtw") * 50.0), F.lit(0.0))
    ratio = F.least("u_n", "r_n") / F.greatest("u_n", "r_n") * 100.0
    return d.withColumn("match_score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), warped * dtw_weight + ratio * length_weight)))


def view_transform(poses: DataFrame, keys: Sequence[str], canvas: int, margin: int = 40) -> DataFrame:
    """Scale and shift that fit all finite joints of a sequence into a square canvas."""
    p = poses.select(*keys, F.explode("kpts").alias("p")).where("p.x IS NOT NULL AND p.y IS NOT NULL")
    e = p.groupBy(*keys).agg(*[f(f"p.{c}").alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    drawable = float(max(canvas - 2 * margin, 1))
    span = lambda c: F.greatest(F.col(f"hi{c}") - F.col(f"lo{c}"), F.lit(1e-6))
    e = e.withColumn("scale", F.least(drawable / span("x"), drawable / span("y")))
    return e.select(*keys, "scale", (margin - F.col("lox") * F.col("scale")).alias("tx"), (margin - F.col("loy") * F.col("scale")).alias("ty"))
