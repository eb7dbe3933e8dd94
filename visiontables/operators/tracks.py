"""Analytics over track tables: history, counting, speed, repetitions, heat, queues, life cycle.

Rows carry a dense sighting number per track (``rank_rows`` makes one); windows run inside blocks of it with the few
rows of halo they reach back to, so that a very long track is many tasks and not one.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.functions import geometry as G
from visiontables.operators import match as M
from visiontables.operators import regions as R
from visiontables.operators.ordered import (
    BLOCK, block_window, blocks_with_halo, drop_halo, first_rows, lag_rows, rank_rows, running)
from visiontables.operators.scan import scan_sorted


def prev_position(tracks: DataFrame, rn: str = "frame", keys: Sequence[str] = ("track_id",)) -> DataFrame:
    return lag_rows(tracks, keys, rn, {"cx": "px", "cy": "py"})


def track_history(tracks: DataFrame, n: int = 30, rn: str = "frame", keys: Sequence[str] = ("track_id",)) -> DataFrame:
    """The last n centres of the track at each row, oldest first."""
    w = block_window(keys, rn).rowsBetween(-(n - 1), 0)
    cut = blocks_with_halo(tracks, rn, before=n - 1)
    return drop_halo(cut.withColumn("history", F.collect_list(F.struct("cx", "cy")).over(w)))


def speed_first(tracks: DataFrame, max_hist: int = 5, fps: float = 30, meters_per_pixel: float = 0.05, cap: int = 120,
                rn: str = "frame", frame: str = "frame", keys: Sequence[str] = ("track_id",)) -> DataFrame:
    """Speed in km/h fixed at the ``max_hist``-th sighting; two rows per track are enough."""
    at = lambda i, c: F.max(F.when(F.col(rn) == i, F.col(c)))
    ends = tracks.where(F.col(rn).isin(1, max_hist)).groupBy(*keys).agg(
        at(1, "cx").alias("x0"), at(1, "cy").alias("y0"), at(1, frame).alias("f0"), at(max_hist, "cx").alias("x1"),
        at(max_hist, "cy").alias("y1"), at(max_hist, frame).alias("f1"))
    dx, dy, dt = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), (F.col("f1") - F.col("f0")) / fps
    speed = F.least(F.sqrt(dx * dx + dy * dy) * meters_per_pixel / dt * 3.6, F.lit(float(cap))).cast("int")
    return ends.where(dt > 0).select(*keys, F.col("f1").alias("locked_frame"), speed.alias("speed"))


def rep_count(rows: DataFrame, angle: str, down: float, up: float, rn: str = "frame", key: str = "track_id") -> DataFrame:
    """Running repetitions per row: a repetition ends when the angle falls below ``down`` while the stage is up.

    Rows between the two thresholds change nothing, so the stage changes are numbered among themselves first.
    """
    kind = F.when(F.col(angle) < down, "down").when(F.col(angle) > up, "up")
    marked = rows.withColumn("_kind", kind)
    coarse = F.floor(F.col(rn) / BLOCK)
    events = rank_rows(marked.where("_kind IS NOT NULL").select(key, rn, "_kind"), [key], [F.col(rn)], coarse, "_ern")
    hits = lag_rows(events, [key], "_ern", {"_kind": "_was"}).where("_kind = 'down' AND _was = 'up'")
    flags = marked.join(hits.select(key, rn, F.lit(1).alias("_hit")), [key, rn], "left")
    out = running(flags, [key], [F.col(rn)], coarse, {
        "reps": ("sum", F.coalesce(F.col("_hit"), F.lit(0))),
        "_stage": ("max", F.when(F.col("_kind").isNotNull(), F.struct(F.col(rn), "_kind")))})
    return out.withColumn("stage", F.coalesce(F.col("_stage._kind"), F.lit("-"))).drop("_kind", "_hit", "_stage")


def crossing_events(tracks: DataFrame, region: list[tuple[float, float]], rn: str = "frame", key: str = "track_id",
                    carry: Sequence[str] = ("cls_name",)) -> DataFrame:
    """First crossing of a line, or first entry into a polygon after the first sighting, with its direction."""
    xs, ys = [p[0] for p in region], [p[1] for p in region]
    p, q = (F.col("px"), F.col("py")), (F.col("cx"), F.col("cy"))
    if len(region) == 2:
        hit = G.segments_intersect(p, q, *region)
        sideways = abs(xs[0] - xs[1]) < abs(ys[0] - ys[1])
    else:
        hit = G.point_in_polygon(*q, region)
        sideways = max(xs) - min(xs) < max(ys) - min(ys)
    forward = (q[0] > p[0]) if sideways else (q[1] > p[1])
    steps = prev_position(tracks, rn, (key,)).where("px IS NOT NULL")
    hits = steps.where(hit).withColumn("direction", F.when(forward, "IN").otherwise("OUT"))
    return first_rows(hits, [key], [F.col(rn)], [rn, "direction", *carry])


def io_counts(events: DataFrame, by: str = "cls_name") -> DataFrame:
    return events.groupBy(by).agg(F.count_if(F.col("direction") == "IN").alias("n_in"), F.count_if(F.col("direction") == "OUT").alias("n_out"))


def class_counts(tracks: DataFrame, update_every: int = 30, last: int = 45) -> dict[str, DataFrame]:
    """Chart data: counts per frame and class with their share, totals per frame, and the last points of the line."""
    per = tracks.groupBy("source_id", "frame", "cls_name").agg(F.count("*").alias("n"))
    total = per.groupBy("source_id", "frame").agg(F.sum("n").alias("total"))
    share = per.join(total, ["source_id", "frame"]).withColumn("pct", 100.0 * F.col("n") / F.col("total"))
    line = total.where(F.col("frame") % update_every == 0)
    newest = Window.partitionBy("source_id").orderBy(F.col("frame").desc())
    shown = line.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= last).drop("_rn")
    return {"share": share, "line": line, "shown": shown}


def region_counts(tracks: DataFrame, zones: R.Zones, carry: bool = False) -> DataFrame:
    """Objects per frame and zone with zeros; with ``carry`` an emptied zone keeps its last non-zero count."""
    x, y = F.col("cx"), F.col("cy")
    wide = tracks.groupBy("source_id", "frame").agg(*[
        F.count_if(G.point_in_polygon(x, y, pts)).alias(f"_z{i}") for i, pts in enumerate(zones.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("region"), F.col(f"_z{i}").alias("n")) for i, name in enumerate(zones)])
    out = wide.select("source_id", "frame", F.explode(rows).alias("r")).select("source_id", "frame", "r.*")
    if not carry:
        return out
    kept = running(out, ["source_id", "region"], [F.col("frame")], F.floor(F.col("frame") / BLOCK),
                   {"_last": ("max", F.when(F.col("n") > 0, F.struct("frame", "n")))})
    return kept.withColumn("n", F.coalesce(F.col("_last.n"), F.lit(0))).drop("_last")


def queue_count(tracks: DataFrame, polygon, rn: str = "frame") -> DataFrame:
    """Objects per frame inside the polygon that have been seen before."""
    queued = G.point_in_polygon(F.col("cx"), F.col("cy"), polygon) & (F.col(rn) > 1)
    return tracks.groupBy("source_id", "frame").agg(F.count_if(queued).alias("queued"))


def heat(boxes: DataFrame, key: str = "image_id", cell: int = 1) -> DataFrame:
    """Heat per cell: 2 for every whole pixel of a box within half its short side of its centre, scaled to 0..255.

    A difference table: of each pixel row of a disc only the two ends are rows, which are summed by cell before anything is
    shuffled, and a running sum along a row of cells gives the heat. A row of cells has at most as many entries as cells. The sums move to
    their key once, where rows of cells are added up and where ``normalize_heat`` finds the key's largest: a key has no more of them than cells.
    """
    b = B.Box(*[F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")])
    half = lambda v: F.floor(v / 2).cast("int")
    d = boxes.select(key, b.x1.alias("x0"), b.y1.alias("y0"), b.x2.alias("xe"), b.y2.alias("ye"),
                     half(F.least(b.x2 - b.x1, b.y2 - b.y1)).alias("rad"), half(b.x1 + b.x2).alias("mx"), half(b.y1 + b.y2).alias("my"))
    d = d.where("xe > x0 AND ye > y0")
    rows = d.withColumn("y", F.explode(F.sequence(F.greatest("y0", F.col("my") - F.col("rad")), F.least(F.col("ye") - 1, F.col("my") + F.col("rad")))))
    dy = F.col("y") - F.col("my")
    reach = F.floor(F.sqrt((F.col("rad") * F.col("rad") - dy * dy).cast("double"))).cast("int")
    runs = rows.select(key, F.floor(F.col("y") / cell).alias("gy"), F.greatest("x0", F.col("mx") - reach).alias("xa"), F.least(F.col("xe"), F.col("mx") + reach + 1).alias("xb")).where("xb > xa")
    end = lambda x, sign: F.struct(F.col(x).alias("x"), F.lit(sign).alias("sign"))
    ends = runs.select(key, "gy", F.explode(F.array(end("xa", 2), end("xb", -2))).alias("e")).select(key, "gy", F.floor(F.col("e.x") / cell).alias("gx"), "e.*")
    # a start fills the rest of its own cell and all of each later one, an end takes that back
    own = F.sum(F.col("sign") * ((F.col("gx") + 1) * cell - F.col("x"))).alias("own")
    marks = ends.groupBy(key, "gy", "gx").agg(own, F.sum(F.col("sign") * cell).alias("later")).repartition(key)
    along = Window.partitionBy(key, "gy").orderBy("gx")
    run = marks.withColumn("_sum", F.sum("later").over(along)).withColumn("_next", F.lead("gx").over(along))
    here = F.col("_sum") - F.col("later") + F.col("own")
    last = F.when(F.col("_sum") > 0, F.col("_next") - 1).otherwise(F.col("gx"))
    cells = run.select(key, "gy", F.col("gx").alias("_at"), F.explode(F.sequence("gx", last)).alias("gx"), here.alias("_here"), "_sum")
    filled = cells.select(key, "gx", "gy", F.when(F.col("gx") == F.col("_at"), F.col("_here")).otherwise(F.col("_sum")).cast("bigint").alias("heat"))
    return filled.where("heat > 0")


def normalize_heat(cells: DataFrame, key: str = "image_id", has_empty: bool = True) -> DataFrame:
    """Min-max to 0..255 per key; cells never touched count as zero."""
    whole = Window.partitionBy(key)
    ends = cells.withColumns({"_hi": F.max("heat").over(whole), "_lo": F.min("heat").over(whole)})
    low = F.lit(0) if has_empty else F.col("_lo")
    scaled = F.try_divide((F.col("heat") - low) * 255.0, F.col("_hi") - low)
    return ends.where(F.col(key).isNotNull()).withColumn("level", F.floor(F.coalesce(scaled, F.lit(0.0))).cast("int")).drop("_hi", "_lo")


def activity_score(rows: DataFrame, keys: Sequence[str], w: float, h: float) -> DataFrame:
    """2.5 wrist motion + 0.75 centre motion over the frame diagonal + 0.15 root of the area share, per track.

    Input rows: keys, frame, cx, cy, bw, bh, wrist_energy (of the window).
    """
    start = F.min_by(F.struct("cx", "cy"), "frame").alias("s")
    now = F.max_by(F.struct("bw", "bh"), "frame").alias("n")
    ends = rows.groupBy(*keys).agg(start, now, F.max("wrist_energy").alias("wrist"))
    dx, dy = F.col("cx") - F.col("s.cx"), F.col("cy") - F.col("s.cy")
    far = rows.join(ends, list(keys)).groupBy(*keys).agg(
        F.max(F.sqrt(dx * dx + dy * dy)).alias("far"), F.first("n").alias("n"), F.first("wrist").alias("wrist"))
    diag, frame_area = max((w * w + h * h) ** 0.5, 1.0), max(w * h, 1.0)
    area = F.greatest(F.col("n.bw") * F.col("n.bh"), F.lit(0.0)) / frame_area
    return far.select(*keys, (2.5 * F.coalesce("wrist", F.lit(0.0)) + 0.75 * F.col("far") / diag + 0.15 * F.sqrt(area)).alias("activity"))


def primary_track(scores: DataFrame, hold: int = 15, margin: float = 1.15, key: str = "source_id") -> DataFrame:
    """Followed track per frame: a challenger takes over only after the hold and when clearly better.

    ``scores``: key, frame, track_id, activity.
    """
    def step(state: dict, pdf: pd.DataFrame, _last: bool) -> pd.DataFrame:
        out = []
        for frame, rows in pdf.groupby("frame", sort=True):
            by_id = dict(zip(rows["track_id"], rows["activity"]))
            best = max(sorted(by_id), key=by_id.get)
            held = state.get("track")
            stays = held in by_id and (frame <= state.get("until", -1) or by_id[held] * margin >= by_id[best])
            if not stays:
                state["track"], state["until"] = best, frame + hold
            out.append((rows[key].iloc[0], frame, state["track"], by_id[state["track"]]))
        return pd.DataFrame(out, columns=[key, "frame", "track_id", "activity"])

    rows = scores.select(key, "frame", "track_id", "activity")
    return scan_sorted(rows, key, ["frame", "track_id"], dict, step, f"{key} bigint, frame bigint, track_id bigint, activity double", whole="frame")


def cooldown(rows: DataFrame, n: int, key: str = "track_id", frame: str = "frame") -> DataFrame:
    """Keep a capture only when at least n frames have passed since the last kept one."""
    def step(state: dict, pdf: pd.DataFrame, _last: bool) -> pd.DataFrame:
        keep = []
        for f in pdf[frame]:
            ok = n <= 0 or "last" not in state or f - state["last"] >= n
            keep.append(ok)
            if ok:
                state["last"] = f
        return pdf[keep]

    picked = rows.select(key, frame)
    return scan_sorted(picked, key, [frame], dict, step, f"{key} bigint, {frame} bigint")


def sliding_sequences(rows: DataFrame, n: int, skip: int = 1, overlap: float = 0.0, value: Column | None = None, rn: str = "frame",
                      keys: Sequence[str] = ("track_id",)) -> DataFrame:
    """Windows of the last n kept frames of a track at every scoring frame; ``classify`` paces the slower consumer."""
    kept = rows.where(F.col(rn) % skip == 0).withColumn("_k", F.col(rn) / skip)
    kept = kept.withColumn("_k", F.col("_k").cast("bigint"))
    w = block_window(keys, "_k").rowsBetween(-(n - 1), 0)
    item = value if value is not None else F.struct(rn, "cx", "cy")
    out = drop_halo(blocks_with_halo(kept, "_k", before=n - 1).withColumn("sequence", F.collect_list(item).over(w)))
    pace = max(1, round(n * skip * (1 - overlap)))
    return out.where(F.size("sequence") == n).withColumn("classify", F.col(rn) % pace == 0).drop("_k")


def moving_average_zero(rows: DataFrame, value: str, k: int = 9, rn: str = "frame", keys: Sequence[str] = ("track_id",), out: str = "smooth") -> DataFrame:
    """Mean over k rows centred here; what lies beyond the ends counts as zero."""
    half = k // 2
    w = block_window(keys, rn).rowsBetween(-half, half)
    cut = blocks_with_halo(rows, rn, before=half, after=half)
    return drop_halo(cut.withColumn(out, F.sum(value).over(w) / k))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    import math
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [v / sum(raw) for v in raw]


def gaussian_smooth(rows: DataFrame, value: str, keys: Sequence[str], rn: str, n: str, sigma: float = 3.0, out: str = "smooth") -> DataFrame:
    """Gaussian filter of a curve, mirrored at both ends; ``n`` holds the curve's length.

    Every row sends its weighted value to the rows it reaches, so no curve needs a single task.
    """
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    offsets = F.array(*[F.struct(F.lit(i - radius).alias("d"), F.lit(v).alias("w")) for i, v in enumerate(weights)])
    period = 2 * F.col(n)
    # target row t reads position t+d; mirrored positions fold back to this row
    spots = F.array(F.col(rn), 1 - F.col(rn), period + 1 - F.col(rn))
    sent = rows.select(*keys, n, F.col(value).alias("_v"), F.explode(F.array_distinct(spots)).alias("_at"))
    sent = sent.select(*keys, n, "_v", "_at", F.explode(offsets).alias("_o"))
    hits = sent.select(*keys, n, (F.col("_at") - F.col("_o.d")).alias(rn), (F.col("_v") * F.col("_o.w")).alias("_c")).where((F.col(rn) >= 1) & (F.col(rn) <= F.col(n)))
    return hits.groupBy(*keys, rn).agg(F.sum("_c").alias(out))


def counter_rates(rows: DataFrame, keys: Sequence[str], rn: str, ts: str, counters: Sequence[str]) -> DataFrame:
    """MB/s of cumulative byte counters; at least 0.1 s between readings, never negative."""
    prev = lag_rows(rows, keys, rn, {ts: "_ts", **{c: f"_p_{c}" for c in counters}}).where("_ts IS NOT NULL")
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_ts").cast("timestamp"))) / 1e6
    elapsed = F.greatest(seconds, F.lit(0.1))
    return prev.select(*keys, rn, *[F.round(F.greatest(F.lit(0.0), (F.col(c) - F.col(f"_p_{c}")) / (1 << 20) / elapsed), 3).alias(f"{c}_mbs") for c in counters])


def run_length_encode(mask: Column) -> Column:
    """Run lengths of a 0/1 array, beginning with the background run (0 when the first pixel is set)."""
    n = F.size(mask)
    turns = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(mask, i) != F.get(mask, i - 1))
    ends = F.concat(turns, F.array(n))
    runs = F.transform(ends, lambda e, i: e - F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0)))
    return F.when(F.get(mask, F.lit(0)) == 1, F.concat(F.array(F.lit(0)), runs)).otherwise(runs)


def mask_runs(df: DataFrame, keys: Sequence[str], counts: str) -> DataFrame:
    """Foreground runs (start, stop) of run-length masks, stop exclusive."""
    ends = F.transform(F.col(counts), lambda _, i: F.aggregate(F.slice(F.col(counts), 1, i + 1), F.lit(0).cast("bigint"), lambda a, v: a + v))
    runs = df.select(*keys, F.posexplode(F.arrays_zip(ends.alias("e"), F.col(counts).alias("c"))).alias("i", "z"))
    return runs.where("i % 2 = 1").select(*keys, (F.col("z.e") - F.col("z.c")).alias("start"), F.col("z.e").alias("stop")).where("stop > start")


def mask_iou(a: DataFrame, b: DataFrame, on: Sequence[str], threshold: float | None = None, size: int = 1024, eps: float = 1e-7) -> DataFrame:
    """IoU of run-length masks of the same image, all that overlap, or with ``threshold`` those that reach it.

    Runs meet in stretches of ``size`` pixels, about a row or two of an image, so a run hardly meets one that it doesn't overlap; a long
    run is copied once a stretch. Two masks share at most the smaller one's pixels of the larger one's, so a pair whose
    areas alone rule out the threshold is left out before its runs are added up. Runs are far more than their size estimate
    knows, so none are broadcast.
    """
    def cells(df, p):
        d = df.select(*on, F.col(f"{p}_id"), F.col("start").alias(f"{p}_s"), F.col("stop").alias(f"{p}_e"))
        area = d.groupBy(*on, f"{p}_id").agg(F.sum(F.col(f"{p}_e") - F.col(f"{p}_s")).alias(f"{p}_area"))
        return d.join(area.hint("merge"), [*on, f"{p}_id"]).withColumn("_c", F.explode(F.sequence(F.floor(F.col(f"{p}_s") / size), F.floor((F.col(f"{p}_e") - 1) / size))))

    lo, hi = F.greatest("a_s", "b_s", F.col("_c") * size), F.least("a_e", "b_e", (F.col("_c") + 1) * size)
    met = cells(a, "a").join(cells(b, "b").hint("merge"), [*on, "_c"]).where(hi > lo)
    if threshold is not None:
        met = met.where(F.least("a_area", "b_area") >= threshold * F.greatest("a_area", "b_area"))
    out = met.groupBy(*on, "a_id", "b_id").agg(F.sum(hi - lo).alias("inter"), F.max("a_area").alias("a_area"), F.max("b_area").alias("b_area"))
    out = out.withColumn("iou", F.col("inter") / (F.col("a_area") + F.col("b_area") - F.col("inter") + eps))
    return out if threshold is None else out.where(F.col("iou") >= threshold)


# --- global order ------------------------------------------------------------------------------------------------

def aspect_batches(images: DataFrame, batch: int, imgsz: int, stride: int, pad: float = 0.5) -> DataFrame:
    """Batch numbers by rising height/width and the padded shape of each batch."""
    ratio = F.col("h") / F.col("w")
    d = rank_rows(images.withColumn("ar", ratio), [], [F.col("ar"), F.col("image_id")], F.floor(ratio * 1024), "_rn")
    d = d.withColumn("batch", F.floor((F.col("_rn") - 1) / batch).cast("bigint"))
    ends = d.groupBy("batch").agg(F.min("ar").alias("lo"), F.max("ar").alias("hi"))
    rh = F.when(F.col("hi") < 1, F.col("hi")).otherwise(F.lit(1.0))
    rw = F.when(F.col("lo") > 1, 1 / F.col("lo")).otherwise(F.lit(1.0))
    side = lambda r: (F.ceil(r * imgsz / stride + pad) * stride).cast("bigint")
    shapes = ends.select("batch", side(rh).alias("batch_h"), side(rw).alias("batch_w"))
    return d.join(shapes, "batch").select("image_id", "batch", "batch_h", "batch_w")


def contiguous_shards(rows: DataFrame, order: list[Column], coarse: Column, shards: int, batch: int, total: int | None = None) -> DataFrame:
    """Whole batches dealt to shards in order; the first shards take the remainder."""
    ranked = rank_rows(rows, [], order, coarse, "_rn")
    ranked = ranked.withColumn("_n", F.lit(total) if total is not None else rows.agg(F.count("*")).scalar())
    n = F.col("_n")
    size = F.when(F.lit(batch) >= n, F.lit(1)).otherwise(F.lit(batch))
    batches = F.ceil(n / size)
    base, rest = F.floor(batches / shards), batches % shards
    b = F.floor((F.col("_rn") - 1) / size)
    shard = F.when(b < (base + 1) * rest, F.floor(b / (base + 1))).otherwise(rest + F.floor(F.try_divide(b - (base + 1) * rest, base)))
    return ranked.withColumn("shard", shard.cast("bigint")).drop("_rn", "_n")


# --- life cycle --------------------------------------------------------------------------------------------------

def track_life(tracks: DataFrame, keys: Sequence[str] = ("source_id", "track_id"), frame: str = "frame") -> DataFrame:
    """First and last frame, sightings and age since the last frame of the source."""
    per = tracks.groupBy(*keys).agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.count("*").alias("length"))
    last = tracks.groupBy(keys[0]).agg(F.max(frame).alias("_last"))
    return per.join(last, keys[0]).withColumn("lost_age", F.col("_last") - F.col("end_frame")).drop("_last")


def duplicate_tracks(tracked: DataFrame, lost: DataFrame, limit: float = 0.15) -> DataFrame:
    """Tracks to remove: of two that overlap almost fully the longer-lived stays; on a tie the tracked one goes.

    Both sides: image_id (source and frame), track_id, life, x1..y2.
    """
    p = M.overlap_join(tracked, lost, 1 - limit).where(1 - F.col("overlap") < limit)
    longer = F.col("a_life") > F.col("b_life")
    return p.select("image_id", F.when(longer, F.col("b_track_id")).otherwise(F.col("a_track_id")).alias("track_id"),
                    F.when(longer, "lost").otherwise("tracked").alias("side")).distinct()


def join_tracks(a: DataFrame, b: DataFrame, key: str = "track_id") -> DataFrame:
    """Union by id; the first table's row wins."""
    return a.unionByName(b.join(a.select(key), key, "left_anti").dropDuplicates([key]))


def sub_tracks(a: DataFrame, b: DataFrame, key: str = "track_id") -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def alarm_once(dets: DataFrame, n: int, keys: Sequence[str] = ("source_id",), frame: str = "frame") -> DataFrame:
    """First frame of each source that holds at least n objects."""
    counts = dets.groupBy(*keys, frame).agg(F.count("*").alias("n"))
    return first_rows(counts.where(F.col("n") >= n), list(keys), [F.col(frame)], [frame, "n"])


def latest_per_source(rows: DataFrame, key: str = "source_id", order: str = "frame") -> DataFrame:
    """All rows of each source's newest frame."""
    newest = rows.groupBy(key).agg(F.max(order).alias(order))
    return rows.join(newest, [key, order], "left_semi")


