import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.functions import geometry as G
from visiontables.functions import pose as P
from visiontables.functions import text as T
from visiontables.functions.assignment import assign
from visiontables.operators import annotations as A
from visiontables.operators import catalog as C
from visiontables.operators import convert as CV
from visiontables.operators import evaluate as E
from visiontables.operators import match as M
from visiontables.operators import ordered as O
from visiontables.operators import regions as R
from visiontables.operators import tracks as TR

BOX = "image_id bigint, {id} bigint, cls int, conf double, x1 double, y1 double, x2 double, y2 double"


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def boxes(spark, rows, name):
    return spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], BOX.format(id=name))


def random_boxes(n, seed, images=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.randint(-40, 600), rnd.randint(-40, 400)
        out.append((rnd.randrange(images), i, rnd.randrange(2), round(rnd.random(), 6), float(x), float(y), float(x + rnd.randint(5, 300)), float(y + rnd.randint(5, 200))))
    return out


def iou(a, b, eps=1e-7):
    w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - inter + eps)


def test_assignment_is_cheapest():
    rnd = np.random.default_rng(3)
    for n, m in ((1, 4), (4, 4), (5, 3), (3, 5)):
        for _ in range(20):
            c, limit = rnd.random((n, m)), 0.6
            got = assign(c, limit)
            assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
            value = sum(c[i, j] - limit for i, j in got)
            best = 0.0
            for k in range(1, min(n, m) + 1):
                for rows in itertools.combinations(range(n), k):
                    for cols in itertools.permutations(range(m), k):
                        best = min(best, sum(c[i, j] - limit for i, j in zip(rows, cols)))
            assert value == pytest.approx(best)


def test_overlap_pairs_once_each(spark):
    a, b = random_boxes(60, 1), random_boxes(60, 2)
    want = {(p[1], q[1]) for p in a for q in b if p[0] == q[0] and iou(p, q, 0) > 0}
    got = M.overlap_pairs(boxes(spark, a, "a_id"), boxes(spark, b, "b_id"), size=64).select("a_a_id", "b_b_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_two_matching_rules_differ(spark):
    # detection 1 prefers truth 10; detection 2, less sure, overlaps it better
    d = boxes(spark, [(0, 1, 0, 0.9, 0, 0, 10, 10), (0, 2, 0, 0.8, 0, 0, 10, 9.5)], "det_id")
    g = boxes(spark, [(0, 10, 0, 1.0, 0, 0, 10, 9.4)], "gt_id")
    ap = M.match_for_ap(M.match_candidates(d, g), [0.5]).collect()
    assert [(r.det_id, r.gt_id) for r in ap] == [(1, 10)]
    conf = M.match_for_confusion(d, g).collect()
    assert [(r.det_id, r.gt_id) for r in conf] == [(2, 10)]


def test_suppression_against_loops(spark):
    rows = random_boxes(150, 5, images=2)
    df = boxes(spark, rows, "det_id")
    ordered = sorted(rows, key=lambda r: -r[3])
    kept = []
    for r in ordered:
        if all(k[0] != r[0] or k[2] != r[2] or iou(k, r, 0) <= 0.3 for k in kept):
            kept.append(r)
    greedy = M.nms_greedy(df, 0.3)
    assert {r.det_id for r in greedy.collect()} == {r[1] for r in kept}
    assert M.nms_greedy(greedy.select(df.columns), 0.3).count() == len(kept)
    fast = {r[1] for i, r in enumerate(ordered) if not any(k[0] == r[0] and k[2] == r[2] and iou(k, r) >= 0.3 for k in ordered[:i])}
    assert {r.det_id for r in M.suppress_fast(df, 0.3, size=50).collect()} == fast
    capped = M.nms_greedy(df, 0.3, max_det=3).groupBy("image_id").count().collect()
    assert all(r["count"] == 3 for r in capped)


def test_rotated_suppression_reach_is_exact(spark):
    rnd = random.Random(9)
    rows = [(0, i, 0, round(rnd.random(), 6), rnd.uniform(0, 300), rnd.uniform(0, 300), rnd.uniform(5, 120), rnd.uniform(5, 120), rnd.uniform(-1.5, 1.5)) for i in range(80)]
    df = spark.createDataFrame(rows, "image_id bigint, det_id bigint, cls int, conf double, cx double, cy double, w double, h double, theta double")
    a, b = M.prefixed(df, "a_"), M.prefixed(df, "b_")
    all_pairs = a.crossJoin(b).where((F.col("b_conf") > F.col("a_conf")) & (B.probiou(B.obb("a_"), B.obb("b_")) >= 0.2))
    lost = {r.a_det_id for r in all_pairs.collect()}
    assert {r.det_id for r in M.suppress_rotated(df, 0.2).collect()} == {r[1] for r in rows} - lost


def test_optimal_match_one_to_one(spark):
    pairs = spark.createDataFrame([(0, 1, 5, 0.1), (0, 1, 6, 0.2), (0, 2, 5, 0.15), (0, 3, 9, 0.95)], "g bigint, r bigint, c bigint, cost double")
    got = M.optimal_match(pairs, "g", "r", "c", "cost", 0.7).collect()
    assert {(r.r, r.c) for r in got} == {(1, 6), (2, 5)}


def test_iou_properties(spark):
    rows = random_boxes(40, 8, images=1)
    df = boxes(spark, rows, "det_id")
    p = M.overlap_pairs(df, df)
    bad = p.where((B.iou(B.box("a_"), B.box("b_")) < 0) | (B.iou(B.box("a_"), B.box("b_")) > 1) | (
        F.abs(B.iou(B.box("a_"), B.box("b_")) - B.iou(B.box("b_"), B.box("a_"))) > 1e-12))
    assert bad.count() == 0


def test_ordered_helpers_with_tiny_blocks(spark):
    rnd = random.Random(4)
    rows = [(k, i, float(rnd.randint(0, 9))) for k in ("a", "b") for i in rnd.sample(range(400), 90)]
    df = spark.createDataFrame(rows, "k string, t bigint, v double")
    w = Window.partitionBy("k").orderBy("t")
    ranked = O.rank_rows(df, ["k"], [F.col("t")], F.floor(F.col("t") / 7))
    assert ranked.withColumn("want", F.row_number().over(w)).where("rn <> want").count() == 0
    lagged = O.lag_rows(ranked, ["k"], "rn", {"v": "p"}, block=4).withColumn("want", F.lag("v").over(w))
    assert lagged.count() == 180 and lagged.where("NOT (p <=> want)").count() == 0
    run = O.running(df, ["k"], [F.col("t")], F.floor(F.col("t") / 7), {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    full = w.rowsBetween(Window.unboundedPreceding, 0)
    assert run.withColumn("ws", F.sum("v").over(full)).withColumn("wm", F.max("v").over(full)).where("s <> ws OR m <> wm").count() == 0
    cut = O.blocks_with_halo(ranked, "rn", before=3, after=2, block=5)
    got = O.drop_halo(cut.withColumn("s", F.sum("v").over(O.block_window(["k"], "rn").rowsBetween(-3, 2))))
    assert got.count() == 180 and got.withColumn("want", F.sum("v").over(w.rowsBetween(-3, 2))).where("s <> want").count() == 0


def test_sorted_rank_with_ties(spark):
    d = spark.range(500).select((F.col("id") * 7 % 13).alias("v"), "id")
    r = O.sorted_rank(d, [F.col("v"), F.col("id")])
    assert r.withColumn("want", F.row_number().over(Window.orderBy("v", "id"))).where("rn <> want").count() == 0 and r.count() == 500


def test_grid_interpolation_matches_numpy(spark):
    rnd = np.random.default_rng(0)
    x = np.sort(rnd.integers(1, 99, 40) / 100)
    y = rnd.random(40)
    df = spark.createDataFrame([("a", float(p), float(q), i) for i, (p, q) in enumerate(zip(x, y))], "k string, x double, y double, i bigint")
    got = [r.y for r in O.interpolate_on_grid(df, ["k"], F.col("x"), F.col("y"), F.col("i"), 101, left=7.0).orderBy("g").collect()]
    assert np.allclose(got, np.interp(np.linspace(0, 1, 101), x, y, left=7.0))


def test_average_precision_by_hand(spark):
    tp = spark.createDataFrame([(1, 0, 0.9, [1]), (2, 0, 0.8, [0]), (3, 0, 0.7, [1])], "det_id bigint, cls int, conf double, tp array<int>")
    totals = spark.createDataFrame([(0, 2)], "cls int, n_l bigint")
    env = E.precision_envelope(E.precision_recall(tp, totals, 1), 1)
    ap = E.average_precision(env).first().ap
    rec, pre = [0, .5, .5, 1, 1], [1, 1, 2 / 3, 2 / 3, 0]
    assert ap == pytest.approx(np.trapezoid(np.interp(np.linspace(0, 1, 101), rec, pre), np.linspace(0, 1, 101)))
    assert E.continuous_ap(env).first().ap == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_fallback_threshold(spark):
    df = spark.createDataFrame([("jab", 70.0, True), ("jab", 30.0, False), ("kick", 50.0, True)], "t string, s double, ok boolean")
    out = {r.t: r for r in E.calibrate_threshold(df, "t", "s", "ok", 62.0).collect()}
    assert (out["jab"].threshold, out["jab"].status) == (70.0, "calibrated")
    assert (out["kick"].threshold, out["kick"].reason) == (62.0, "insufficient_samples")


def test_confusion_names_and_conf():
    assert E.clean_names(["a b", "A_b", "a-b", "x"]) == ["a_b", "A_b_1", "a_b_2", "x"]
    assert E.confusion_conf(0.001) == E.confusion_conf(None) == E.confusion_conf(0.01, True) == 0.25 and E.confusion_conf(0.01) == 0.01


def test_hull_and_clip(spark):
    pts = [(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (1, 3), (2, 0)]
    arr = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
    hull = one(spark, G.convex_hull(arr))
    assert {(p.x, p.y) for p in hull} == {(0, 0), (4, 0), (4, 4), (0, 4)}
    tri = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (0, 4))])
    assert one(spark, G.quad_iof(tri, B.lit_box(0, 0, 2, 2))) == pytest.approx(0.5)


def test_fitted_obb_turns_back(spark):
    for theta in (-0.7, 0.0, 0.5, 1.5, 2.3):
        d = spark.createDataFrame([(10.0, 20.0, 8.0, 3.0, theta)], "cx double, cy double, w double, h double, theta double")
        o = B.with_fitted_obb(d.select(G.obb_points(B.obb()).alias("p")), "p").first().obb
        assert (o.cx, o.cy, o.w, o.h) == pytest.approx((10, 20, 8, 3))
        assert np.cos(2 * (o.theta - theta)) == pytest.approx(1) and -np.pi / 4 <= o.theta < 3 * np.pi / 4


def test_resample_segment_keeps_vertices(spark):
    sq = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    out = one(spark, G.resample_segment(sq, 10))
    s = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float)
    x = np.linspace(0, 4, 5)
    x = np.insert(x, np.searchsorted(x, np.arange(5)), np.arange(5))
    want = np.stack([np.interp(x, np.arange(5), s[:, i]) for i in range(2)], 1)
    assert np.allclose([(p.x, p.y) for p in out], want)


def test_dtw_batch_matches_loops():
    rnd = np.random.default_rng(1)
    a, b = rnd.random((3, 5, 4, 2)), rnd.random((3, 7, 4, 2))
    a[0, 1, 2] = np.nan
    a[1, 0] = np.nan
    got = P.dtw_batch(a, b, 1.0, None)
    for n in range(3):
        dp = np.full((6, 8), np.inf)
        dp[0, 0] = 0
        for i, j in itertools.product(range(1, 6), range(1, 8)):
            ok = np.isfinite(a[n, i - 1]).all(1) & np.isfinite(b[n, j - 1]).all(1)
            cost = np.linalg.norm(a[n, i - 1][ok] - b[n, j - 1][ok], axis=1).mean() if ok.any() else 1.0
            dp[i, j] = cost + min(dp[i - 1, j], dp[i, j - 1], dp[i - 1, j - 1])
        assert got[n] == pytest.approx(dp[5, 7] / 7)
    assert P.dtw_batch(a[2:], a[2:], 1.0, None)[0] == 0
    assert np.isinf(P.dtw_batch(a[2:] * 1e4, b[2:], 1.0, 500.0)[0])


def test_keywords(spark):
    rows = [("Learn the JAB today", "", "yes", r"\bjab\b"), ("jab time-lapse", "", "no", r"time[ -]?lapse"), ("football drills", "", "no", r"\bfootball\b(?!.*box)"),
            ("football and boxing", "", "yes", r"\bbox(ing|er)?\b"), ("cats", "", "no", None), ("my video", "MMA", "yes", r"\bmma\b"), ("slow motion power punch", "", "yes", r"\bpunch(ing|er)?\b")]
    d = spark.createDataFrame(rows, "title string, tags string, want string, pattern string")
    for r in d.withColumn("c", T.classify_keywords(F.col("title"), F.col("tags"))).collect():
        assert (r.c.decision, r.c.pattern) == (r.want, r.pattern)


def test_text_rules(spark):
    assert one(spark, T.normalize_key(F.lit("  FrontKick-left_side "))) == "front_kick_left_side"
    assert one(spark, T.normalize_key(F.lit("Front_Kick-x"), camel=False, underscore=False)) == "front_kick_x"
    assert one(spark, T.infer_angle(F.lit("Jab_left.mp4"))) == "side_left" and one(spark, T.infer_angle(F.lit("leftover.mp4"))) is None
    assert one(spark, T.iso_duration_seconds(F.lit("PT1H2M3.9S"))) == 3723 and one(spark, T.iso_duration_seconds(F.lit("P1D"))) == 0
    assert one(spark, T.video_id(F.lit("https://youtu.be/abc/"))) == "abc"
    assert one(spark, T.compact_text(F.lit(" a  b\n c "), 4)) == "a b…"
    assert one(spark, F.array_join(T.split_urls(F.lit("a, b;a|c\n"), F.lit("c")), " ")) == "a b c"


def test_merge_plan_update(spark):
    schema = "technique string, angle string, pos bigint, notes string"
    old = spark.createDataFrame([("jab", "front", 1, "o1"), ("hook", "side", 2, "o2"), ("Jab", "front", 3, "o3")], schema)
    new = spark.createDataFrame([("jab", "front", 1, "n1"), ("kick", "side", 2, "n2"), ("kick", "side", 3, "n3")], schema)
    out = [(r.technique, r.notes) for r in C.merge_plan(old, new).orderBy("ord").collect()]
    assert out == [("jab", "n1"), ("hook", "o2"), ("jab", "n1"), ("kick", "n3")]
    p = C.merge_preview(old, new).first()
    assert (p.updated, p.added) == (1, 2)


def test_unique_names(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a_2"), (5, "a")], "id bigint, base string")
    names = [r["name"] for r in C.unique_name(d, "base", [F.col("id")], F.floor(F.col("id") / 2)).orderBy("id").collect()]
    assert names[:1] == ["a"] and len(set(names)) == 5


def test_shards_cover_all(spark):
    d = spark.range(37).withColumnRenamed("id", "image_id")
    out = TR.contiguous_shards(d, [F.col("image_id")], F.floor(F.col("image_id") / 5), 4, 5).collect()
    # 8 batches over 4 shards
    assert [r.shard for r in sorted(out, key=lambda r: r.image_id)] == [i // 10 for i in range(37)]
    small = TR.contiguous_shards(d.limit(3), [F.col("image_id")], F.floor(F.col("image_id") / 5), 4, 8).collect()
    assert sorted(r.shard for r in small) == [0, 1, 2]


def test_run_length_masks(spark):
    mask = F.array(*[F.lit(v) for v in (1, 1, 0, 0, 1)])
    assert one(spark, TR.run_length_encode(mask)) == [0, 2, 2, 1]
    d = spark.createDataFrame([(1, [0, 2, 2, 1])], "id bigint, c array<int>")
    assert [(r.start, r.stop) for r in TR.mask_runs(d, ["id"], "c").orderBy("start").collect()] == [(0, 2), (4, 5)]


def test_primary_track_holds(spark):
    rows = [(1, f, t, a) for f, a7, a8 in ((1, 5, 1), (2, 5, 9), (3, 5, 9), (4, 5, 5.2), (5, 5, 9)) for t, a in ((7, float(a7)), (8, float(a8)))]
    d = spark.createDataFrame(rows, "source_id bigint, frame bigint, track_id bigint, activity double")
    out = [r.track_id for r in TR.primary_track(d, hold=3, margin=1.15).orderBy("frame").collect()]
    assert out == [7, 7, 7, 7, 8]


def test_region_join_with_small_cells(spark):
    zones = {"a": [(0, 0), (10, 0), (10, 10), (0, 10)], "b": [(5, 5), (30, 5), (30, 30)]}
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (10, 5), (20, 10), (9, 6), (29, 29.5)])], "id bigint, cx double, cy double")
    r = R.regions_table(spark, zones)
    got = {(x.id, x.name) for x in R.region_join(pts, r, size=4).collect()}
    assert got == {(0, "a"), (2, "b"), (3, "a"), (3, "b")}
    assert {(x.id, x.name) for x in R.region_join(pts, r, edge_inside=True, size=4).collect()} == got | {(1, "a"), (1, "b")}


def test_joined_outline_covers_both(spark):
    a, b = [0, 0, 2, 0, 2, 2, 0, 2], [4, 0, 6, 0, 6, 2, 4, 2]
    d = spark.createDataFrame([([[float(v) for v in a], [float(v) for v in b]],)], "p array<array<double>>")
    out = np.array(d.select(CV.merge_segments("p").alias("o")).first().o).reshape(-1, 2)
    assert {tuple(p) for p in out} == {(x, y) for x in (0, 2, 4, 6) for y in (0, 2)} and len(out) == 10


def test_splits_are_stable(spark):
    d = spark.createDataFrame([(f"/d/images/{i}.jpg", i % 3) for i in range(300)], "path string, c int")
    a = {r.path: r.split for r in A.autosplit(d).collect()}
    b = {r.path: r.split for r in A.autosplit(d.repartition(7)).collect()}
    assert a == b and 240 < sum(v == "train" for v in a.values()) < 295
    per = {(r.c, r.split): r["count"] for r in A.stratified_split(d, "c", 0.8).groupBy("c", "split").count().collect()}
    assert per == {(c, s): n for c in range(3) for s, n in (("train", 80), ("val", 20))}
