"""Steps whose work must grow no faster than their input: what they shuffle and how often they copy or call."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.functions import geometry as G
from visiontables.functions import pose as P
from visiontables.operators import match as M
from visiontables.operators import tracks as T
from visiontables.streaming import folds
from visiontables.streaming import streams as ST
from visiontables.streaming.tracker import Tracker

OBB = "image_id bigint, det_id bigint, cls int, conf double, cx double, cy double, w double, h double, theta double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_suppression_copies_only_crowds(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.choice([0, 1, None]), round(rng.random(), 2), rng.uniform(0, 400), rng.uniform(0, 400), rng.uniform(5, 120),
             rng.uniform(5, 120), rng.uniform(-1.5, 1.5)) for i in range(400)]
    df = spark.createDataFrame(rows, OBB)
    calm = M.suppress_rotated(df, 0.3)
    assert "Generate" not in plan(calm) and calm.columns == df.columns
    kept = sorted(r["det_id"] for r in calm.collect())
    square = df.selectExpr("image_id", "det_id", "cls", "conf", "cx AS x1", "cy AS y1", "cx + w AS x2", "cy + h AS y2")
    plain = sorted(r["det_id"] for r in M.suppress_fast(square, 0.3).collect())
    assert {r[1] for r in rows if r[0] is None or r[2] is None} < set(kept) and len(kept) < 400 and len(plain) < 400
    for fold in (0, 40):  # all groups, or the largest, are crowds and meet in cells
        cells = M.suppress_fast(square, 0.3, size=50, fold=fold)
        assert "Generate" in plan(cells) and cells.columns == square.columns and sorted(r["det_id"] for r in cells.collect()) == plain


def test_uncrowded_suppression_is_one_shuffle(spark):
    df = spark.range(500).selectExpr("id div 10 AS image_id", "id AS det_id", "CAST(id % 2 AS INT) AS cls", "(id * 7 % 500) / 500D AS conf", "id % 7 * 9D AS cx",
                                     "id % 5 * 9D AS cy", "30D AS w", "20D AS h", "id / 300D AS theta")
    out = M.suppress_rotated(df, 0.3).select("det_id")
    out.collect()
    text = plan(out).split("Initial Plan")[0]
    assert "ReusedExchange" in text


def test_quads_are_cut_without_folds(spark):
    rng = random.Random(8)
    point = lambda: (rng.choice([0.0, 100.0, rng.uniform(-50, 300)]), rng.choice([50.0, 200.0, rng.uniform(-50, 300)]))
    rows = [(k, [point() for _ in range(3 if k % 10 == 0 else 5 if k % 10 == 1 else 4)]) for k in range(300)]  # flat sides, self-crossing ones, corners on borders
    rows += [(300, [(10.0, 10.0), (90.0, 10.0 + 1e-12), (90.0, 60.0), (10.0, 60.0)]), (301, [(0.0, 0.0), (5.0, None), (5.0, 5.0), (0.0, 5.0)])]
    df = spark.createDataFrame(rows, "k int, pts array<struct<x:double,y:double>>")
    rect = B.lit_box(0, 50, 100, 200)
    cut = G.polygon_area(G.clip_polygon(F.col("pts"), rect)) / F.greatest(G.polygon_area(F.col("pts")), F.lit(1e-6))
    got = df.select("k", G.quad_iof(F.col("pts"), rect).alias("a"), cut.alias("b"), G.quad_area(F.col("pts")).alias("area"), G.polygon_area(F.col("pts")).alias("fold"),
                    F.array(*G.quad_box(F.col("pts"))).alias("box"), F.array(*[G.points_box(F.col("pts"))[c] for c in ("x1", "y1", "x2", "y2")]).alias("held")).collect()
    assert all(r["area"] == r["fold"] and r["box"] == r["held"] for r in got) and got.pop()["a"] is None  # an unknown corner
    assert len(got) == 301 and all(abs(r["a"] - r["b"]) < (1e-9 * max(1, r["b"]) if r["area"] else 1e-5) for r in got) and sum(0 < r["a"] < 1 for r in got) > 100


def test_a_frame_is_corrected_in_one_step(monkeypatch):
    # 40 walkers over 30 frames: array steps a frame, not one for each of their 40 tracks
    calls = []
    solve = np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda *a: calls.append(1) or solve(*a))
    rows = [(0, f, f * 40 + k, k % 3, 0.9 if (f + k) % 5 else 0.7, 60.0 * k + 2 * f, 10.0, 60.0 * k + 2 * f + 50, 90.0 + f % 3) for f in range(30) for k in range(40)]
    out = Tracker().step({}, pd.DataFrame(rows, columns=["source_id", "frame", "det_id", "cls", "conf", "x1", "y1", "x2", "y2"]))
    assert out.groupby("track_id").size().max() == 30 and out.groupby(out["det_id"] % 40)["track_id"].nunique().max() == 1
    assert len(calls) <= 3 * 30


def test_keys_of_a_stream_share_calls_and_states(spark, tmp_path):
    rows = [(i % 300 if i % 300 else None, i, float(i * 37 % 640), float(i * 11 % 480)) for i in range(3000)]
    schema = "track_id long, frame long, cx double, cy double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    step, out = folds.crossing([(320.0, -50.0), (320.0, 480.0)])
    s = ST.source_stream(spark, f"{tmp_path}/in", spark.createDataFrame(rows, schema).schema)
    q = (ST.fold_stream(s, ["track_id"], ["frame"], step, out, groups=4).writeStream.format("parquet").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 4  # 300 keys, 4 states
    pdf = pd.DataFrame(rows, columns=["track_id", "frame", "cx", "cy"])
    want = [(None if k != k else int(k), r.frame, r.direction) for k, own in pdf.groupby("track_id", dropna=False) for r in step({}, own).itertuples()]
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) > 200 and sorted(got, key=str) == sorted(want, key=str)


def test_matching_copies_only_where_an_image_is_crowded(spark, monkeypatch):
    rng = random.Random(12)
    box = lambda k: (k, rng.choice([1, 2, 3, None]), rng.choice([0, 1]), rng.random(), *(lambda x, y: (x, y, x + rng.uniform(30, 200), y + rng.uniform(30, 200)))(rng.uniform(-50, 300), rng.uniform(-50, 300)))
    d = spark.createDataFrame([box(k) for k in range(200)], "det_id long, image_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    g = spark.createDataFrame([box(k) for k in range(150)], d.withColumnRenamed("det_id", "gt_id").schema)
    calm = M.match_candidates(d, g, 0.3)
    assert "Generate" not in plan(calm)
    want = sorted(calm.collect())
    monkeypatch.setattr(M, "crowds", lambda rows, by: rows)
    cells = M.match_candidates(d, g, 0.3)
    assert "Generate" in plan(cells) and len(want) > 50 and sorted(cells.collect()) == want


def test_heat_moves_its_sums_once(spark):
    df = spark.range(300).selectExpr("id div 20 AS image_id", "id % 50 * 7D AS x1", "id % 40 * 5D AS y1", "id % 50 * 7D + 40 + id % 13 AS x2", "id % 40 * 5D + 60 AS y2")
    out = T.normalize_heat(T.heat(df, cell=16))
    text = plan(out).split("Initial Plan")[-1]
    assert text.count("Exchange hashpartitioning") == 2 and "Join" not in text  # sums by cell, then by image
    best = {r["image_id"]: r["level"] for r in out.groupBy("image_id").agg(F.max("level").alias("level")).collect()}
    assert len(best) == 15 and set(best.values()) == {255}


def test_pose_matching_copies_no_poses(spark, monkeypatch):
    rng = random.Random(5)
    box = lambda i: (i, rng.randrange(3), rng.randrange(2), rng.random(), x := rng.uniform(0, 200), y := rng.uniform(0, 200), x + rng.uniform(60, 300), y + rng.uniform(60, 300))
    boxes, truths = [box(i) for i in range(60)], [box(i) for i in range(30)]
    boxes += [(100 + t[0], *t[1:4], *(v + rng.uniform(-2, 2) for v in t[4:])) for t in truths]
    ddl = "{} bigint, image_id bigint, cls int, conf double, x1 double, y1 double, x2 double, y2 double"
    dets, gts = spark.createDataFrame(boxes, ddl.format("det_id")), spark.createDataFrame(truths, ddl.format("gt_id"))
    joints = lambda p: F.expr(f"transform(sequence(0, 16), j -> named_struct('x', {p}x1 + ({p}x2 - {p}x1) * j / 17, 'y', {p}y1 + ({p}y2 - {p}y1) * (j * 5 % 17) / 17, 'c', CAST(j % 3 AS DOUBLE)))")
    rows = lambda df: sorted((r["det_id"], r["gt_id"], round(r["overlap"], 9), r["conf"]) for r in df.collect())
    brute = dets.alias("a").join(gts.alias("b"), ["image_id", "cls"]).select(
        "det_id", "gt_id", P.oks(joints("b."), joints("a."), F.expr("(b.x2 - b.x1) * (b.y2 - b.y1) * 0.53D")).alias("overlap"), F.col("a.conf").alias("conf"))
    best = {}
    for r in rows(brute):
        if r[2] >= 0.5 and (r[0] not in best or (-r[2], r[1]) < (-best[r[0]][2], best[r[0]][1])):
            best[r[0]] = r
    made = M.pose_candidates(dets, gts, joints=(joints, joints))
    assert "Generate" not in plan(made) and len(best) >= 20
    assert rows(made) == sorted(best.values())
    assert rows(M.pose_candidates(dets.withColumn("kpts", joints("")), gts.withColumn("kpts", joints("")))) == sorted(best.values())
    monkeypatch.setattr(M, "crowds", lambda *_: True)
    cells = M.pose_candidates(dets, gts, joints=(joints, joints))
    assert "Generate" in plan(cells) and rows(cells) == sorted(best.values())
