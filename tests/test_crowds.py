"""Hot keys: one image, one class or one value that holds nearly all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visiontables.operators import evaluate as E
from visiontables.operators import match as M
from visiontables.operators import ordered as O

BOX = "det_id long, image_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double"


def boxes(rng, n, images, side):
    out = []
    for k in range(n):
        x, y = rng.uniform(0, side), rng.uniform(0, side)
        out.append((k, rng.choice(images), rng.randrange(2), round(rng.random(), 1), x, y, x + rng.uniform(5, 60), y + rng.uniform(5, 60)))
    return out


@pytest.mark.parametrize("form", [dict(), dict(agnostic=True), dict(max_det=7), dict(by=("image_id", "cls"), agnostic=True), dict(conf=0.3, max_nms=90, max_det=20)])
def test_suppression_in_rounds_equals_the_fold(spark, form):
    df = spark.createDataFrame(boxes(random.Random(4), 700, [1, 1, 1, 2, 3, None], 300), BOX).repartition(3)
    folded = M.nms_greedy(df, 0.3, fold=10_000, **form)
    want = sorted(map(str, folded.collect()))
    for fold in (0, 120):
        got = M.nms_greedy(df, 0.3, fold=fold, **form)
        assert got.columns == folded.columns == df.columns and sorted(map(str, got.where("image_id is not null").collect())) == [w for w in want if "image_id=None" not in w]


def test_a_chain_is_decided_from_its_best_box(spark):
    rows = [(k, 1, 0, 1 - k / 100, 10.0 * k, 0.0, 10.0 * k + 30, 10.0) for k in range(60)]  # a box clashes with two before it
    kept = M.nms_greedy(spark.createDataFrame(rows, BOX), 0.3, fold=0)
    assert sorted(r["det_id"] for r in kept.collect()) == list(range(0, 60, 2))  # one step: 20/40, two: 10/50


def test_one_crowded_image_is_many_tasks(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("det_id"), F.lit(1).cast("long").alias("image_id"), F.lit(0).alias("cls"), ((F.col("id") * 7919 % n) / n).alias("conf"),
                               (F.col("id") % 400 * 50.0).alias("x1"), (F.floor(F.col("id") / 800) * 50.0).alias("y1")).selectExpr("*", "x1 + 40 + det_id % 3 as x2", "y1 + 40.0 as y2")
    kept = M.nms_greedy(df, 0.45)
    assert kept.count() == n // 2  # every place has two boxes
    pairs = M.overlap_pairs(df, df, ("image_id", "cls"), F.col("a_det_id") < F.col("b_det_id"))
    spread = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < n // 4


def curves(tp, n_l):
    """Precision, recall and envelope of one class in order, plainly."""
    hits = np.cumsum(tp)
    precision, recall = hits / np.arange(1, len(tp) + 1), hits / n_l
    return precision, recall, np.maximum.accumulate(precision[::-1])[::-1]


def test_curves_of_a_class_of_equal_confidences(spark):
    rng = random.Random(5)
    rows = [(k, int(k % 50 == 0), 0.5 if k % 10 else round(rng.random(), 3), [int(rng.random() < 0.6)]) for k in range(6000)]
    table = spark.createDataFrame(rows, "det_id long, cls int, conf double, tp array<int>").repartition(5)
    totals = spark.createDataFrame([(0, 5000), (1, 100)], "cls int, n_l long")
    env = E.precision_envelope(E.precision_recall(table, totals, 1), 1)
    got = env.collect()
    # no part has much more than its share of the class
    sizes = env.where("cls = 0").groupBy("_part").count().collect()
    assert len(sizes) >= 7 and max(r["count"] for r in sizes) < 1500
    ap, smooth = {}, {}
    for cls, n_l in ((0, 5000), (1, 100)):
        own = sorted((r for r in rows if r[1] == cls), key=lambda r: (-r[2], r[0]))
        p, r, e = curves([x[3][0] for x in own], n_l)
        mine = sorted((g for g in got if g["cls"] == cls), key=lambda g: g["rank"])
        assert [g["det_id"] for g in mine] == [x[0] for x in own]
        assert np.allclose([g["precision"][0] for g in mine], p) and np.allclose([g["recall"][0] for g in mine], r) and np.allclose([g["env"][0] for g in mine], e)
        x = np.linspace(0, 1, 101)
        y = np.interp(x, np.concatenate(([0.0], r, [1.0])), np.concatenate(([1.0], e, [0.0])))
        ap[cls] = float(np.sum((y[1:] + y[:-1]) / 2) * 0.01)
        conf = np.asarray([x[2] for x in own])
        smooth[cls] = np.interp(-np.linspace(0, 1, 1000), -conf, r, left=0)
    assert {r["cls"]: pytest.approx(r["ap"]) for r in E.average_precision(env).collect()} == ap
    read = E.confidence_curves(E.precision_recall(table, totals, 1)).orderBy("i").collect()
    for cls in (0, 1):
        mine = np.asarray([g["r"] for g in read if g["cls"] == cls])
        apart = np.abs(np.linspace(0, 1, 1000)[:, None] - np.asarray([x[2] for x in rows if x[1] == cls])[None, :]).min(axis=1) > 1e-6
        assert len(mine) == 1000 and np.allclose(mine[apart], smooth[cls][apart], atol=1e-9)


def test_running_over_parts(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(4), k, rng.randrange(100)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id long, x long")
    parts = O.sorted_parts(df, ["k"], [F.col("v").desc(), F.col("id").asc()])
    got = O.running_over_parts(O.running_over_parts(parts, ["k"], {"s": ("sum", F.col("x"))}), ["k"], {"m": ("max", F.col("x"))}, backwards=True).collect()
    assert len(got) == len(rows)
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        mine = {g["id"]: (g["s"], g["m"]) for g in got if g["k"] == k}
        xs = [r[3] for r in own]
        assert [mine[r[2]] for r in own] == list(zip(np.cumsum(xs).tolist(), np.maximum.accumulate(xs[::-1])[::-1].tolist()))
    ranks = {g["id"]: g["rn"] for g in O.rank_parts(df, [], [F.col("v").asc(), F.col("id").desc()]).collect()}
    assert [ranks[r[2]] for r in sorted(rows, key=lambda r: (r[1], -r[2]))] == list(range(1, 3001))
