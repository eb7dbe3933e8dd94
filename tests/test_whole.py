"""Nothing is cut off by default, and the hard cases come out right."""

import numpy as np
from pyspark.sql import functions as F

from visiontables.operators import catalog as C
from visiontables.operators import convert as CV
from visiontables.operators import match as M
from visiontables.operators import ordered as O
from visiontables.sources import readers as RD


def test_a_label_line_of_any_length(spark, tmp_path):
    (tmp_path / "a.txt").write_text("3 " + " ".join(["0.5"] * 100_001) + "\n")
    row = RD.read_label_text(spark, str(tmp_path)).first()
    assert row.n_columns == 100_002 and len(row.numbers) == 100_001


def test_suppression_keeps_all_boxes(spark):
    boxes = spark.range(301).select(F.lit(1).alias("image_id"), F.col("id").alias("det_id"), F.lit(0).alias("cls"), (1 - F.col("id") / 1000).alias("conf"),
                                    *[(F.col("id") * 10.0 + d).alias(c) for c, d in (("x1", 0), ("y1", 0), ("x2", 5), ("y2", 5))])
    assert M.nms_greedy(boxes).count() == 301 and M.nms_batched(boxes).count() == 301 and M.nms_greedy(boxes, max_det=300).count() == 300


def test_five_urls(spark):
    rows = spark.createDataFrame([("t", "a", f"u{k}", k) for k in range(7)], "technique string, angle string, url string, view_count int")
    got = C.top_urls(rows, 5).first()
    assert [got[f"source_url_{k}"] for k in range(1, 6)] == ["u6", "u5", "u4", "u3", "u2"]


def test_frames_longer_than_a_block(spark):
    rows = spark.range(1, 14_001).select(F.col("id").alias("rn"))
    cut = O.blocks_with_halo(rows, "rn", before=5_999)
    n = F.count("*").over(O.block_window([], "rn").rowsBetween(-5_999, 0))
    got = {r.rn: r.n for r in O.drop_halo(cut.withColumn("n", n)).where("rn in (1, 5999, 6000, 12500, 14000)").collect()}
    assert got == {1: 1, 5999: 5999, 6000: 6000, 12500: 6000, 14000: 6000}


def test_null_keys_keep_their_rows(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", None)], "k string, v int")
    ranked = O.rank_rows(rows, ["k"], [F.col("v")], F.floor("v"), "rn").collect()
    assert sorted((str(r.k), str(r.v), r.rn) for r in ranked) == [("None", "1", 1), ("None", "2", 2), ("a", "3", 2), ("a", "None", 1)]
    run = O.running(rows, ["k"], [F.col("v")], F.floor("v"), {"s": ("sum", F.coalesce("v", F.lit(0)))}).collect()
    assert sorted((str(r.k), str(r.v), r.s) for r in run) == [("None", "1", 1), ("None", "2", 3), ("a", "3", 3), ("a", "None", 0)]


def test_names_are_unique(spark):
    bases = ["a", "a", "a_2", "a_2", "a", "a_3", "b_02", "b", "b", "a_2_2"]
    rows = spark.createDataFrame(list(enumerate(bases)), "pos int, base string")
    got = [r.name for r in C.unique_name(rows, "base", [F.col("pos")], F.col("pos")).orderBy("pos").collect()]
    assert len(set(got)) == len(got) and got == ["a", "a_4", "a_2", "a_2_3", "a_5", "a_3", "b_02", "b", "b_2", "a_2_2"]


def test_columns_by_their_header(spark, tmp_path):
    for user, header, line in (("ann_1", "score_threshold,run_id,score", "0.5,r1,0.9"), ("bob_2", "run_id,score,score_threshold,extra", "r2,0.8,0.4,x")):
        (tmp_path / "g" / user).mkdir(parents=True)
        (tmp_path / "g" / user / "metrics.csv").write_text(f"{header}\n{line}\n")
    got = {r.run_id: (r.score, r.score_threshold, r.user, r.group_name) for r in RD.read_run_metrics(spark, str(tmp_path)).collect()}
    assert got == {"r1": (0.9, 0.5, "ann", "g"), "r2": (0.8, 0.4, "bob", "g")}
    (tmp_path / "plan.csv").write_text('﻿angle,technique,notes\nfront,jab,"two\nlines"\nleft,hook,\n')
    rows = RD.read_plan(spark, str(tmp_path / "plan.csv")).orderBy("csv_line").collect()
    assert [(r.csv_line, r.technique, r.angle, r.notes, r.status) for r in rows] == [(2, "jab", "front", "two\nlines", ""), (3, "hook", "left", "", "")]


def test_outline_walks_there_and_back():
    square = lambda x: np.asarray([(x, 0.0), (x + 2, 0), (x + 2, 2), (x, 2)])
    got = CV._outline([square(0), square(4), square(8)])
    assert {tuple(p) for p in got} == {(x, y) for x in (0, 2, 4, 6, 8, 10) for y in (0, 2)}
    assert len(got) == 5 + 2 + 5 + 4 and tuple(got[0]) == tuple(got[4])
    assert (CV._outline([square(0)]) == square(0)).all()


