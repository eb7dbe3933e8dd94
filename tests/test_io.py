import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from visiontables.operators import convert as CV
from visiontables.sources import readers as RD
from visiontables.sources import writers as WR


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_run_metrics(spark, tmp_path):
    head = ",".join(RD.RUN_COLUMNS)
    row = ["r1", "2024-01-01T00:00:00Z", "3", "1", "jab", "front", "70.5", "60", "True", "nan", "0.2", "oops", "0.1", "False", "Good form", "", "cam"]
    put(tmp_path / "groupA" / "ann_01" / "metrics.csv", head + "\n" + ",".join(row) + "\n")
    put(tmp_path / "groupA" / "ann_01" / "other.csv", "x\n1\n")
    r = RD.read_run_metrics(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0].group_name, r[0].user, r[0].score, r[0].is_correct, r[0].frame) == ("groupA", "ann", 70.5, True, 3)
    assert r[0].cosine_similarity is None and r[0].angle_error is None


def test_plan_with_byte_order_mark(spark, tmp_path):
    head = ",".join(RD.PLAN_COLUMNS)
    rows = [["jab", "front"] + [f"v{i}" for i in range(15)], ["hook", '"side, left"'] + [""] * 15]
    p = put(tmp_path / "plan.csv", "﻿" + head + "\n" + "\n".join(",".join(r) for r in rows) + "\n")
    out = RD.read_plan(spark, p).orderBy("csv_line").collect()
    assert [(r.csv_line, r.technique, r.angle) for r in out] == [(2, "jab", "front"), (3, "hook", "side, left")]


def test_label_text(spark, tmp_path):
    put(tmp_path / "a.txt", "0 0.5 0.5 0.2 0.4\n\n1 0.1 0.1 0.3 0.1 0.3 0.5 0.1 0.5\n")
    d = RD.read_label_text(spark, str(tmp_path))
    b = {r.cls: r for r in RD.label_boxes(d).collect()}
    assert (b[0].xc, b[0].bw, b[0].image) == (0.5, 0.2, "a") and (b[1].xc, b[1].yc, b[1].bw, b[1].bh) == pytest.approx((0.2, 0.3, 0.2, 0.4))


def test_coco_and_objects365(spark, tmp_path):
    doc = {"images": [{"id": 1, "height": 100, "width": 200, "file_name": "1.jpg"}], "categories": [{"id": 7, "name": "a"}, {"id": 3, "name": "b"}],
           "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [10, 20, 40, 20], "iscrowd": 0}, {"id": 2, "image_id": 1, "category_id": 3, "bbox": [10, 20, 40, 20]},
                           {"id": 3, "image_id": 1, "category_id": 7, "bbox": [0, 0, 0, 5]}, {"id": 4, "image_id": 1, "category_id": 7, "bbox": [0, 0, 5, 5], "iscrowd": 1}]}
    p = put(tmp_path / "c.json", json.dumps(doc, indent=1))
    out = CV.from_coco(RD.read_coco(spark, p)).collect()
    assert len(out) == 1 and (out[0].cls, out[0].xc, out[0].yc, out[0].bw, out[0].bh, out[0].ann_id) == (2, 0.15, 0.3, 0.2, 0.2, 1)
    o = CV.from_objects365(RD.read_objects365(spark, p), "ann_id").where("ann_id = 1").first()
    assert o.cls == 1 and o.xc == 0.15


def test_voc(spark, tmp_path):
    obj = "<object><name>{}</name><difficult>{}</difficult><bndbox><xmin>10</xmin><ymin>20</ymin><xmax>30</xmax><ymax>60</ymax></bndbox></object>"
    put(tmp_path / "x.xml", "<annotation><filename>x.jpg</filename><size><width>100</width><height>200</height></size>" + obj.format("dog", 0) + obj.format("cat", 0) + obj.format("dog", 1) + "</annotation>")
    r = CV.from_voc(RD.read_voc(spark, str(tmp_path)), ["cow", "dog"], "pos").collect()
    assert [(x.cls, x.xc, x.yc, x.bw, x.bh) for x in r] == [(1, 0.19, 0.195, 0.2, 0.2)]


def test_flat_sets(spark, tmp_path):
    sku = put(tmp_path / "sku.csv", "a.jpg,0,0,50,50,object,100,200\n")
    r = CV.from_sku(RD.read_sku(spark, sku), "class").first()
    assert (r.xc, r.yc, r.bw, r.bh) == (0.25, 0.125, 0.5, 0.25)
    put(tmp_path / "vis" / "f1.txt", "0,0,10,20,1,4,0,0\n5,5,5,5,0,4,0,0\n")
    v = RD.read_visdrone(spark, str(tmp_path / "vis")).withColumn("img_w", F.lit(100.0)).withColumn("img_h", F.lit(100.0))
    out = CV.from_visdrone(v, "occlusion").collect()
    assert [(x.image_id, x.cls, x.xc, x.yc) for x in out] == [("f1", 3, 0.05, 0.1)]
    geo = {"features": [{"properties": {"bounds_imcoords": b, "image_id": "1.tif", "type_id": t}} for b, t in (("0,0,20,10", 11), ("0,0,5", 11), ("1,1,2,2", 14), ("", 11), ("90,90,200,200", 94))]}
    x = RD.read_xview(spark, put(tmp_path / "g.json", json.dumps(geo, indent=1))).withColumn("img_w", F.lit(100.0)).withColumn("img_h", F.lit(100.0))
    assert {(r.cls, round(r.xc, 6)) for r in CV.from_xview(x, "type_id").collect()} == {(0, 0.1), (59, 0.95)}
    signs = {"imgs": {"5": {"path": "train/5.jpg", "objects": [{"category": "pl50", "bbox": {"xmin": 0, "ymin": 0, "xmax": 10, "ymax": 10}}, {"category": "zz", "bbox": {"xmin": 0, "ymin": 0, "xmax": 1, "ymax": 1}}]}}}
    s = RD.read_signs(spark, put(tmp_path / "s.json", json.dumps(signs))).withColumn("img_w", F.lit(100.0)).withColumn("img_h", F.lit(100.0))
    assert [(r.cls, r.split, r.xc) for r in CV.from_signs(s, ["i1", "pl50"], "split").collect()] == [(1, "train", 0.05)]
    arg = {"images": [{"name": "a.jpg", "sid": 1}, {"name": "b.jpg", "sid": 0}], "seq_dirs": ["s0", "s1"], "annotations": [{"image_id": 1, "category_id": 2, "bbox": [0, 0, 192, 120]}]}
    a = CV.from_argoverse(RD.read_argoverse(spark, put(tmp_path / "a.json", json.dumps(arg))), "ann_id").first()
    assert (a.image_id, a.cls, a.xc, a.yc) == ("s0/b", 2, 0.05, 0.05)


def test_small_configs(spark, tmp_path):
    flat, nested = put(tmp_path / "f.json", '{"FrontKick": 62.5, "jab": "x"}'), put(tmp_path / "n.json", '{"thresholds": {"jab": 60}, "metrics": {"a": 1}}')
    assert [tuple(r) for r in RD.read_thresholds(spark, flat).collect()] == [("front_kick", 62.5)]
    assert [tuple(r) for r in RD.read_thresholds(spark, nested).collect()] == [("jab", 60.0)]
    reg = RD.read_regions(spark, put(tmp_path / "r.json", '[{"points": [[0, 0], [1, 0], [1, 1]]}, {"points": [[2, 2], [3, 2], [3, 3]]}]')).orderBy("region_id").collect()
    assert [(r.region_id, r.name, len(r.pts)) for r in reg] == [(0, "region_0", 3), (1, "region_1", 3)]
    t = RD.read_trials(spark, put(tmp_path / "t.csv", "fitness,lr\n0.1,0.01\n0.3,0.02\n"), ["lr"]).orderBy("iteration").collect()
    assert [(r.iteration, r.fitness) for r in t] == [(1, 0.1), (2, 0.3)]
    put(tmp_path / "runs" / "results.csv", "epoch, train/box_loss, metrics/mAP50, lr\n1, 0.5, 0.2, 0.01\n2, 0.4, 0.3, 0.01\n")
    k = RD.read_training_results(spark, str(tmp_path / "runs"), ["epoch", "train/box_loss", "metrics/mAP50", "lr"]).collect()
    assert {(r.epoch, r.key, r.kind, r.value) for r in k} >= {(1.0, "train/box_loss", "loss", 0.5), (2.0, "metrics/mAP50", "metric", 0.3)} and len(k) == 4
    log = put(tmp_path / "log.txt", "Class Images Instances P R mAP50 mAP\n all 10 20 0.5 0.6 0.7 0.4\n dog 5 8 0.1 0.2 0.3 0.2\n Speed: 1ms\n")
    assert {(r["class"], r.images, r.map) for r in RD.read_eval_log(spark, log, ["dog"]).collect()} == {("all", 10.0, 0.4), ("dog", 5.0, 0.2)}


def test_pose_library(spark, tmp_path):
    (tmp_path / "jab").mkdir()
    a = np.zeros((3, 17, 3), np.float32)
    a[1, 4, 0] = np.nan
    np.save(tmp_path / "jab" / "front_01.npy", a)
    np.save(tmp_path / "HookPunch.npy", np.ones((17, 2), np.float32))
    np.save(tmp_path / "bad.npy", np.ones(5, np.float32))
    d = RD.read_pose_library(spark, str(tmp_path)).collect()
    assert {(r.technique, r.angle) for r in d} == {("jab", "front_01"), ("hook_punch", "default")} and len(d) == 4
    assert [r.kpts[4].x for r in d if r.technique == "jab" and r.frame == 1] == [None]


def test_media_listing(spark, tmp_path):
    for n in ("a.jpg", "b/c.PNG", "b/d.txt", "e.webp", "f.bmp"):
        put(tmp_path / n, "x")
    assert RD.list_media(spark, str(tmp_path)).count() == 4 and RD.list_media(spark, str(tmp_path), 0.5).count() == 2


def test_writers(spark, tmp_path):
    lab = spark.createDataFrame([(1, 0, 0.5, 0.25, 0.123456789, 1e-05), (1, 2, 1.0, 0.5, 0.5, 0.5)], "image_id bigint, cls int, xc double, yc double, bw double, bh double")
    WR.write_label_text(lab, str(tmp_path / "lab"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "lab")).collect()}
    assert lines == {"0 0.5 0.25 0.123457 0.00001", "2 1 0.5 0.5 0.5"}
    back = spark.read.text(str(tmp_path / "lab")).where("image_id = 1").count()
    assert back == 2
    runs = spark.createDataFrame([("r1", 1.0), ("r2", 2.0)], "run_id string, score double")
    WR.append_run_metrics(runs, str(tmp_path / "m"))
    WR.append_run_metrics(runs, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).groupBy("run_id").count().collect()[0]["count"] == 2
    nested = spark.range(2).select("id", F.struct(F.lit(1).alias("a")).alias("s"))
    for fmt in ("csv", "json", "parquet"):
        WR.export(nested, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().s == '{"a":1}'
    obb = spark.createDataFrame([("im1", 0.9, 10.0, 10.0, 4.0, 2.0, 0.0)], "image string, conf double, cx double, cy double, w double, h double, theta double")
    WR.write_oriented(obb, str(tmp_path / "o"), F.lit("small car"))
    r = spark.read.text(str(tmp_path / "o")).first()
    assert r.classname == "small-car" and r.value == "im1 0.9 12.0 11.0 12.0 9.0 8.0 9.0 8.0 11.0"
    files = spark.createDataFrame([("a.jpg", "train"), ("b.jpg", "val")], "path string, split string")
    WR.write_split_lists(files, str(tmp_path / "s"))
    assert {(x.value, x.split) for x in spark.read.text(str(tmp_path / "s")).collect()} == {("./a.jpg", "train"), ("./b.jpg", "val")}
    pred = spark.createDataFrame([(None, "x", "x.jpg", 3, 1.0, 2.0, 3.0, 4.0, 0.5)], "image_id bigint, stem string, file_name string, category_id int, left double, top double, width double, height double, score double")
    WR.write_predictions(pred, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first().bbox == [1.0, 2.0, 3.0, 4.0]
