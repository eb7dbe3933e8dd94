"""Lines that name their image: a folder or file an image would be most of the time of a large set."""

import glob

import __spark_entry__ as entry
from visiontables.plans import sources_queries
from visiontables.sources import readers as RD
from visiontables.sources import writers as WR


def labels(spark):
    return spark.range(500).selectExpr("concat('im age ', id DIV 5) AS image_id", "CAST(id % 3 AS INT) AS cls", "id / 1000D AS xc", "0.25D AS yc", "0.5D AS bw", "0.125D AS bh")


def test_named_label_lines_come_back(spark, tmp_path):
    path = str(tmp_path / "named")
    WR.write_label_text(labels(spark), path, named=True)
    got = RD.label_boxes(RD.read_label_text(spark, path, named=True)).selectExpr("image AS image_id", "cls", "xc", "yc", "bw", "bh")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, labels(spark).collect()))


def test_files_do_not_grow_with_images(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources_queries, "place", lambda spark, name: f"{tmp_path}/{name}")
    for name, place in (("src03_label_text", "labels"), ("src07_visdrone", "visdrone")):
        assert entry.queries()[name](spark, "/root/testdata/sf0.01").count() == 15000
        assert 0 < len(glob.glob(f"{tmp_path}/{place}/**/part-*", recursive=True)) < 100
