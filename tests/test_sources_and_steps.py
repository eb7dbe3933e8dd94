"""Tables that are folders of files, streams without rows, and steps that have no row before them."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from visiontables.plans import poses_queries, streams_queries
from visiontables.streaming import streams as ST


def poses_folder(spark, root, where="true", sf="sf0.001"):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").where(where)
    rows.repartition(3).write.parquet(f"{root}/embeddings.parquet")
    return str(root)


def test_windows_of_a_table_in_several_files(spark, tmp_path):
    sf = poses_folder(spark, tmp_path, "vec_id < 40")
    got = entry.queries()["str09_live_windows"](spark, sf)
    assert got.count() == 4 * 7 * 4


def test_scores_of_a_table_in_several_files(spark, tmp_path):
    sf = poses_folder(spark, tmp_path, sf="sf0.01")
    clips = spark.read.parquet(f"{sf}/embeddings.parquet").count() // 10
    assert entry.queries()["str09_live_scores"](spark, sf).select("track_id", "at_frame").distinct().count() == clips * 3


def test_a_stream_without_rows_has_no_scores(spark, tmp_path):
    sf = poses_folder(spark, tmp_path, "vec_id < 0")
    refs = poses_queries.refs(spark, "/root/testdata/sf0.001")
    scores = ST.run_scores(streams_queries.live_windows(spark, sf, 8), refs, F.col("track_id").cast("int") % 3)
    assert scores.count() == 0 and "score" in scores.columns


def test_a_first_sighting_on_a_line_counts(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) AS ts, 827L AS user_id, 'view' AS event_type, 1D AS value, '' AS props FROM range(1)")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["joi12_line_cross_join"](spark, str(tmp_path)).collect()
    assert [(r.event_id, r.line) for r in got] == [(0, "middle")]
