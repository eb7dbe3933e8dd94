"""Spark twins of the derived input views, from the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visiontables.operators.ordered import rank_rows

# Counting line, zones and tiling used by the checks; fixed values.
LINE = [(320.0, 0.0), (320.0, 480.0)]
RECT = [(160.0, 120.0), (480.0, 120.0), (480.0, 360.0), (160.0, 360.0)]
CONCAVE = [(100.0, 100.0), (540.0, 100.0), (540.0, 400.0), (320.0, 220.0), (100.0, 400.0)]
# Some detections lie away from their object, some objects away from their detection: false alarms and misses.
AWAY = "((o_orderkey*37+CASE WHEN o_orderkey%13=0 THEN 250 ELSE 0 END)%500)"
ASIDE = "((o_orderkey*61+CASE WHEN o_orderkey%7=0 THEN 175 ELSE 0 END)%350)"
ANGLES = ["front", "left45", "right45", "side_left", "side_right", "side", "behind"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _image(key):
    return F.floor(key / 20).cast("bigint")


def detections(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    o = o.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return o.selectExpr(
        "o_orderkey*2+k AS det_id", "CAST(floor(o_orderkey/20.0) AS BIGINT) AS image_id",
        "CAST(CASE WHEN o_orderkey%11=0 THEN (o_custkey+1)%5 ELSE o_custkey%5 END AS INT) AS cls",
        f"CAST({AWAY}+(o_orderkey*(7+k))%23-11 AS DOUBLE) AS x1",
        "CAST((o_orderkey*61)%350+(o_orderkey*(5+k))%19-9 AS DOUBLE) AS y1",
        f"CAST({AWAY}+40+(o_orderkey*13)%100+(o_orderkey*(3+k))%17-8 AS DOUBLE) AS x2",
        "CAST((o_orderkey*61)%350+40+(o_orderkey*29)%80+(o_orderkey*(11+k))%21-10 AS DOUBLE) AS y2",
        "CAST(((o_orderkey*2+k)*7919)%1000003 AS DOUBLE)/1000003 AS conf")


def ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS gt_id", "CAST(floor(o_orderkey/20.0) AS BIGINT) AS image_id", "CAST(o_custkey%5 AS INT) AS cls",
        "CAST((o_orderkey*37)%500 AS DOUBLE) AS x1", f"CAST({ASIDE} AS DOUBLE) AS y1",
        "CAST((o_orderkey*37)%500+40+(o_orderkey*13)%100 AS DOUBLE) AS x2",
        f"CAST({ASIDE}+40+(o_orderkey*29)%80 AS DOUBLE) AS y2")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return ground_truth(spark, sf).selectExpr(
        "gt_id", "image_id", "CAST(640 AS BIGINT) AS w", "CAST(480 AS BIGINT) AS h", "cls", "((x1+x2)/2)/640 AS xc",
        "((y1+y2)/2)/480 AS yc", "(x2-x1)/640 AS bw", "(y2-y1)/480 AS bh")


def images(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "orders").groupBy(_image(F.col("o_orderkey")).alias("image_id"))
            .agg(F.count("*").alias("n_objects"))
            .selectExpr("image_id", "CAST(320+(image_id*37)%640 AS BIGINT) AS w",
                        "CAST(240+(image_id*53)%480 AS BIGINT) AS h", "n_objects"))


def obb(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).selectExpr(
        "det_id", "image_id", "cls", "(x1+x2)/2 AS cx", "(y1+y2)/2 AS cy", "x2-x1 AS w", "y2-y1 AS h",
        "CAST(det_id%628 AS DOUBLE)/100-CAST(1.5 AS DOUBLE) AS theta", "conf")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return ground_truth(spark, sf).selectExpr(
        "*", "array(named_struct('x',x1,'y',y1), named_struct('x',x2,'y',y1+gt_id%7), named_struct('x',x2-gt_id%5,'y',y2),"
        " named_struct('x',(x1+x2)/2,'y',y2+gt_id%11), named_struct('x',x1-gt_id%9,'y',y2-3)) AS pts")


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").selectExpr(
        "CAST(user_id%4 AS BIGINT) AS source_id", "user_id AS track_id", "event_id", "ts", "event_type AS cls_name", "value")
    hour = F.date_trunc("hour", F.col("ts"))
    e = rank_rows(e, ["track_id"], [F.col("ts"), F.col("event_id")], hour, out="frame")
    return e.selectExpr(
        "source_id", "track_id", "event_id", "ts", "cls_name", "value", "frame",
        "CAST(abs((frame*17+track_id*29)%1280-640) AS DOUBLE) AS cx",
        "CAST(abs((frame*11+track_id*53)%960-480) AS DOUBLE) AS cy",
        "CAST(20+track_id%30 AS DOUBLE) AS w", "CAST(30+track_id%40 AS DOUBLE) AS h")


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "concat('run_', CAST(user_id%24 AS STRING)) AS run_id", "event_id", "ts", "user_id AS track_id",
        "event_type AS technique", "concat('angle_', CAST(event_id%5 AS STRING)) AS reference_angle",
        "least(CAST(100 AS DOUBLE), value) AS score", "CAST(45+user_id%24 AS DOUBLE) AS score_threshold",
        "value >= CAST(45+user_id%24 AS DOUBLE) AS is_correct",
        "CASE WHEN event_id%17=0 THEN NULL ELSE CAST(event_id%200-100 AS DOUBLE)/100 END AS cosine_similarity",
        "CASE WHEN event_id%3=0 THEN 'Good form' WHEN event_id%3=1 THEN 'Slow down and focus on form' ELSE '' END AS feedback_1")


def poses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "CAST(floor(vec_id/10.0) AS BIGINT) AS seq_id", "vec_id%10 AS frame", "label",
        "transform(sequence(0,16), j -> named_struct('x', CAST(embedding[3*j] AS DOUBLE), 'y', CAST(embedding[3*j+1] AS DOUBLE),"
        " 'c', CAST(abs(embedding[3*j+2])*8 AS DOUBLE))) AS kpts")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "concat('v', CAST(doc_id%701 AS STRING)) AS video_id", "doc_id AS pos", "text AS title", "lang AS tags",
        "source AS query_hit", "n_chars AS view_count",
        "concat('PT', CAST(doc_id%3 AS STRING), 'H', CAST(doc_id%60 AS STRING), 'M', CAST((doc_id*7)%60 AS STRING), 'S')"
        " AS duration_iso8601")


def plan(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").groupBy(F.col("event_type").alias("technique")).agg(F.count("*").alias("n_events"))
    angles = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(a).alias("angle")) for i, a in enumerate(ANGLES)])
    return t.withColumn("a", F.explode(angles)).selectExpr(
        "technique", "a.angle AS angle", "CASE WHEN (length(technique)+a.n)%3=0 THEN 'todo' ELSE 'ready' END AS status",
        "CASE WHEN (length(technique)+a.n)%4=0 THEN 'no' ELSE 'yes' END AS command_ready",
        "concat('u', CAST(a.n AS STRING), '|u', CAST(a.n%3 AS STRING)) AS source_url_1",
        "concat('u', CAST(a.n*2 AS STRING)) AS source_url_2", "n_events")
