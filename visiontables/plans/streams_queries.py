"""Streams over the events file, run to what is available, and the tracker."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiontables.plans import fixtures as fx
from visiontables.plans.boxes_queries import XYXY, r
from visiontables.registry import query
from visiontables.streaming import folds
from visiontables.streaming import streams as ST
from visiontables.streaming.tracker import Settings


def events(spark, sf, time="1 hour"):
    static = fx.table(spark, sf, "events")
    d = ST.source_stream(spark, sf, static.schema, "events*.parquet").drop("props")
    return ST.event_time(d, "ts", time)


@query("str01_source_stream", "SELECT CAST(user_id%4 AS BIGINT) AS source_id, event_id, value FROM events")
def str01(spark, sf):
    d = ST.source_stream(spark, sf, fx.table(spark, sf, "events").schema, "events*.parquet")
    return ST.run_available(d.selectExpr("CAST(user_id%4 AS BIGINT) AS source_id", "event_id", "value"))


#: When the streams end; what the watermark has not passed by then is not written.
END_SQL = "e AS (SELECT epoch_ms(max(ts))*1000-3600000000 AS until FROM events)"


@query("str02_tumbling_counts", f"""WITH {END_SQL}, w AS (SELECT CAST(epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS BIGINT) AS start_us, event_type FROM events)
SELECT start_us, event_type, count(*) AS n FROM w, e WHERE start_us+21600000000<=until GROUP BY 1,2""")
def str02(spark, sf):
    out = ST.run_available(ST.tumbling_counts(events(spark, sf), "ts", "6 hours", ["event_type"]))
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


ARRIVED_SQL = """a AS (SELECT *, CAST(floor(epoch(ts-TIMESTAMP '2024-01-01')/864000) AS INT)+CASE WHEN event_id%20=0 THEN 1 ELSE 0 END AS arrival, epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start_us FROM events),
m AS (SELECT arrival, max(max(epoch_ms(ts))) OVER (ORDER BY arrival)*1000-3600000000 AS until FROM a GROUP BY arrival)"""


@query("str02_late_rows", f"""WITH {ARRIVED_SQL}
SELECT CAST(start_us AS BIGINT) AS start_us, event_type, count(*) AS n FROM a LEFT JOIN m ON m.arrival=a.arrival-1
WHERE start_us+21600000000>coalesce(until,0) AND start_us+21600000000<=(SELECT max(until) FROM m) GROUP BY 1,2""")
def str02_late(spark, sf):
    """A twentieth of the events arrives with the next ten days' batch: what then belongs to a finished window is left out."""
    rows = fx.table(spark, sf, "events").drop("props").withColumn(
        "arrival", F.expr("CAST(floor((unix_micros(CAST(ts AS TIMESTAMP))-unix_micros(TIMESTAMP '2024-01-01'))/864000000000D) AS INT)+CASE WHEN event_id%20=0 THEN 1 ELSE 0 END"))
    batches = [rows.where(F.col("arrival") == k).drop("arrival") for k in range(4)] + [rows.where(F.col("arrival") > 3).drop("arrival")]
    out = ST.run_arrivals(batches, lambda d: ST.tumbling_counts(ST.event_time(d, "ts", "1 hour"), "ts", "6 hours", ["event_type"]))
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("str03_sliding_counts", f"""
WITH {END_SQL}, w AS (SELECT event_type, epoch_us(time_bucket(INTERVAL '3 hours', ts))-k*10800000000 AS start_us FROM events CROSS JOIN range(2) q(k))
SELECT CAST(start_us AS BIGINT) AS start_us, event_type, count(*) AS n FROM w, e WHERE start_us+21600000000<=until GROUP BY 1,2""")
def str03(spark, sf):
    out = ST.run_available(ST.sliding_counts(events(spark, sf), "ts", "6 hours", "3 hours", ["event_type"]))
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("str04_track_sessions", f"""
WITH {END_SQL}, p AS (SELECT user_id, ts, CASE WHEN ts-lag(ts) OVER w < INTERVAL '8 hours' THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM p),
t AS (SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts))+28800000000 AS BIGINT) AS end_us, count(*) AS n FROM s GROUP BY user_id, s)
SELECT t.* FROM t, e WHERE end_us<=until""")
def str04(spark, sf):
    out = ST.run_available(ST.track_sessions(events(spark, sf), "ts", "8 hours", ["user_id"]))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


#: A track that is unseen for so long starts afresh, and its state goes.
PAUSE_MS = 2 * 86_400_000
MOVES = f"""m AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY track_id ORDER BY frame) AS BIGINT) AS part FROM (
 SELECT user_id AS track_id, event_id AS frame, CAST(abs((event_id*17+user_id*29)%1280-640) AS DOUBLE) AS cx, CAST(abs((event_id*11+user_id*53)%960-480) AS DOUBLE) AS cy, value AS angle,
 CASE WHEN epoch_ms(ts)-lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY event_id)>{PAUSE_MS} THEN 1 ELSE 0 END AS cut FROM events))"""


def moves(spark, sf):
    return events(spark, sf).selectExpr("user_id AS track_id", "event_id AS frame", "CAST(abs((event_id*17+user_id*29)%1280-640) AS DOUBLE) AS cx",
                                        "CAST(abs((event_id*11+user_id*53)%960-480) AS DOUBLE) AS cy", "value AS angle", "ts")


def folded(spark, sf, fold):
    return ST.run_available(ST.fold_stream(moves(spark, sf), ["track_id"], ["frame"], *fold, pause_ms=PAUSE_MS))


@query("str05_crossing_counter", f"""WITH {MOVES}, p AS (SELECT *, lag(cx) OVER (PARTITION BY track_id, part ORDER BY frame) AS px FROM m)
SELECT track_id, frame, CASE WHEN cx>px THEN 'IN' ELSE 'OUT' END AS direction FROM p WHERE px IS NOT NULL AND least(px,cx)<=320 AND greatest(px,cx)>=320 QUALIFY row_number() OVER (PARTITION BY track_id, part ORDER BY frame)=1""")
def str05(spark, sf):
    return folded(spark, sf, folds.crossing(fx.LINE))


@query("str06_rep_counter", f"""WITH {MOVES}, e AS (SELECT track_id, part, frame, CASE WHEN angle<8 THEN 'down' WHEN angle>20 THEN 'up' END AS kind FROM m),
p AS (SELECT *, lag(kind IGNORE NULLS) OVER (PARTITION BY track_id, part ORDER BY frame) AS was FROM e)
SELECT track_id, frame, row_number() OVER (PARTITION BY track_id, part ORDER BY frame) AS reps FROM p WHERE kind='down' AND was='up'""")
def str06(spark, sf):
    return folded(spark, sf, folds.repetitions(8, 20))


@query("str07_speed_lock", f"""WITH {MOVES}, k AS (SELECT *, row_number() OVER (PARTITION BY track_id, part ORDER BY frame) AS k FROM m)
SELECT b.track_id, b.frame, CAST(trunc(least(sqrt(pow(b.cx-a.cx,2)+pow(b.cy-a.cy,2))*0.05::DOUBLE/((b.frame-a.frame)/30)*3.6::DOUBLE,120)) AS INT) AS speed FROM k a JOIN k b USING (track_id, part) WHERE a.k=1 AND b.k=5""")
def str07(spark, sf):
    return folded(spark, sf, folds.speed_lock())


def frames(spark, sf):
    """Detections of 4 sources, one image after the other as frames."""
    return fx.detections(spark, sf).selectExpr("image_id%4 AS source_id", "image_id div 4 + (image_id div 200)*100 AS frame", "det_id", "cls", "conf", *XYXY)


@query("str10_track")
def str10(spark, sf):
    t = ST.track(frames(spark, sf))
    return t.select("source_id", "frame", "track_id", *[r(F.col(c), c, 4) for c in XYXY], "cls", "det_id")


@query("str10_track_xywh")
def str10_xywh(spark, sf):
    t = ST.track(frames(spark, sf), Settings(form="xywh"))
    return t.groupBy("source_id", "track_id").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query("str11_dedupe_events", "SELECT DISTINCT event_id, user_id FROM events")
def str11(spark, sf):
    twice = events(spark, sf).select("event_id", "user_id", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return ST.run_available(ST.dedupe_events(twice, ["event_id"]).select("event_id", "user_id"))


@query("str09_live_windows", """
WITH s AS (SELECT seq_id AS track_id, frame AS at_frame, list({'f': frame, 'x': kpts[1].x}) OVER (PARTITION BY seq_id ORDER BY frame ROWS 3 PRECEDING) AS l FROM fx_poses),
u AS (SELECT track_id, at_frame, unnest(range(4)) AS frame, unnest(l) AS p FROM s WHERE len(l)=4) SELECT track_id, at_frame, frame, round(p.x,6) AS nose_x FROM u""")
def str09(spark, sf):
    """Rolling pose windows of a stream of embeddings read as poses."""
    w = ST.run_available(live_windows(spark, sf, 4))
    return w.select("track_id", "at_frame", "frame", r(w.kpts[0]["x"], "nose_x"))


def live_windows(spark, sf, n):
    d = ST.source_stream(spark, sf, fx.table(spark, sf, "embeddings").schema, "embeddings*.parquet")
    poses = d.selectExpr(
        "CAST(floor(vec_id/10.0) AS BIGINT) AS track_id", "vec_id%10 AS frame",
        "transform(sequence(0,16), j -> named_struct('x', CAST(embedding[3*j] AS DOUBLE), 'y', CAST(embedding[3*j+1] AS DOUBLE), 'c', CAST(abs(embedding[3*j+2])*8 AS DOUBLE))) AS kpts")
    return ST.fold_stream(poses, ["track_id"], ["frame"], *folds.rolling_sequences(n))


@query("str09_live_scores")
def str09_scores(spark, sf):
    """Every full window of the stream against the references of its technique, which stand still."""
    from visiontables.plans.poses_queries import refs
    s = ST.run_scores(live_windows(spark, sf, 8), refs(spark, sf), F.col("track_id").cast("int") % 3)
    return s.select("track_id", "at_frame", "is_correct", r(F.col("score"), "score", 4))


@query("str13_restart_per_video", f"""
WITH m AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS BIGINT) AS part FROM (
 SELECT user_id AS track_id, event_type AS video_id, event_id AS frame, CAST(abs((event_id*17+user_id*29)%1280-640) AS DOUBLE) AS cx,
 CASE WHEN epoch_ms(ts)-lag(epoch_ms(ts)) OVER (PARTITION BY event_type, user_id ORDER BY event_id)>{PAUSE_MS} THEN 1 ELSE 0 END AS cut FROM events)),
p AS (SELECT *, lag(cx) OVER (PARTITION BY video_id, track_id, part ORDER BY frame) AS px FROM m)
SELECT track_id, frame, CASE WHEN cx>px THEN 'IN' ELSE 'OUT' END AS direction FROM p WHERE px IS NOT NULL AND least(px,cx)<=320 AND greatest(px,cx)>=320 QUALIFY row_number() OVER (PARTITION BY video_id, track_id, part ORDER BY frame)=1""")
def str13(spark, sf):
    d = events(spark, sf).selectExpr("event_type AS video_id", "user_id AS track_id", "event_id AS frame", "CAST(abs((event_id*17+user_id*29)%1280-640) AS DOUBLE) AS cx",
                                     "CAST(abs((event_id*11+user_id*53)%960-480) AS DOUBLE) AS cy", "ts")
    step, schema = folds.crossing(fx.LINE)
    return ST.run_available(ST.fold_stream(d, ["video_id", "track_id"], ["frame"], step, schema, pause_ms=PAUSE_MS))
