"""Track analytics over the zig-zag tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiontables.operators import tracks as T
from visiontables.plans import fixtures as fx
from visiontables.plans.boxes_queries import XYXY, r
from visiontables.plans.matching_queries import IN_CONCAVE, IN_RECT, REGIONS, iou_sql
from visiontables.registry import query

W = "WINDOW w AS (PARTITION BY track_id ORDER BY frame)"


@query("win01_track_history", """
SELECT event_id, CAST(len(l) AS INT) AS n, array_to_string(list_transform(l, lambda p: CAST(CAST(p.cx AS INT) AS VARCHAR)||':'||CAST(CAST(p.cy AS INT) AS VARCHAR)), ' ') AS points
FROM (SELECT event_id, list({'cx': cx, 'cy': cy}) OVER (PARTITION BY track_id ORDER BY frame ROWS 29 PRECEDING) AS l FROM fx_tracks)""")
def win01(spark, sf):
    t = T.track_history(fx.tracks(spark, sf), 30)
    text = F.array_join(F.transform("history", lambda p: F.concat(p["cx"].cast("int").cast("string"), F.lit(":"), p["cy"].cast("int").cast("string"))), " ")
    return t.select("event_id", F.size("history").alias("n"), text.alias("points"))


@query("win02_prev_position", f"SELECT event_id, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM fx_tracks {W}")
def win02(spark, sf):
    return T.prev_position(fx.tracks(spark, sf)).select("event_id", "px", "py")


@query("win03_speed_first", """
WITH g AS (SELECT *, frame*2+frame//3 AS f2 FROM fx_tracks), a AS (SELECT * FROM g WHERE frame=1), b AS (SELECT * FROM g WHERE frame=5)
SELECT a.track_id, b.f2 AS locked_frame, CAST(trunc(least(sqrt(pow(b.cx-a.cx,2)+pow(b.cy-a.cy,2))*0.05::DOUBLE/((b.f2-a.f2)/30)*3.6::DOUBLE,120)) AS INT) AS speed FROM a JOIN b USING (track_id)""")
def win03(spark, sf):
    t = fx.tracks(spark, sf).withColumn("f2", F.expr("frame*2 + frame div 3"))
    return T.speed_first(t, frame="f2")


@query("win04_rep_count", """
WITH e AS (SELECT *, CASE WHEN value<8 THEN 'down' WHEN value>20 THEN 'up' END AS kind FROM fx_tracks),
p AS (SELECT *, lag(kind IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame) AS was FROM e)
SELECT event_id, CAST(sum(CASE WHEN kind='down' AND was='up' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame) AS BIGINT) AS reps,
 coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame),'-') AS stage FROM p""")
def win04(spark, sf):
    return T.rep_count(fx.tracks(spark, sf), "value", 8, 20).select("event_id", "reps", "stage")


def cross_sql(hit, fwd):
    return f"""WITH p AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM fx_tracks {W}),
h AS (SELECT * FROM p WHERE px IS NOT NULL AND {hit} QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame)=1),
x AS (SELECT track_id, frame, CASE WHEN {fwd} THEN 'IN' ELSE 'OUT' END AS direction, cls_name FROM h)"""


LINE_HIT = "least(px,cx)<=320 AND greatest(px,cx)>=320"


@query("win05_crossing_line", cross_sql(LINE_HIT, "cx>px") + " SELECT * FROM x")
def win05(spark, sf):
    return T.crossing_events(fx.tracks(spark, sf), fx.LINE)


@query("win05_crossing_polygon", cross_sql(IN_RECT, "cy>py") + " SELECT * FROM x")
def win05_poly(spark, sf):
    return T.crossing_events(fx.tracks(spark, sf), fx.RECT)


@query("agg23_io_counts", cross_sql(LINE_HIT, "cx>px") + " SELECT cls_name, count(*) FILTER (direction='IN') AS n_in, count(*) FILTER (direction='OUT') AS n_out FROM x GROUP BY 1")
def agg23(spark, sf):
    return T.io_counts(T.crossing_events(fx.tracks(spark, sf), fx.LINE))


@query("win06_primary_track")
def win06(spark, sf):
    t = fx.tracks(spark, sf).select("source_id", "frame", "track_id", F.col("value").alias("activity"))
    return T.primary_track(t)


@query("win07_cooldown", """
WITH RECURSIVE v AS (SELECT track_id, CAST(floor(epoch(ts)/3600) AS BIGINT) AS frame FROM fx_tracks), c AS (SELECT track_id, min(frame) AS frame FROM v GROUP BY track_id
 UNION ALL SELECT c.track_id, (SELECT min(t.frame) FROM v t WHERE t.track_id=c.track_id AND t.frame>=c.frame+24) FROM c WHERE c.frame IS NOT NULL)
SELECT track_id, frame FROM c WHERE frame IS NOT NULL""")
def win07(spark, sf):
    return T.cooldown(fx.tracks(spark, sf).withColumn("frame", F.expr("unix_seconds(CAST(ts AS TIMESTAMP)) div 3600")), 24)


@query("win09_moving_average_zero", """
SELECT event_id, round(sum(value) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)/9,6) AS smooth FROM fx_tracks""")
def win09(spark, sf):
    return T.moving_average_zero(fx.tracks(spark, sf), "value", 9).select("event_id", r(F.col("smooth"), "smooth"))


@query("win10_sliding_sequences", """
WITH k AS (SELECT * FROM fx_tracks WHERE frame%2=0),
s AS (SELECT event_id, frame, list(CAST(cx AS INT)) OVER (PARTITION BY track_id ORDER BY frame ROWS 7 PRECEDING) AS l FROM k)
SELECT event_id, array_to_string(l,' ') AS xs, frame%8=0 AS classify FROM s WHERE len(l)=8""")
def win10(spark, sf):
    s = T.sliding_sequences(fx.tracks(spark, sf), 8, skip=2, overlap=0.5, value=F.col("cx").cast("int"))
    return s.select("event_id", F.array_join(F.transform("sequence", lambda v: v.cast("string")), " ").alias("xs"), "classify")


@query("win14_gaussian_smooth", """
WITH wt AS (SELECT d, exp(-0.5::DOUBLE*pow(d/3,2))/(SELECT sum(exp(-0.5::DOUBLE*pow(z/3,2))) FROM range(-12,13) q(z)) AS ww FROM range(-12,13) x(d)),
n AS (SELECT track_id, count(*) AS n FROM fx_tracks GROUP BY 1),
t AS (SELECT event_id, track_id, frame, n, d, ww, frame+d AS p FROM fx_tracks JOIN n USING (track_id) CROSS JOIN wt),
m AS (SELECT *, CASE WHEN p<1 THEN 1-p WHEN p>n THEN 2*n+1-p ELSE p END AS q FROM t)
SELECT m.event_id, round(sum(m.ww*v.value),5) AS smooth FROM m JOIN fx_tracks v ON v.track_id=m.track_id AND v.frame=m.q GROUP BY m.event_id""")
def win14(spark, sf):
    t = fx.tracks(spark, sf).select("track_id", "frame", "value", "event_id")
    n = t.groupBy("track_id").agg(F.count("*").alias("n"))
    s = T.gaussian_smooth(t.join(n, "track_id"), "value", ["track_id"], "frame", "n")
    return s.join(t, ["track_id", "frame"]).select("event_id", r(F.col("smooth"), "smooth", 5))


@query("win16_counter_rates", """
WITH c AS (SELECT event_id, track_id, frame, ts, CAST(frame*1000003*(1+track_id%7) AS BIGINT) AS read_bytes, CAST(abs((frame*7919)%4000-2000)*10000 AS BIGINT) AS sent_bytes FROM fx_tracks),
p AS (SELECT *, lag(ts) OVER w AS pt, lag(read_bytes) OVER w AS pr, lag(sent_bytes) OVER w AS ps FROM c WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, frame, round(greatest(0,(read_bytes-pr)/1048576/greatest(0.1::DOUBLE,(epoch_us(ts)-epoch_us(pt))/1e6)),3) AS read_bytes_mbs,
 round(greatest(0,(sent_bytes-ps)/1048576/greatest(0.1::DOUBLE,(epoch_us(ts)-epoch_us(pt))/1e6)),3) AS sent_bytes_mbs FROM p WHERE pt IS NOT NULL""")
def win16(spark, sf):
    c = fx.tracks(spark, sf).selectExpr("event_id", "track_id", "frame", "ts", "frame*1000003*(1+track_id%7) AS read_bytes",
                                        "abs((frame*7919)%4000-2000)*10000 AS sent_bytes")
    return T.counter_rates(c, ["track_id"], "frame", "ts", ["read_bytes", "sent_bytes"])


@query("win17_run_length_encode", """
WITH m AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v>0 THEN 1 ELSE 0 END) AS m FROM embeddings),
t AS (SELECT vec_id, m, list_concat(list_filter(range(1,len(m)), lambda i: m[i+1]<>m[i]),[len(m)]) AS e FROM m),
d AS (SELECT vec_id, m, list_transform(range(1,len(e)+1), lambda i: CAST(e[i]-CASE WHEN i>1 THEN e[i-1] ELSE 0 END AS VARCHAR)) AS c FROM t)
SELECT vec_id, array_to_string(CASE WHEN m[1]=1 THEN list_concat(['0'],c) ELSE c END,' ') AS counts FROM d""")
def win17(spark, sf):
    m = fx.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v > 0).cast("int")).alias("m"))
    return m.select("vec_id", F.array_join(F.transform(T.run_length_encode(F.col("m")), lambda v: v.cast("string")), " ").alias("counts"))


@query("win18_aspect_batches", """
WITH r AS (SELECT image_id, h/w AS ar, (row_number() OVER (ORDER BY h/w, image_id)-1)//16 AS batch FROM fx_images),
s AS (SELECT batch, min(ar) AS lo, max(ar) AS hi FROM r GROUP BY 1)
SELECT image_id, batch, CAST(ceil(CASE WHEN hi<1 THEN hi ELSE 1 END*640/32+0.5::DOUBLE)*32 AS BIGINT) AS batch_h, CAST(ceil(CASE WHEN lo>1 THEN 1/lo ELSE 1 END*640/32+0.5::DOUBLE)*32 AS BIGINT) AS batch_w
FROM r JOIN s USING (batch)""")
def win18(spark, sf):
    return T.aspect_batches(fx.images(spark, sf), 16, 640, 32)


@query("win19_contiguous_shards", """
WITH n AS (SELECT count(*) AS n, CAST(ceil(count(*)/16.0) AS BIGINT) AS nb FROM fx_images), r AS (SELECT image_id, (row_number() OVER (ORDER BY image_id)-1)//16 AS b FROM fx_images),
s AS (SELECT k, k*(nb//5)+least(k,nb%5) AS lo, k*(nb//5)+least(k,nb%5)+(nb//5)+CASE WHEN k<nb%5 THEN 1 ELSE 0 END AS hi FROM n CROSS JOIN range(5) x(k))
SELECT image_id, k AS shard FROM r JOIN s ON b>=lo AND b<hi""")
def win19(spark, sf):
    return T.contiguous_shards(fx.images(spark, sf), [F.col("image_id")], F.floor(F.col("image_id") / 4096), 5, 16).select("image_id", "shard")


@query("win21_track_life", """
WITH l AS (SELECT source_id, max(frame) AS m FROM fx_tracks GROUP BY 1)
SELECT source_id, track_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS length, any_value(m)-max(frame) AS lost_age FROM fx_tracks JOIN l USING (source_id) GROUP BY 1,2""")
def win21(spark, sf):
    return T.track_life(fx.tracks(spark, sf))


@query("win21_duplicate_tracks", f"""
WITH a AS (SELECT *, gt_id AS track_id, gt_id%9 AS life FROM fx_ground_truth), b AS (SELECT *, det_id AS track_id, det_id%7 AS life FROM fx_detections)
SELECT DISTINCT a.image_id, CASE WHEN a.life>b.life THEN b.track_id ELSE a.track_id END AS track_id, CASE WHEN a.life>b.life THEN 'lost' ELSE 'tracked' END AS side
FROM a JOIN b ON a.image_id=b.image_id AND 1-{iou_sql('a', 'b')}<0.15""")
def win21_dup(spark, sf):
    a = fx.ground_truth(spark, sf).selectExpr("image_id", "gt_id AS track_id", "gt_id%9 AS life", *XYXY)
    b = fx.detections(spark, sf).selectExpr("image_id", "det_id AS track_id", "det_id%7 AS life", *XYXY)
    return T.duplicate_tracks(a, b)


@query("agg22_class_counts", """
WITH p AS (SELECT source_id, frame, cls_name, count(*) AS n FROM fx_tracks GROUP BY 1,2,3)
SELECT *, CAST(sum(n) OVER (PARTITION BY source_id, frame) AS BIGINT) AS total, round(100.0::DOUBLE*n/sum(n) OVER (PARTITION BY source_id, frame),6) AS pct FROM p""")
def agg22(spark, sf):
    return T.class_counts(fx.tracks(spark, sf))["share"].withColumn("pct", F.round("pct", 6))


@query("agg22_line_points", """
SELECT source_id, frame, count(*) AS total FROM fx_tracks WHERE frame%3=0 GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY frame DESC)<=20""")
def agg22_line(spark, sf):
    return T.class_counts(fx.tracks(spark, sf), update_every=3, last=20)["shown"].select("source_id", "frame", "total")


ZONE_SQL = f"""SELECT source_id, frame, 'rect' AS region, count(*) FILTER ({IN_RECT}) AS n FROM fx_tracks GROUP BY 1,2
UNION ALL SELECT source_id, frame, 'concave', count(*) FILTER ({IN_CONCAVE}) FROM fx_tracks GROUP BY 1,2"""


@query("agg24_region_counts", ZONE_SQL)
def agg24(spark, sf):
    return T.region_counts(fx.tracks(spark, sf), REGIONS)


@query("agg24_region_counts_carry", f"""WITH z AS ({ZONE_SQL})
SELECT source_id, frame, region, coalesce(last_value(CASE WHEN n>0 THEN n END IGNORE NULLS) OVER (PARTITION BY source_id, region ORDER BY frame),0) AS n FROM z""")
def agg24_carry(spark, sf):
    return T.region_counts(fx.tracks(spark, sf), REGIONS, carry=True)


@query("agg25_queue_count", f"SELECT source_id, frame, count(*) FILTER ({IN_RECT} AND frame>1) AS queued FROM fx_tracks GROUP BY 1,2")
def agg25(spark, sf):
    return T.queue_count(fx.tracks(spark, sf), fx.RECT)


@query("agg26_heat", """
WITH b AS (SELECT image_id, CAST(trunc(x1) AS BIGINT) AS x0, CAST(trunc(y1) AS BIGINT) AS y0, CAST(trunc(x2) AS BIGINT) AS xe, CAST(trunc(y2) AS BIGINT) AS ye FROM fx_ground_truth),
c AS (SELECT *, least(xe-x0,ye-y0)//2 AS rad, (x0+xe)//2 AS mx, (y0+ye)//2 AS my FROM b),
y AS (SELECT *, unnest(range(greatest(y0,my-rad),least(ye,my+rad+1))) AS y FROM c),
s AS (SELECT *, CAST(floor(sqrt(rad*rad-(y-my)*(y-my))) AS BIGINT) AS rc FROM y),
p AS (SELECT image_id, y, unnest(range(greatest(x0,mx-rc),least(xe,mx+rc+1))) AS x FROM s),
g AS (SELECT image_id, x//16 AS gx, y//16 AS gy, 2*count(*) AS heat FROM p GROUP BY 1,2,3)
SELECT *, CAST(floor(heat*255.0::DOUBLE/max(heat) OVER (PARTITION BY image_id)) AS INT) AS level FROM g""")
def agg26(spark, sf):
    return T.normalize_heat(T.heat(fx.ground_truth(spark, sf), cell=16))


@query("agg30_activity_score", """
WITH s AS (SELECT track_id, max(value)/100 AS wr, arg_min(cx, frame) AS sx, arg_min(cy, frame) AS sy, arg_max(w, frame) AS bw, arg_max(h, frame) AS bh FROM fx_tracks GROUP BY 1)
SELECT t.track_id, round(2.5::DOUBLE*any_value(wr)+0.75::DOUBLE*max(sqrt(pow(cx-sx,2)+pow(cy-sy,2)))/sqrt(640*640+480*480)+0.15::DOUBLE*sqrt(any_value(bw)*any_value(bh)/307200),6) AS activity
FROM fx_tracks t JOIN s USING (track_id) GROUP BY 1""")
def agg30(spark, sf):
    t = fx.tracks(spark, sf).selectExpr("track_id", "frame", "cx", "cy", "w AS bw", "h AS bh", "value/100 AS wrist_energy")
    return T.activity_score(t, ["track_id"], 640, 480).withColumn("activity", F.round("activity", 6))


@query("set05_join_sub_tracks", """
WITH a AS (SELECT CASE WHEN source_id<2 THEN track_id ELSE -1-track_id END AS track_id, count(*) AS n FROM fx_tracks GROUP BY 1),
b AS (SELECT CASE WHEN cls_name='click' THEN track_id ELSE 1000000+track_id END AS track_id, -count(*) AS n FROM fx_tracks GROUP BY 1),
c AS (SELECT DISTINCT CASE WHEN cls_name='click' AND value>100 THEN track_id ELSE 2000000+track_id END AS track_id FROM fx_tracks)
SELECT track_id, n, 'joined' AS kind FROM a UNION ALL SELECT track_id, n, 'joined' FROM b WHERE track_id NOT IN (SELECT track_id FROM a)
UNION ALL SELECT track_id, n, 'rest' FROM a WHERE track_id NOT IN (SELECT track_id FROM c)""")
def set05(spark, sf):
    t = fx.tracks(spark, sf)
    a = t.groupBy(F.expr("CASE WHEN source_id<2 THEN track_id ELSE -1-track_id END").alias("track_id")).agg(F.count("*").alias("n"))
    b = t.groupBy(F.expr("CASE WHEN cls_name='click' THEN track_id ELSE 1000000+track_id END").alias("track_id")).agg((-F.count("*")).alias("n"))
    c = t.select(F.expr("CASE WHEN cls_name='click' AND value>100 THEN track_id ELSE 2000000+track_id END").alias("track_id")).distinct()
    return T.join_tracks(a, b).withColumn("kind", F.lit("joined")).unionByName(T.sub_tracks(a, c).withColumn("kind", F.lit("rest")))


@query("str08_alarm_once", """
SELECT source_id, frame, count(*) AS n FROM fx_tracks GROUP BY 1,2 HAVING count(*)>=10 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY frame)=1""")
def str08(spark, sf):
    return T.alarm_once(fx.tracks(spark, sf), 10)


@query("str14_latest_per_source", "SELECT source_id, frame, event_id FROM fx_tracks WHERE (source_id, frame) IN (SELECT (source_id, max(frame)) FROM fx_tracks GROUP BY source_id)")
def str14(spark, sf):
    return T.latest_per_source(fx.tracks(spark, sf)).select("source_id", "frame", "event_id")


@query("top08_every_nth_frame", """
SELECT event_id, frame%5=0 AS nth, rn<=round(0.3::DOUBLE*n) AS early FROM (SELECT event_id, frame, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS rn, count(*) OVER (PARTITION BY track_id) AS n FROM fx_tracks)""")
def top08(spark, sf):
    t = fx.tracks(spark, sf)
    n = t.groupBy("track_id").agg(F.count("*").alias("n"))
    return t.join(n, "track_id").select("event_id", (F.col("frame") % 5 == 0).alias("nth"), (F.col("frame") <= F.round(0.3 * F.col("n"))).alias("early"))


@query("fun06_mask_iou", """
WITH d AS (SELECT image_id, det_id AS a_id, CAST(y AS BIGINT)*640+CAST(greatest(0,x1) AS BIGINT) AS s, CAST(y AS BIGINT)*640+CAST(least(640,x2) AS BIGINT) AS e FROM (SELECT *, unnest(range(CAST(greatest(0,y1) AS BIGINT)//16, CAST(y2 AS BIGINT)//16)) AS y FROM fx_detections)),
g AS (SELECT image_id, gt_id AS b_id, CAST(y AS BIGINT)*640+CAST(x1 AS BIGINT) AS s, CAST(y AS BIGINT)*640+CAST(x2 AS BIGINT) AS e FROM (SELECT *, unnest(range(CAST(y1 AS BIGINT)//16, CAST(y2 AS BIGINT)//16)) AS y FROM fx_ground_truth)),
i AS (SELECT image_id, a_id, b_id, sum(least(d.e,g.e)-greatest(d.s,g.s)) AS inter FROM d JOIN g USING (image_id) WHERE least(d.e,g.e)>greatest(d.s,g.s) GROUP BY 1,2,3),
a AS (SELECT a_id, sum(e-s) AS aa FROM d GROUP BY 1), b AS (SELECT b_id, sum(e-s) AS ba FROM g GROUP BY 1)
SELECT image_id, a_id, b_id, round(inter/(aa+ba-inter+1e-7),6) AS iou FROM i JOIN a USING (a_id) JOIN b USING (b_id)""")
def fun06(spark, sf):
    def runs(d, name):
        rows = d.withColumn("y", F.explode(F.expr("sequence(CAST(greatest(0D,y1) AS BIGINT) div 16, (CAST(y2 AS BIGINT) div 16)-1)")))
        return rows.selectExpr("image_id", name, "y*640+CAST(greatest(0D,x1) AS BIGINT) AS start", "y*640+CAST(least(640D,x2) AS BIGINT) AS stop")

    a = runs(fx.detections(spark, sf).withColumnRenamed("det_id", "a_id"), "a_id")
    b = runs(fx.ground_truth(spark, sf).withColumnRenamed("gt_id", "b_id"), "b_id")
    return T.mask_iou(a, b, ["image_id"]).select("image_id", "a_id", "b_id", r(F.col("iou"), "iou"))


