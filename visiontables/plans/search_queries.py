"""Search, interpolation, trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiontables.operators import search as S
from visiontables.operators.nearest import knn
from visiontables.plans import fixtures as fx
from visiontables.plans.boxes_queries import r
from visiontables.registry import query


@query("joi17_knn", """
WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings CROSS JOIN range(1,65) q(i) GROUP BY 1,2),
u AS (SELECT label, list(v ORDER BY i) AS v FROM c GROUP BY 1), q AS (SELECT label AS query_id, list_transform(v, lambda x: x/sqrt(list_inner_product(v,v))) AS v FROM u),
s AS (SELECT query_id, vec_id AS item_id, list_inner_product(v, CAST(embedding AS DOUBLE[])) AS sim FROM q CROSS JOIN embeddings)
SELECT CAST(query_id AS BIGINT) AS query_id, item_id, round(sim,6) AS sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS INT) AS rank FROM s WHERE sim>=0.1 QUALIFY rank<=30""")
def joi17(spark, sf):
    """Each label's mean vector against all vectors."""
    e = fx.table(spark, sf, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    vec = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("l")).select("label", F.transform("l", lambda s: s["v"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    q = vec.select(F.col("label").cast("bigint").alias("query_id"), F.transform("v", lambda x: x / norm).alias("embedding"))
    return knn(q, e.select(F.col("vec_id").alias("item_id"), "embedding")).withColumn("sim", F.round("sim", 6))


@query("joi18_interp_join", """
WITH k AS (SELECT track_id, frame*2 AS x, value AS y FROM fx_tracks), g AS (SELECT track_id, CAST(frame*1.5 AS DOUBLE) AS x FROM fx_tracks),
a AS (SELECT g.*, k.x AS lx, k.y AS ly FROM g ASOF LEFT JOIN k ON g.track_id=k.track_id AND g.x>=k.x),
b AS (SELECT a.*, k.x AS rx, k.y AS ry FROM a ASOF LEFT JOIN k ON a.track_id=k.track_id AND a.x<k.x)
SELECT track_id, x, round(CASE WHEN lx IS NULL THEN ry WHEN rx IS NULL OR lx=x THEN ly ELSE ly+(ry-ly)/(rx-lx)*(x-lx) END,6) AS y FROM b""")
def joi18(spark, sf):
    t = fx.tracks(spark, sf)
    knots = t.selectExpr("track_id", "frame*2 AS x", "event_id AS tie", "value AS y")
    return S.interp_join(knots, t.selectExpr("track_id", "CAST(frame*1.5 AS DOUBLE) AS x"), ["track_id"], scale=1 / 4096).withColumn("y", F.round("y", 6))


@query("fun31_downsample_curve", """
WITH e AS (SELECT track_id, min(frame) AS lo, max(frame) AS hi FROM fx_tracks GROUP BY 1), g AS (SELECT track_id, lo+(hi-lo)*(i/20) AS x FROM e CROSS JOIN range(21) q(i)),
a AS (SELECT g.track_id, g.x, k.frame AS lx, k.value AS ly FROM g ASOF JOIN fx_tracks k ON g.track_id=k.track_id AND g.x>=k.frame),
b AS (SELECT a.*, k.frame AS rx, k.value AS ry FROM a ASOF LEFT JOIN fx_tracks k ON a.track_id=k.track_id AND a.x<k.frame)
SELECT track_id, round(x,6) AS x, round(CASE WHEN rx IS NULL OR lx=x THEN ly ELSE ly+(ry-ly)/(rx-lx)*(x-lx) END,6) AS y FROM b""")
def fun31(spark, sf):
    t = fx.tracks(spark, sf).selectExpr("track_id", "frame AS x", "value AS y")
    return S.downsample_curve(t, ["track_id"], 21, scale=1 / 4096).select("track_id", r(F.col("x"), "x"), r(F.col("y"), "y"))


TRIALS = "SELECT p_partkey AS iteration, CAST((p_partkey*7919)%1009-9 AS DOUBLE)/1000 AS fitness, p_size, p_retailprice FROM part"


def trials(spark, sf):
    return fx.table(spark, sf, "part").selectExpr("p_partkey AS iteration", "CAST((p_partkey*7919)%1009-9 AS DOUBLE)/1000 AS fitness", "p_size", "p_retailprice")


@query("agg36_speed_summary", "SELECT event_type AS stage, round(avg(value),6) AS mean_ms, count(*) AS images, round(1000/avg(value),6) AS fps FROM events GROUP BY 1")
def agg36(spark, sf):
    e = fx.table(spark, sf, "events").withColumnRenamed("event_type", "stage")
    return S.speed_summary(e, "stage", "value").select("stage", r(F.col("mean_ms"), "mean_ms"), "images", r(F.col("fps"), "fps"))


def clip_sql(sigma, lower):
    def rnd(src, dst):
        cond = f"value>=m-{sigma}*d" if lower else f"value>m-{sigma}*d AND value<m+{sigma}*d"
        return f"{dst} AS (SELECT event_id, event_type, value FROM {src} JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS d FROM {src} GROUP BY 1) USING (event_type) WHERE {cond})"
    return f"WITH {rnd('events', 'a')}, {rnd('a', 'b')}, {rnd('b', 'c')} SELECT event_id FROM c"


@query("agg37_sigma_clip", clip_sql(2, False))
def agg37(spark, sf):
    return S.sigma_clip(fx.table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id")


@query("agg37_sigma_clip_lower", clip_sql(1, True))
def agg37_lower(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", "event_type", "value")
    return S.sigma_clip(e, ["event_type"], "value", sigma=1, lower_only=True).select("event_id")


@query("agg38_top_trials", f"WITH t AS ({TRIALS}) SELECT iteration, fitness FROM t WHERE fitness>0 ORDER BY fitness DESC, iteration LIMIT 5")
def agg38(spark, sf):
    return S.top_trials(trials(spark, sf), 5).select("iteration", "fitness")


@query("agg38_best_trial", f"WITH t AS ({TRIALS}) SELECT iteration, fitness, p_size, p_retailprice FROM t ORDER BY fitness DESC, iteration LIMIT 1")
def agg38_best(spark, sf):
    return S.best_trial(trials(spark, sf))


@query("agg39_crossover_bounds", f"""WITH t AS ({TRIALS}), k AS (SELECT * FROM t ORDER BY fitness DESC, iteration LIMIT 9),
l AS (SELECT 'p_size' AS param, CAST(p_size AS DOUBLE) AS v FROM k UNION ALL SELECT 'p_retailprice', p_retailprice FROM k), b AS (SELECT param, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1)
SELECT param, lo, hi, round(hi-lo,6) AS span, round(lo-0.2::DOUBLE*(hi-lo),6) AS low, round(hi+0.2::DOUBLE*(hi-lo),6) AS high FROM b""")
def agg39(spark, sf):
    b = S.crossover_bounds(trials(spark, sf), ["p_size", "p_retailprice"])
    return b.select("param", "lo", "hi", r(F.col("span"), "span"), r(F.col("low"), "low"), r(F.col("high"), "high"))
