"""Confusion, curves, average precision and score statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiontables.operators import evaluate as E
from visiontables.operators import match as M
from visiontables.operators import runs as RU
from visiontables.operators.stages import materialize
from visiontables.plans import fixtures as fx
from visiontables.plans.boxes_queries import r
from visiontables.plans.matching_queries import CONF_SQL, MATCH_SQL
from visiontables.registry import query

NAMES = ["alpha", "Beta", "beta", "gam ma", "delta", "background"]


def tp_table(spark, sf):
    d, g = fx.detections(spark, sf), fx.ground_truth(spark, sf)
    return materialize(M.true_positive_table(d, M.match_for_ap(M.match_candidates(d, g))), "hits")


def pr_table(spark, sf):
    return E.precision_recall(tp_table(spark, sf), totals(spark, sf))


def totals(spark, sf):
    return E.class_totals(fx.ground_truth(spark, sf))


def confusion(spark, sf):
    d, g = fx.detections(spark, sf), fx.ground_truth(spark, sf)
    return E.confusion_matrix(d, g, M.match_for_confusion(d, g), nc=5)


@query("agg04_binary_stats", """
WITH c AS (SELECT technique, count(*) FILTER (is_correct AND score>=50) AS tp, count(*) FILTER (NOT is_correct AND score>=50) AS fp,
 count(*) FILTER (NOT is_correct AND score<50) AS tn, count(*) FILTER (is_correct AND score<50) AS fn FROM fx_run_metrics GROUP BY technique),
p AS (SELECT *, tp/greatest(tp+fp,1) AS precision, tp/greatest(tp+fn,1) AS recall, tn/greatest(tn+fp,1) AS tnr FROM c)
SELECT technique, tp, fp, tn, fn, round((tp+tn)/greatest(tp+fp+tn+fn,1),6) AS accuracy, round(precision,6) AS precision, round(recall,6) AS recall,
 round(CASE WHEN precision+recall>0 THEN 2*precision*recall/(precision+recall) ELSE 0 END,6) AS f1, round(0.5::DOUBLE*(recall+tnr),6) AS balanced_accuracy FROM p""")
def agg04(spark, sf):
    out = E.binary_stats(fx.run_metrics(spark, sf), ["technique"], F.col("score"), F.col("is_correct"), F.lit(50.0))
    return out.select("technique", "tp", "fp", "tn", "fn", *[r(F.col(c), c) for c in ("accuracy", "precision", "recall", "f1", "balanced_accuracy")])


@query("agg05_calibrate_threshold", """
WITH s AS (SELECT technique, score, event_id%2=0 AS ok FROM fx_run_metrics),
c AS (SELECT DISTINCT technique, score AS thr FROM s UNION SELECT DISTINCT technique, 0.0 FROM s UNION SELECT DISTINCT technique, 100.0 FROM s),
v AS (SELECT technique, score, count(*) FILTER (ok) AS pos, count(*) FILTER (NOT ok) AS neg FROM s GROUP BY 1,2),
u AS (SELECT c.technique, c.thr, coalesce(pos,0) AS pos, coalesce(neg,0) AS neg FROM c LEFT JOIN v ON v.technique=c.technique AND v.score=c.thr),
k AS (SELECT technique, thr, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
 CAST(sum(pos) OVER (PARTITION BY technique) AS BIGINT) AS np, CAST(sum(neg) OVER (PARTITION BY technique) AS BIGINT) AS nn FROM u WINDOW w AS (PARTITION BY technique ORDER BY thr DESC)),
q AS (SELECT *, tp/greatest(tp+fp,1) AS pr, tp/greatest(np,1) AS rc, (nn-fp)/greatest(nn,1) AS tnr, (tp+nn-fp)/greatest(np+nn,1) AS acc FROM k),
z AS (SELECT *, CASE WHEN pr+rc>0 THEN 2.0::DOUBLE*pr*rc/(pr+rc) ELSE 0 END AS f1, 0.5::DOUBLE*(rc+tnr) AS ba FROM q)
SELECT technique, thr AS threshold, 'calibrated' AS status, CAST(NULL AS VARCHAR) AS reason, round(f1,6) AS f1, round(ba,6) AS balanced_accuracy, np AS n_correct, nn AS n_incorrect
FROM z QUALIFY row_number() OVER (PARTITION BY technique ORDER BY f1 DESC, ba DESC, pr DESC, acc DESC, thr)=1""")
def agg05(spark, sf):
    d = fx.run_metrics(spark, sf).withColumn("ok", F.expr("event_id%2=0"))
    out = E.calibrate_threshold(d, "technique", "score", "ok", 60.0)
    return out.withColumn("f1", F.round("f1", 6)).withColumn("balanced_accuracy", F.round("balanced_accuracy", 6))


MATRIX_SQL = CONF_SQL + """, m AS (SELECT pred, actual FROM k UNION ALL
 SELECT cls, 5 FROM fx_detections WHERE conf>0.25 AND det_id NOT IN (SELECT det_id FROM k) UNION ALL
 SELECT 5, cls FROM fx_ground_truth WHERE gt_id NOT IN (SELECT gt_id FROM k)),
x AS (SELECT pred, actual, count(*) AS n FROM m GROUP BY 1,2)"""


@query("agg06_confusion_matrix", "WITH " + MATRIX_SQL + " SELECT pred, actual, n FROM x")
def agg06(spark, sf):
    return confusion(spark, sf)


@query("agg07_confusion_classify", """
SELECT CAST(vec_id%10 AS INT) AS pred, label AS actual, count(*) AS n FROM embeddings GROUP BY 1,2""")
def agg07(spark, sf):
    d = fx.table(spark, sf, "embeddings").selectExpr("CAST(vec_id%10 AS INT) AS p", "label")
    return E.confusion_classify(d, "p", "label")


CLEAN = ["alpha", "Beta", "beta_1", "gam_ma", "delta", "background"]


@query("agg08_confusion_summary", "WITH " + MATRIX_SQL + ", t AS (SELECT actual, sum(n) AS t FROM x GROUP BY 1), p AS (SELECT unnest(range(6)) AS pred) SELECT CASE p.pred "
       + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLEAN)) + " END AS Predicted, "
       + ", ".join(f"round(coalesce(max(CASE WHEN x.actual={i} THEN n/(t+1e-9) END),0),5) AS {c}" for i, c in enumerate(CLEAN))
       + " FROM p LEFT JOIN x ON x.pred=p.pred LEFT JOIN t ON t.actual=x.actual GROUP BY p.pred")
def agg08(spark, sf):
    return E.confusion_summary(confusion(spark, sf), NAMES, normalize=True)


@query("agg09_tp_fp", "WITH " + MATRIX_SQL + " SELECT pred AS cls, CAST(sum(CASE WHEN pred=actual THEN n ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN pred<>actual THEN n ELSE 0 END) AS BIGINT) AS fp FROM x WHERE pred<5 GROUP BY 1")
def agg09(spark, sf):
    return E.tp_fp(confusion(spark, sf), 5)


PR_SQL = MATCH_SQL + """,
n AS (SELECT cls, count(*) AS n_l, count(DISTINCT image_id) AS n_images FROM fx_ground_truth GROUP BY cls),
f AS (SELECT d.det_id, d.cls, d.conf, CAST(i AS INT) AS thr, CASE WHEN m.det_id IS NULL THEN 0 ELSE 1 END AS tp FROM fx_detections d CROSS JOIN t LEFT JOIN m ON m.det_id=d.det_id AND m.thr=t.i),
pr AS (SELECT f.*, n_l, row_number() OVER w AS rank, sum(tp) OVER w AS tpc FROM f JOIN n USING (cls) WINDOW w AS (PARTITION BY cls, thr ORDER BY conf DESC, det_id ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, tpc/rank AS precision, tpc/n_l AS recall FROM pr),
e AS (SELECT *, max(precision) OVER (PARTITION BY cls, thr ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM q)"""


@query("agg10_precision_recall_curve", "WITH " + PR_SQL + " SELECT cls, det_id, rank, CAST(tpc AS BIGINT) AS tpc, round(precision,6) AS precision, round(recall,6) AS recall, round(env,6) AS env FROM e WHERE thr=0")
def agg10(spark, sf):
    env = E.precision_envelope(pr_table(spark, sf))
    return env.select("cls", "det_id", "rank", F.col("tpc")[0].alias("tpc"), r(F.col("precision")[0], "precision"), r(F.col("recall")[0], "recall"), r(F.col("env")[0], "env"))


AP_SQL = PR_SQL + """, kn AS (SELECT cls, thr, recall AS x, env AS y, rank FROM e UNION ALL SELECT DISTINCT cls, thr, 0, 1, 0 FROM e UNION ALL SELECT DISTINCT cls, thr, 1, 0, 99999999999 FROM e),
lf AS (SELECT cls, thr, x, arg_max(y, rank) AS y FROM kn GROUP BY 1,2,3), rt AS (SELECT cls, thr, x, arg_min(y, rank) AS y FROM kn GROUP BY 1,2,3),
gr AS (SELECT DISTINCT cls, thr, g, g/100 AS gx FROM e CROSS JOIN range(101) z(g)),
a1 AS (SELECT gr.*, lf.x AS lx, lf.y AS ly FROM gr ASOF JOIN lf ON gr.cls=lf.cls AND gr.thr=lf.thr AND gr.gx>=lf.x),
a2 AS (SELECT a1.*, rt.x AS rx, rt.y AS ry FROM a1 ASOF LEFT JOIN rt ON a1.cls=rt.cls AND a1.thr=rt.thr AND a1.gx<rt.x),
a3 AS (SELECT cls, thr, g, CASE WHEN rx IS NULL OR lx=gx THEN ly ELSE ly+(ry-ly)/(rx-lx)*(gx-lx) END AS y FROM a2),
ap AS (SELECT cls, thr, sum(y*CASE WHEN g IN (0,100) THEN 0.005::DOUBLE ELSE 0.01::DOUBLE END) AS ap FROM a3 GROUP BY 1,2)"""


def envelope(spark, sf):
    return E.precision_envelope(pr_table(spark, sf))


@query("agg11_average_precision", "WITH " + AP_SQL + " SELECT cls, thr, round(ap,6) AS ap FROM ap")
def agg11(spark, sf):
    return E.average_precision(envelope(spark, sf)).withColumn("ap", F.round("ap", 6))


@query("agg12_continuous_ap", "WITH " + PR_SQL + " SELECT cls, thr, round(sum(tp*env/n_l),6) AS ap FROM e GROUP BY 1,2")
def agg12(spark, sf):
    return E.continuous_ap(envelope(spark, sf)).withColumn("ap", F.round("ap", 6))


CURVE_SQL = AP_SQL + """, ck AS (SELECT cls, conf, rank, precision, recall FROM e WHERE thr=0),
cg AS (SELECT DISTINCT cls, g, g/999 AS gx FROM ck CROSS JOIN range(1000) z(g)),
c1 AS (SELECT cg.*, ck.conf AS lx, ck.precision AS lp, ck.recall AS lr FROM cg ASOF LEFT JOIN ck ON cg.cls=ck.cls AND cg.gx<=ck.conf),
c2 AS (SELECT c1.*, ck.conf AS rx, ck.precision AS rp, ck.recall AS rr FROM c1 ASOF LEFT JOIN ck ON c1.cls=ck.cls AND c1.gx>ck.conf),
cv AS (SELECT cls, g AS i, gx AS px, CASE WHEN lx IS NULL THEN 1 WHEN rx IS NULL THEN lp ELSE lp+(rp-lp)*(lx-gx)/(lx-rx) END AS p,
 CASE WHEN lx IS NULL THEN 0 WHEN rx IS NULL THEN lr ELSE lr+(rr-lr)*(lx-gx)/(lx-rx) END AS r FROM c2),
cf AS (SELECT *, 2*p*r/(p+r+1e-16) AS f1 FROM cv), mn AS (SELECT i, sum(f1)/(SELECT count(*) FROM n) AS m FROM cf GROUP BY i),
sm AS (SELECT a.i, (SELECT sum(coalesce(b.m, 0)) FROM range(-50,51) o(o) JOIN mn b ON b.i=greatest(0,least(999,a.i+o.o)))/101 AS s FROM mn a),
pk AS (SELECT arg_min(i, (-round(s,12), i)) AS i FROM sm),
atp AS (SELECT n.cls, n.n_l, n.n_images, coalesce(p,0) AS p, coalesce(r,0) AS r, coalesce(f1,0) AS f1 FROM n LEFT JOIN (SELECT * FROM cf WHERE i=(SELECT i FROM pk)) USING (cls)),
pc AS (SELECT atp.*, round_even(r*n_l,0) AS tp, round_even(round_even(r*n_l,0)/(p+1e-16)-round_even(r*n_l,0),0) AS fp, coalesce(ap50,0) AS ap50, coalesce(ap75,0) AS ap75, coalesce(apm,0) AS ap
 FROM atp LEFT JOIN (SELECT cls, max(CASE WHEN thr=0 THEN ap END) AS ap50, max(CASE WHEN thr=5 THEN ap END) AS ap75, avg(ap) AS apm FROM ap GROUP BY cls) USING (cls))"""


@query("agg13_confidence_curves", "WITH " + CURVE_SQL + " SELECT cls, i, round(px,6) AS px, round(p,5) AS p, round(r,5) AS r, round(f1,5) AS f1 FROM cf")
def agg13_curves(spark, sf):
    c = E.confidence_curves(pr_table(spark, sf))
    return c.select("cls", F.col("i").cast("bigint").alias("i"), r(F.col("px"), "px"), r(F.col("p"), "p", 5), r(F.col("r"), "r", 5), r(F.col("f1"), "f1", 5))


def per_class(spark, sf):
    d, g = fx.detections(spark, sf), fx.ground_truth(spark, sf)
    return E.ap_per_class(M.true_positive_table(d, M.match_for_ap(M.match_candidates(d, g))), totals(spark, sf))


@query("agg13_ap_per_class", "WITH " + CURVE_SQL + " SELECT cls, n_l, round(p,5) AS p, round(r,5) AS r, round(f1,5) AS f1, tp, fp, round(ap50,5) AS ap50, round(ap75,5) AS ap75, round(ap,5) AS ap FROM pc")
def agg13(spark, sf):
    out = per_class(spark, sf)
    return out.select("cls", "n_l", *[r(F.col(c), c, 5) for c in ("p", "r", "f1")], "tp", "fp", *[r(F.col(c), c, 5) for c in ("ap50", "ap75", "ap")])


@query("agg14_detection_metrics", "WITH " + CURVE_SQL + " SELECT round(avg(p),5) AS mp, round(avg(r),5) AS mr, round(avg(ap50),5) AS map50, round(avg(ap75),5) AS map75, round(avg(ap),5) AS map, round(avg(ap),5) AS fitness FROM pc")
def agg14(spark, sf):
    return E.detection_metrics(per_class(spark, sf)).select(*[r(F.col(c), c, 5) for c in ("mp", "mr", "map50", "map75", "map", "fitness")])


@query("agg15_metrics_summary", "WITH " + CURVE_SQL + " SELECT coalesce(CAST(cls AS VARCHAR),'all') AS class, CASE WHEN grouping(cls)=1 THEN (SELECT count(DISTINCT image_id) FROM fx_ground_truth) ELSE max(n_images) END AS images, CAST(sum(n_l) AS BIGINT) AS instances, round(avg(p),5) AS p, round(avg(r),5) AS r, round(avg(f1),5) AS f1, round(avg(ap50),5) AS map50, round(avg(ap),5) AS map FROM pc GROUP BY ROLLUP(cls)")
def agg15(spark, sf):
    g = fx.ground_truth(spark, sf)
    images = totals(spark, sf).select("cls", "n_images")
    every = g.agg(F.count_distinct("image_id")).scalar()
    rows = per_class(spark, sf).join(images, "cls").rollup("cls").agg(
        F.max("n_images").alias("n_images"), F.sum("n_l").alias("instances"), *[r(F.avg(c), c, 5) for c in ("p", "r", "f1")],
        r(F.avg("ap50"), "map50", 5), r(F.avg("ap"), "map", 5), F.grouping("cls").alias("is_all"))
    return rows.select(
        F.coalesce(F.col("cls").cast("string"), F.lit("all")).alias("class"),
        F.when(F.col("is_all") == 1, every).otherwise(F.col("n_images")).alias("images"), "instances", "p", "r", "f1", "map50", "map")


@query("agg17_topk_accuracy", """
WITH r AS (SELECT label, list_transform(list_grade_up(list_transform(embedding, lambda v: -v)), lambda i: i-1) AS ranked FROM embeddings),
a AS (SELECT avg(CASE WHEN ranked[1]=label THEN 1 ELSE 0 END) AS t1, avg(CASE WHEN list_contains(ranked[1:5], label) THEN 1 ELSE 0 END) AS t5 FROM r)
SELECT round(t1,6) AS top1, round(t5,6) AS top5, round((t1+t5)/2,6) AS fitness FROM a""")
def agg17(spark, sf):
    ranked = F.transform(F.array_sort(F.transform("embedding", lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), lambda s: s["i"])
    d = fx.table(spark, sf, "embeddings").select("label", ranked.alias("ranked"))
    return E.topk_accuracy(d, "ranked", "label").select(*[r(F.col(c), c) for c in ("top1", "top5", "fitness")])


@query("win08_box_smooth", "WITH " + CURVE_SQL + " SELECT i, round(s,5) AS smooth FROM sm")
def win08(spark, sf):
    c = E.confidence_curves(pr_table(spark, sf))
    n = totals(spark, sf).agg(F.count("*")).scalar()
    mean = c.groupBy("i").agg(F.sum("f1").alias("s")).select("i", (F.col("s") / n).alias("m"))
    return E.box_smooth(mean, "m").select(F.col("i").cast("bigint").alias("i"), r(F.col("smooth"), "smooth", 5))


@query("win15_rank_by_confidence", "SELECT det_id, row_number() OVER (PARTITION BY cls ORDER BY conf DESC, det_id) AS rank FROM fx_detections")
def win15(spark, sf):
    from visiontables.operators.ordered import rank_parts
    return rank_parts(fx.detections(spark, sf), ["cls"], [F.col("conf").desc(), F.col("det_id").asc()], "rank").select("det_id", "rank")


# --- run metrics -------------------------------------------------------------------------------------------------

RUN_SQL = """
WITH a AS (SELECT run_id, count(*) AS rows, count(*) FILTER (is_correct) AS correct, avg(score) AS sm, stddev_pop(score) AS ss, min(score) AS mn, max(score) AS mx,
 avg(score_threshold) AS tm, avg(cosine_similarity) AS cm FROM fx_run_metrics GROUP BY run_id),
g AS (SELECT run_id, reference_angle, count(*) AS c, min(event_id) AS p FROM fx_run_metrics WHERE trim(reference_angle)<>'' GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY c DESC, p)=1),
f AS (SELECT run_id, feedback_1, count(*) AS c, min(event_id) AS p FROM fx_run_metrics WHERE trim(feedback_1)<>'' GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY c DESC, p)=1)
SELECT a.run_id, rows, correct, round(100.0::DOUBLE*correct/rows,6) AS accuracy_pct, round(sm,6) AS score_mean, round(ss,6) AS score_std, mn AS score_min, mx AS score_max,
 round(tm,6) AS threshold_mean, round(cm,6) AS cosine_mean, g.reference_angle AS top_reference_angle, g.c AS top_reference_angle_count, f.feedback_1 AS top_feedback_1, f.c AS top_feedback_1_count
FROM a LEFT JOIN g USING (run_id) LEFT JOIN f USING (run_id)"""


def run_summary(spark, sf):
    return RU.run_summary(fx.run_metrics(spark, sf), position="event_id", means={"score_threshold": "threshold_mean", "cosine_similarity": "cosine_mean"},
                          tops={"reference_angle": "top_reference_angle", "feedback_1": "top_feedback_1"})


@query("agg01_run_summary", RUN_SQL)
def agg01(spark, sf):
    out = run_summary(spark, sf)
    return out.select("run_id", "rows", "correct", *[r(F.col(c), c) for c in ("accuracy_pct", "score_mean", "score_std")], "score_min", "score_max",
                      *[r(F.col(c), c) for c in ("threshold_mean", "cosine_mean")], "top_reference_angle", "top_reference_angle_count", "top_feedback_1", "top_feedback_1_count")


@query("agg02_top_value", """
SELECT technique, trim(feedback_1) AS feedback_1, count(*) AS n FROM fx_run_metrics WHERE trim(feedback_1)<>'' GROUP BY 1,2
QUALIFY row_number() OVER (PARTITION BY technique ORDER BY count(*) DESC, min(event_id))=1""")
def agg02(spark, sf):
    return RU.top_value(fx.run_metrics(spark, sf), ["technique"], "feedback_1", "event_id", "feedback_1", "n")


@query("agg03_score_boxplot", """
WITH q AS (SELECT technique, run_id, quantile_cont(score,0.25) AS q1, quantile_cont(score,0.5) AS med, quantile_cont(score,0.75) AS q3, count(*) AS n FROM fx_run_metrics GROUP BY 1,2)
SELECT q.technique, q.run_id, n, round(q1,6) AS q1, round(med,6) AS median, round(q3,6) AS q3,
 min(score) FILTER (score>=q1-1.5::DOUBLE*(q3-q1)) AS whisker_low, max(score) FILTER (score<=q3+1.5::DOUBLE*(q3-q1)) AS whisker_high,
 count(*) FILTER (score<q1-1.5::DOUBLE*(q3-q1) OR score>q3+1.5::DOUBLE*(q3-q1)) AS outliers
FROM fx_run_metrics m JOIN q USING (technique, run_id) GROUP BY q.technique, q.run_id, n, q1, med, q3""")
def agg03(spark, sf):
    return RU.score_boxplot(fx.run_metrics(spark, sf), ["technique", "run_id"], "score").select(
        "technique", "run_id", "n", r(F.col("q1"), "q1"), r(F.col("median"), "median"), r(F.col("q3"), "q3"), "whisker_low", "whisker_high", "outliers")


@query("agg40_group_compare", """
SELECT CAST(track_id%3 AS BIGINT) AS performer, technique, count(*) AS windows, count(*) FILTER (is_correct) AS accepted, round(100.0::DOUBLE*count(*) FILTER (is_correct)/count(*),6) AS acceptance_pct,
 round(avg(score),6) AS score_mean, round(stddev_pop(score),6) AS score_std FROM fx_run_metrics GROUP BY 1,2""")
def agg40(spark, sf):
    d = fx.run_metrics(spark, sf).withColumn("performer", F.expr("CAST(track_id%3 AS BIGINT)"))
    return RU.group_compare(d, ["performer", "technique"]).select("performer", "technique", "windows", "accepted",
                                                                  *[r(F.col(c), c) for c in ("acceptance_pct", "score_mean", "score_std")])


@query("top01_top_runs", """WITH s AS (SELECT run_id, 100.0::DOUBLE*count(*) FILTER (is_correct)/count(*) AS a FROM fx_run_metrics GROUP BY 1)
SELECT run_id, round(a,6) AS accuracy_pct FROM s ORDER BY a DESC, run_id LIMIT 5""")
def top01(spark, sf):
    return RU.top_runs(run_summary(spark, sf), 5).select("run_id", r(F.col("accuracy_pct"), "accuracy_pct"))


@query("set06_union_runs", """SELECT 'first' AS group_name, run_id, score FROM fx_run_metrics WHERE track_id%2=0 UNION ALL SELECT 'second', run_id, score FROM fx_run_metrics WHERE track_id%2=1""")
def set06(spark, sf):
    m = fx.run_metrics(spark, sf).select("run_id", "score", "track_id")
    parts = {"first": m.where("track_id%2=0").drop("track_id"), "second": m.where("track_id%2=1").drop("track_id")}
    return RU.union_runs(parts)


# --- other tasks: the same chain over other overlaps -------------------------------------------------------------

def task_sql(candidates: str) -> str:
    """Per-class AP over another candidate list named c(det_id, conf, cls, gt_id, ov)."""
    return "WITH " + candidates + AP_SQL[AP_SQL.index("\nb AS ("):] + " SELECT cls, round(max(CASE WHEN thr=0 THEN ap END),5) AS ap50, round(avg(ap),5) AS ap FROM ap GROUP BY 1"


def task_ap(candidates, dets, spark, sf):
    hits = materialize(M.true_positive_table(dets, M.match_for_ap(candidates)), "hits")
    env = E.precision_envelope(E.precision_recall(hits, totals(spark, sf)))
    ap = E.average_precision(env)
    return ap.groupBy("cls").agg(r(F.max(F.when(F.col("thr") == 0, F.col("ap"))), "ap50", 5), r(F.avg("ap"), "ap", 5))


OBB_GT = "SELECT gt_id, image_id, cls, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, x2-x1 AS w, y2-y1 AS h, CAST((2*gt_id)%628 AS DOUBLE)/100-1.5 AS theta FROM fx_ground_truth"
COV = "w*w/12*cos(theta)*cos(theta)+h*h/12*sin(theta)*sin(theta) AS a, w*w/12*sin(theta)*sin(theta)+h*h/12*cos(theta)*cos(theta) AS b, (w*w/12-h*h/12)*cos(theta)*sin(theta) AS c"


@query("agg16_oriented_ap", task_sql(f"""dd AS (SELECT *, {COV} FROM fx_obb), gg AS (SELECT *, {COV} FROM ({OBB_GT})),
pp AS (SELECT x.det_id, x.conf, x.cls, y.gt_id, x.cx-y.cx AS dx, x.cy-y.cy AS dy, x.a+y.a AS a, x.b+y.b AS b, x.c+y.c AS c, sqrt(greatest(x.a*x.b-x.c*x.c,0)*greatest(y.a*y.b-y.c*y.c,0)) AS g FROM dd x JOIN gg y USING (image_id, cls)),
qq AS (SELECT *, a*b-c*c AS det FROM pp),
c AS (SELECT det_id, conf, cls, gt_id, 1-sqrt(1-exp(-least(greatest((a*dy*dy+b*dx*dx)/(det+1e-7)*0.25-(c*dx*dy)/(det+1e-7)*0.5+ln(det/(4*g+1e-7)+1e-7)*0.5,1e-7),100))+1e-7) AS ov FROM qq),"""))
def agg16_obb(spark, sf):
    g = fx.ground_truth(spark, sf).selectExpr("gt_id", "image_id", "cls", "(x1+x2)/2 AS cx", "(y1+y2)/2 AS cy", "x2-x1 AS w", "y2-y1 AS h",
                                              "CAST((2*gt_id)%628 AS DOUBLE)/100-CAST(1.5 AS DOUBLE) AS theta")
    d = fx.obb(spark, sf)
    return task_ap(M.oriented_candidates(d, g), d, spark, sf)


JOINTS_SQL = "list_transform(range(0,17), lambda j: {{'x': x1+(x2-x1)*((j*7)%17)/17, 'y': y1+(y2-y1)*((j*5)%17)/17, 'c': CASE WHEN ({key}+j)%4=0 THEN 0 ELSE 1 END}})"
SIG = "[" + ",".join(str(v) for v in (26, 25, 25, 35, 35, 79, 79, 72, 72, 62, 62, 107, 107, 87, 87, 89, 89)) + "]"


@query("agg16_pose_ap", task_sql(f"""dd AS (SELECT *, {JOINTS_SQL.format(key='det_id')} AS k FROM fx_detections), gg AS (SELECT *, {JOINTS_SQL.format(key='gt_id')} AS k, (x2-x1)*(y2-y1)*0.53::DOUBLE AS area FROM fx_ground_truth),
c AS (SELECT d.det_id, d.conf, d.cls, g.gt_id, list_sum(list_transform(range(1,18), lambda j: CASE WHEN g.k[j].c<>0 THEN exp(-(pow(g.k[j].x-d.k[j].x,2)+pow(g.k[j].y-d.k[j].y,2))/(4*pow({SIG}[j]/1000,2)*(g.area+1e-7)*2)) ELSE 0 END))/(len(list_filter(g.k, lambda p: p.c<>0))+1e-7) AS ov
 FROM dd d JOIN gg g USING (image_id, cls)),"""))
def agg16_pose(spark, sf):
    def joints(key):
        return lambda p: F.expr(f"transform(sequence(0,16), j -> named_struct('x', {p}x1+({p}x2-{p}x1)*((j*7)%17)/17, 'y', {p}y1+({p}y2-{p}y1)*((j*5)%17)/17, 'c', CASE WHEN ({p}{key}+j)%4=0 THEN 0D ELSE 1D END))")

    d = fx.detections(spark, sf)
    return task_ap(M.pose_candidates(d, fx.ground_truth(spark, sf), joints=(joints("det_id"), joints("gt_id"))), d, spark, sf)


def mask_sql(table, key):
    return f"SELECT image_id, cls, {key}, y*640+CAST(greatest(0,x1) AS BIGINT) AS s, y*640+CAST(least(640,x2) AS BIGINT) AS e FROM (SELECT *, unnest(range(CAST(greatest(0,y1) AS BIGINT)//16, CAST(y2 AS BIGINT)//16)) AS y FROM {table})"


@query("agg16_segment_ap", task_sql(f"""dd AS ({mask_sql('fx_detections', 'det_id')}), gg AS ({mask_sql('fx_ground_truth', 'gt_id')}),
ii AS (SELECT det_id, gt_id, cls, sum(least(dd.e,gg.e)-greatest(dd.s,gg.s)) AS inter FROM dd JOIN gg USING (image_id, cls) WHERE least(dd.e,gg.e)>greatest(dd.s,gg.s) GROUP BY 1,2,3),
aa AS (SELECT det_id, sum(e-s) AS aa FROM dd GROUP BY 1), ba AS (SELECT gt_id, sum(e-s) AS ba FROM gg GROUP BY 1),
c AS (SELECT det_id, conf, ii.cls, gt_id, inter/(aa+ba-inter+1e-7) AS ov FROM ii JOIN aa USING (det_id) JOIN ba USING (gt_id) JOIN (SELECT det_id, conf FROM fx_detections) USING (det_id)),"""))
def agg16_segment(spark, sf):
    from visiontables.operators import tracks as T

    def runs(d, key, out):
        rows = d.withColumn("y", F.explode(F.expr("sequence(CAST(greatest(0D,y1) AS BIGINT) div 16, (CAST(y2 AS BIGINT) div 16)-1)")))
        return rows.selectExpr("image_id", "cls", f"{key} AS {out}", "y*640+CAST(greatest(0D,x1) AS BIGINT) AS start", "y*640+CAST(least(640D,x2) AS BIGINT) AS stop")

    d = fx.detections(spark, sf)
    ious = T.mask_iou(runs(d, "det_id", "a_id"), runs(fx.ground_truth(spark, sf), "gt_id", "b_id"), ["image_id", "cls"], threshold=0.5)
    c = M.mask_candidates(ious.select(F.col("a_id").alias("det_id"), F.col("b_id").alias("gt_id"), "iou"), d)
    return task_ap(c, d, spark, sf)
