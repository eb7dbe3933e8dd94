"""Box formats, geometry, filters and per-row functions over detections and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.functions import geometry as G
from visiontables.operators import labels as L
from visiontables.plans import fixtures as fx
from visiontables.registry import query

XYXY = ("x1", "y1", "x2", "y2")


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


# rows of a point list: DuckDB text and Spark twin
POINT_ROWS = ("CAST(unnest(range(len(pts))) AS INT) AS i, unnest(list_transform(pts, lambda p: p.x)) AS x,"
              " unnest(list_transform(pts, lambda p: p.y)) AS y")


def point_rows(df, *keep, pts="pts", fields=("x", "y")):
    return df.select(*keep, F.posexplode(pts).alias("i", "p")).select(*keep, "i", *[F.col(f"p.{f}").alias(f) for f in fields])


def rounded(b, *names):
    return [r(c, n) for c, n in zip(b, names)]


@query("prj01_xyxy_xywh", """
SELECT det_id, round((x1+x2)/2,6) AS xc, round((y1+y2)/2,6) AS yc, round(x2-x1,6) AS w, round(y2-y1,6) AS h,
 x1 AS rx1, y1 AS ry1, x2 AS rx2, y2 AS ry2 FROM fx_detections""")
def prj01(spark, sf):
    c = B.xyxy_to_xywh(B.box())
    back = B.xywh_to_xyxy(c)
    return fx.detections(spark, sf).select("det_id", *rounded(c, "xc", "yc", "w", "h"), *rounded(back, "rx1", "ry1", "rx2", "ry2"))


@query("prj02_normalized_xyxy", """
SELECT gt_id, round(640*(xc-bw/2)+3,6) AS x1, round(480*(yc-bh/2)+5,6) AS y1, round(640*(xc+bw/2)+3,6) AS x2,
 round(480*(yc+bh/2)+5,6) AS y2,
 round(((least(640*(xc-bw/2)+3,640-0.001)+least(640*(xc+bw/2)+3,640-0.001))/2)/640+1e-9,6) AS nxc,
 round((least(640*(xc+bw/2)+3,640-0.001)-least(640*(xc-bw/2)+3,640-0.001))/640+1e-9,6) AS nbw,
 round(((least(480*(yc-bh/2)+5,480-0.001)+least(480*(yc+bh/2)+5,480-0.001))/2)/480+1e-9,6) AS nyc,
 round((least(480*(yc+bh/2)+5,480-0.001)-least(480*(yc-bh/2)+5,480-0.001))/480+1e-9,6) AS nbh FROM fx_labels""")
def prj02(spark, sf):
    w, h = F.col("w"), F.col("h")
    px = B.xywhn_to_xyxy(B.box(names=("xc", "yc", "bw", "bh")), w, h, 3, 5)
    back = B.xyxy_to_xywhn(px, w, h, clip=True, eps=1e-3)
    return fx.labels(spark, sf).select("gt_id", *rounded(px, *XYXY), *[r(c + 1e-9, n) for c, n in zip(back, ("nxc", "nyc", "nbw", "nbh"))])


@query("prj03_ltwh_formats", """
SELECT det_id, x1 AS l, y1 AS t, x2-x1 AS w, y2-y1 AS h, round((x1+x2)/2,6) AS xc, round((y1+y2)/2,6) AS yc,
 x2 AS rx2, y2 AS ry2, round((x1+x2)/2-(x2-x1)/2,6) AS l2, round((y1+y2)/2-(y2-y1)/2,6) AS t2 FROM fx_detections""")
def prj03(spark, sf):
    lt = B.xyxy_to_ltwh(B.box())
    c = B.ltwh_to_xywh(lt)
    far, again = B.ltwh_to_xyxy(lt), B.xywh_to_ltwh(c)
    return fx.detections(spark, sf).select(
        "det_id", *lt.named("l", "t", "w", "h"), r(c[0], "xc"), r(c[1], "yc"), far.x2.alias("rx2"), far.y2.alias("ry2"),
        r(again[0], "l2"), r(again[1], "t2"))


CORNERS_SQL = """cx+i*(w/2*cos(theta))+j*(-h/2*sin(theta))"""


@query("prj04_obb_corners", "SELECT det_id, " + ", ".join(
    f"round(cx+({i})*(w/2*cos(theta))-({j})*(h/2*sin(theta)),4) AS px{n}, round(cy+({i})*(w/2*sin(theta))+({j})*(h/2*cos(theta)),4) AS py{n}"
    for n, (i, j) in enumerate(((1, 1), (1, -1), (-1, -1), (-1, 1)), 1)) + " FROM fx_obb")
def prj04(spark, sf):
    pts = B.obb_corners(B.obb())
    return fx.obb(spark, sf).select("det_id", *[c for n, (x, y) in enumerate(pts, 1) for c in (r(x, f"px{n}", 4), r(y, f"py{n}", 4))])


@query("prj05_corners_to_obb", """
SELECT det_id, round(cx,3) AS cx, round(cy,3) AS cy, round(greatest(w,h),3) AS w, round(least(w,h),3) AS h
FROM fx_obb""")
def prj05(spark, sf):
    d = fx.obb(spark, sf).select("det_id", G.obb_points(B.obb()).alias("pts"))
    return B.with_fitted_obb(d, "pts").select("det_id", *[F.round(f"obb.{c}", 3).alias(c) for c in ("cx", "cy", "w", "h")])


@query("prj06_regularize_obb", """
SELECT det_id, CASE WHEN theta-floor(theta/pi())*pi()>=pi()/2 THEN h ELSE w END AS w,
 CASE WHEN theta-floor(theta/pi())*pi()>=pi()/2 THEN w ELSE h END AS h,
 round(theta-floor(theta/(pi()/2))*(pi()/2),6) AS theta FROM fx_obb""")
def prj06(spark, sf):
    o = B.regularize_obb(B.obb())
    return fx.obb(spark, sf).select("det_id", o.w.alias("w"), o.h.alias("h"), r(o.theta, "theta"))


@query("prj07_scale_boxes", """
WITH j AS (SELECT d.*, i.w, i.h, least(480.0::DOUBLE/i.h, 640.0::DOUBLE/i.w) AS gain FROM fx_detections d JOIN fx_images i USING (image_id)),
p AS (SELECT *, round_even((640-w*gain)/2-0.1,0) AS px, round_even((480-h*gain)/2-0.1,0) AS py FROM j)
SELECT det_id, round(greatest(0,least(w,(x1-px)/gain)),9) AS x1, round(greatest(0,least(h,(y1-py)/gain)),9) AS y1,
 round(greatest(0,least(w,(x2-px)/gain)),9) AS x2, round(greatest(0,least(h,(y2-py)/gain)),9) AS y2,
 round((x1-px)/gain,9) AS fx1, round((x2-x1)/gain,9) AS fw FROM p""")
def prj07(spark, sf):
    d = fx.detections(spark, sf).join(fx.images(spark, sf), "image_id")
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    s = B.scale_box(B.box(), (480, 640), (h, w))
    lt = B.scale_box(B.xyxy_to_ltwh(B.box()), (480, 640), (h, w), xywh=True)
    return d.select("det_id", *[r(c, n, 9) for c, n in zip(s, XYXY)], r(lt[0], "fx1", 9), r(lt[2], "fw", 9))


@query("prj08_clip_boxes", """
SELECT det_id, greatest(0,least(400,x1)) AS x1, greatest(0,least(300,y1)) AS y1, greatest(0,least(400,x2)) AS x2,
 greatest(0,least(300,y2)) AS y2 FROM fx_detections""")
def prj08(spark, sf):
    return fx.detections(spark, sf).select("det_id", *B.clip_box(B.box(), 400, 300).named(*XYXY))


@query("prj09_scale_coords", """
SELECT gt_id, """ + POINT_ROWS + """ FROM (SELECT s.gt_id, list_transform(pts, lambda p: {'x': round(greatest(0,least(i.w,(p.x-(640-i.w*least(480.0::DOUBLE/i.h,640.0::DOUBLE/i.w))/2)/least(480.0::DOUBLE/i.h,640.0::DOUBLE/i.w)))/i.w+1.2345e-10,7),
 'y': round(greatest(0,least(i.h,(p.y-(480-i.h*least(480.0::DOUBLE/i.h,640.0::DOUBLE/i.w))/2)/least(480.0::DOUBLE/i.h,640.0::DOUBLE/i.w)))/i.h+1.2345e-10,7)}) AS pts
FROM fx_segments s JOIN fx_images i USING (image_id))""")
def prj09(spark, sf):
    d = fx.segments(spark, sf).join(fx.images(spark, sf), "image_id")
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    scaled = L.scale_points(F.col("pts"), (480, 640), (h, w), normalize=True)
    return point_rows(d.select("gt_id", G.map_points(scaled, lambda x: F.round(x + 1.2345e-10, 7), lambda y: F.round(y + 1.2345e-10, 7)).alias("pts")), "gt_id")


@query("prj10_instance_scaling", """
SELECT l.gt_id, round(xc*w*2,9) AS xc, round(yc*h*3,9) AS yc, round(bw*w*2,9) AS bw, round(bh*h*3,9) AS bh,
 round(x1+8,9) AS px1, round(y1+6,9) AS py1, round(x2+8,9) AS px2, round(y2+6,9) AS py2,
 round(x1/w,9) AS nx1, round(y2/h,9) AS ny2, round((pts[1].x*2+8)/w,9) AS sx, round((pts[1].y*3+6)/h,9) AS sy
FROM fx_labels l JOIN fx_segments s USING (gt_id)""")
def prj10(spark, sf):
    d = fx.labels(spark, sf).select("gt_id", "w", "h", "xc", "yc", "bw", "bh").join(
        fx.segments(spark, sf).select("gt_id", *XYXY, "pts"), "gt_id")
    w, h = F.col("w"), F.col("h")
    big = L.scale_instance(L.denormalize(B.box(names=("xc", "yc", "bw", "bh")), w, h), 2, 3)
    padded = B.shift(B.box(), 8, 6)
    norm = L.normalize(B.box(), w, h)
    pts = G.map_points(F.col("pts"), lambda x: F.round((x * 2 + 8) / w, 9), lambda y: F.round((y * 3 + 6) / h, 9))
    return d.select("gt_id", *rounded(big, "xc", "yc", "bw", "bh"), *rounded(padded, "px1", "py1", "px2", "py2"),
                    r(norm.x1, "nx1", 9), r(norm.y2, "ny2", 9), F.get(pts, F.lit(0))["x"].alias("sx"), F.get(pts, F.lit(0))["y"].alias("sy"))


@query("prj11_flips", """
SELECT gt_id, 640-x2 AS lx1, 640-x1 AS lx2, 480-y2 AS uy1, 480-y1 AS uy2, CAST(unnest(range(len(pts))) AS INT) AS i, unnest(list_transform(pts, lambda p: 640-p.x)) AS x, unnest(list_transform(pts, lambda p: 480-p.y)) AS y
FROM fx_segments""")
def prj11(spark, sf):
    lr, ud = B.flip_lr(B.box(), 640), B.flip_ud(B.box(), 480)
    pts = G.map_points(F.col("pts"), lambda x: 640 - x, lambda y: 480 - y)
    d = fx.segments(spark, sf).select("gt_id", lr.x1.alias("lx1"), lr.x2.alias("lx2"), ud.y1.alias("uy1"), ud.y2.alias("uy2"),
                                      pts.alias("pts"))
    return point_rows(d, "gt_id", "lx1", "lx2", "uy1", "uy2")


@query("prj12_clip_instances", """
SELECT seq_id, frame, CAST(i-1 AS INT) AS i, round(greatest(0,least(0.1,p.x)),6) AS x, round(greatest(0,least(0.08,p.y)),6) AS y,
 round(CASE WHEN p.x<0 OR p.x>0.1 OR p.y<0 OR p.y>0.08 THEN 0 ELSE p.c END,6) AS c
 FROM (SELECT seq_id, frame, unnest(range(1,18)) AS i, unnest(kpts) AS p FROM fx_poses)""")
def prj12(spark, sf):
    k = L.clip_keypoints(F.col("kpts"), F.lit(0.1), F.lit(0.08))
    out = F.transform(k, lambda p: F.struct(*[F.round(p[c], 6).alias(c) for c in ("x", "y", "c")]))
    return point_rows(fx.poses(spark, sf).select("seq_id", "frame", out.alias("pts")), "seq_id", "frame", fields=("x", "y", "c"))


@query("prj13_segment_to_box", """
WITH p AS (SELECT gt_id, list_transform(pts, lambda p: {'x': p.x-60, 'y': p.y-40}) AS pts FROM fx_segments),
m AS (SELECT gt_id, pts, (list_min(list_transform(pts, lambda p: p.x))<0)::INT+(list_min(list_transform(pts, lambda p: p.y))<0)::INT
 +(list_max(list_transform(pts, lambda p: p.x))>450)::INT+(list_max(list_transform(pts, lambda p: p.y))>300)::INT AS k FROM p),
c AS (SELECT gt_id, CASE WHEN k>=3 THEN list_transform(pts, lambda p: {'x': greatest(0,least(450,p.x)), 'y': greatest(0,least(300,p.y))}) ELSE pts END AS pts FROM m),
f AS (SELECT gt_id, list_filter(pts, lambda p: p.x>0 AND p.y>0 AND p.x<450 AND p.y<300) AS pts FROM c)
SELECT gt_id, coalesce(list_min(list_transform(pts, lambda p: p.x)),0.0) AS x1, coalesce(list_min(list_transform(pts, lambda p: p.y)),0.0) AS y1,
 coalesce(list_max(list_transform(pts, lambda p: p.x)),0.0) AS x2, coalesce(list_max(list_transform(pts, lambda p: p.y)),0.0) AS y2 FROM f""")
def prj13(spark, sf):
    moved = G.map_points(F.col("pts"), lambda x: x - 60, lambda y: y - 40)
    return fx.segments(spark, sf).select("gt_id", G.segment_box(moved, 450, 300).alias("b")).select("gt_id", "b.*")


@query("prj14_segments_to_boxes", """
SELECT gt_id, list_min(list_transform(pts, lambda p: p.x)) AS x1, list_min(list_transform(pts, lambda p: p.y)) AS y1,
 list_max(list_transform(pts, lambda p: p.x)) AS x2, list_max(list_transform(pts, lambda p: p.y)) AS y2 FROM fx_segments""")
def prj14(spark, sf):
    return fx.segments(spark, sf).select("gt_id", G.points_box(F.col("pts")).alias("b")).select("gt_id", "b.*")


@query("prj15_snap_to_border", """
SELECT det_id, CASE WHEN x1<20 THEN 0 ELSE x1 END AS x1, CASE WHEN y1<20 THEN 0 ELSE y1 END AS y1,
 CASE WHEN x2>620 THEN 640 ELSE x2 END AS x2, CASE WHEN y2>460 THEN 480 ELSE y2 END AS y2 FROM fx_detections""")
def prj15(spark, sf):
    return fx.detections(spark, sf).select("det_id", *B.snap_to_border(B.box(), 640, 480).named(*XYXY))


GAPS = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91)


@query("prj16_remap_class", f"""
WITH m AS (SELECT range AS src, row_number() OVER (ORDER BY range)-1 AS dst FROM range(1,91) WHERE range NOT IN {GAPS})
SELECT o_orderkey, CAST(o_custkey%91+1 AS BIGINT) AS cls91, CAST(dst AS BIGINT) AS cls80,
 CASE WHEN dst IS NULL THEN NULL ELSE CAST(o_custkey%91+1 AS BIGINT) END AS cls91_again
FROM orders LEFT JOIN m ON m.src=o_custkey%91+1""")
def prj16(spark, sf):
    d = fx.table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_custkey%91+1 AS BIGINT) AS cls91")
    to80 = L.coco91_to_80(F.col("cls91"))
    return d.withColumn("cls80", to80.cast("bigint")).withColumn("cls91_again", L.coco80_to_91(F.col("cls80")).cast("bigint"))


@query("prj18_uncrop", """
SELECT det_id, x1+64 AS x1, y1+32 AS y1, x2+64 AS x2, y2+32 AS y2, round((x1+x2)/2+64,6) AS px, round((y1+y2)/2+32,6) AS py FROM fx_detections""")
def prj18(spark, sf):
    b = B.shift(B.box(), 64, 32)
    c = B.xyxy_to_xywh(b)
    return fx.detections(spark, sf).select("det_id", *b.named(*XYXY), r(c[0], "px"), r(c[1], "py"))


# --- filters -----------------------------------------------------------------------------------------------------

@query("flt01_filter_conf_classes", """
SELECT det_id, cls, round(conf,6) AS conf FROM fx_detections WHERE conf>0.25 AND cls IN (0,2,3)""")
def flt01(spark, sf):
    return L.filter_detections(fx.detections(spark, sf), 0.25, [0, 2, 3]).select("det_id", "cls", r(F.col("conf"), "conf"))


@query("flt01_best_class", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding))-1 AS INT) AS cls, round(CAST(list_max(embedding) AS DOUBLE),6) AS score FROM embeddings""")
def flt01_best(spark, sf):
    cls, score = L.best_class(F.col("embedding"))
    return fx.table(spark, sf, "embeddings").select("vec_id", cls.alias("cls"), r(score.cast("double"), "score"))


@query("flt02_multi_label", """
SELECT vec_id, CAST(i-1 AS INT) AS cls, round(CAST(embedding[i] AS DOUBLE),6) AS score
FROM (SELECT vec_id, embedding, unnest(range(1,len(embedding)+1)) AS i FROM embeddings) WHERE CAST(embedding[i] AS DOUBLE)>0.2""")
def flt02(spark, sf):
    e = fx.table(spark, sf, "embeddings").selectExpr("vec_id", "transform(embedding, v -> CAST(v AS DOUBLE)) AS scores")
    return L.multi_label(e, "scores", 0.2).select("vec_id", "cls", r(F.col("score"), "score"))


@query("flt03_include_classes_single", "SELECT gt_id, 0 AS cls FROM fx_labels WHERE cls IN (1,4)")
def flt03(spark, sf):
    return L.include_classes(fx.labels(spark, sf), [1, 4], single_cls=True).select("gt_id", "cls")


@query("flt04_drop_zero_area", """
SELECT det_id FROM fx_detections WHERE (greatest(0,least(300,x2))-greatest(0,least(300,x1)))*(greatest(0,least(200,y2))-greatest(0,least(200,y1)))>0""")
def flt04(spark, sf):
    return fx.detections(spark, sf).where(B.area(B.clip_box(B.box(), 300, 200)) > 0).select("det_id")


@query("flt05_box_candidates", """
WITH c AS (SELECT det_id, x2-x1 AS w1, y2-y1 AS h1, least(400,x2)-least(400,x1) AS w2, least(120,y2)-least(120,y1) AS h2 FROM fx_detections)
SELECT det_id, w2>2 AND h2>2 AND w2*h2/(w1*h1+1e-16)>0.1 AND greatest(w2/(h2+1e-16),h2/(w2+1e-16))<20 AS keep FROM c""")
def flt05(spark, sf):
    b = B.box()
    after = B.Box(*[F.least(c, F.lit(float(m))) for c, m in zip(b, (400, 120, 400, 120))])
    return fx.detections(spark, sf).select("det_id", B.is_candidate(b, after, max_ratio=20).alias("keep"))


@query("flt06_near_crop_edge", """
SELECT det_id, (abs(x1+100-100)<=20 AND abs(x1+100-0)>20) OR (abs(y1+50-50)<=20 AND abs(y1+50-0)>20) OR (abs(x2+100-500)<=20 AND abs(x2+100-800)>20)
 OR (abs(y2+50-300)<=20 AND abs(y2+50-300)>20) AS near FROM fx_detections""")
def flt06(spark, sf):
    near = B.near_crop_edge(B.box(), B.lit_box(100, 50, 500, 300), B.lit_box(0, 0, 800, 300))
    return fx.detections(spark, sf).select("det_id", near.alias("near"))


@query("flt12_zone_filter", """
SELECT det_id FROM fx_detections WHERE (x1+x2)/2>160 AND (x1+x2)/2<480 AND (y1+y2)/2>120 AND (y1+y2)/2<360""")
def flt12(spark, sf):
    return L.zone_filter(fx.detections(spark, sf), fx.RECT).select("det_id")


# --- overlap functions -------------------------------------------------------------------------------------------

PAIR = """WITH p AS (SELECT a.o_orderkey AS k, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
 FROM (SELECT det_id AS o_orderkey, * FROM fx_detections WHERE det_id%2=0) a JOIN (SELECT * FROM fx_detections WHERE det_id%2=1) b ON b.det_id=a.o_orderkey+1),
 q AS (SELECT *, greatest(0,least(ax2,bx2)-greatest(ax1,bx1))*greatest(0,least(ay2,by2)-greatest(ay1,by1)) AS inter,
 (ax2-ax1)*(ay2-ay1) AS sa, (bx2-bx1)*(by2-by1) AS sb FROM p)"""


def paired(spark, sf):
    """The two noisy boxes of every object side by side, without a join."""
    d = fx.detections(spark, sf).withColumn("b", F.struct(*XYXY))
    return (d.groupBy(F.floor(F.col("det_id") / 2).alias("k")).agg(
        F.min_by("b", "det_id").alias("a"), F.max_by("b", "det_id").alias("b"))
        .select((F.col("k") * 2).cast("bigint").alias("k"), *[F.col(f"a.{c}").alias(f"a{c}") for c in XYXY],
                *[F.col(f"b.{c}").alias(f"b{c}") for c in XYXY]))


@query("fun01_iou_ioa", PAIR + "SELECT k, round(inter/(sa+sb-inter+1e-7),6) AS iou, round(inter/(sb+1e-7),6) AS ioa FROM q")
def fun01(spark, sf):
    a, b = B.box("a"), B.box("b")
    return paired(spark, sf).select("k", r(B.iou(a, b), "iou"), r(B.ioa(a, b), "ioa"))


@query("fun02_giou_diou_ciou", PAIR + """, s AS (SELECT *, ay2-ay1+1e-7 AS h1, by2-by1+1e-7 AS h2, greatest(ax2,bx2)-least(ax1,bx1) AS cw,
 greatest(ay2,by2)-least(ay1,by1) AS ch, (pow(bx1+bx2-ax1-ax2,2)+pow(by1+by2-ay1-ay2,2))/4 AS rho FROM q),
 t AS (SELECT *, (ax2-ax1)*h1+(bx2-bx1)*h2-inter+1e-7 AS un FROM s),
 u AS (SELECT *, inter/un AS iou, (4/pow(pi(),2))*pow(atan((bx2-bx1)/h2)-atan((ax2-ax1)/h1),2) AS v FROM t)
SELECT k, round(iou-(cw*ch+1e-7-un)/(cw*ch+1e-7),6) AS giou, round(iou-rho/(cw*cw+ch*ch+1e-7),6) AS diou,
 round(iou-(rho/(cw*cw+ch*ch+1e-7)+v*(v/(v-iou+1+1e-7))),6) AS ciou FROM u""")
def fun02(spark, sf):
    a, b = B.box("a"), B.box("b")
    return paired(spark, sf).select("k", *[r(B.shaped_iou(a, b, kind), kind) for kind in ("giou", "diou", "ciou")])


@query("fun03_quad_iof", """
SELECT gt_id, round((greatest(0,least(x2,400)-greatest(x1,100))*greatest(0,least(y2,300)-greatest(y1,50)))/((x2-x1)*(y2-y1)),6) AS iof FROM fx_ground_truth""")
def fun03(spark, sf):
    b = B.box()
    quad = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((b.x1, b.y1), (b.x2, b.y1), (b.x2, b.y2), (b.x1, b.y2))])
    return fx.ground_truth(spark, sf).select("gt_id", r(G.quad_iof(quad, B.lit_box(100, 50, 400, 300)), "iof"))


PROB = """WITH p AS (SELECT a.det_id AS k, a.cx AS x1, a.cy AS y1, a.w AS w1, a.h AS h1, a.theta AS t1, b.cx AS x2, b.cy AS y2, b.w AS w2, b.h AS h2, b.theta AS t2
 FROM fx_obb a JOIN fx_obb b ON a.det_id%2=0 AND b.det_id=a.det_id+1),
 c AS (SELECT *, w1*w1/12*cos(t1)*cos(t1)+h1*h1/12*sin(t1)*sin(t1) AS a1, w1*w1/12*sin(t1)*sin(t1)+h1*h1/12*cos(t1)*cos(t1) AS b1, (w1*w1/12-h1*h1/12)*cos(t1)*sin(t1) AS c1,
 w2*w2/12*cos(t2)*cos(t2)+h2*h2/12*sin(t2)*sin(t2) AS a2, w2*w2/12*sin(t2)*sin(t2)+h2*h2/12*cos(t2)*cos(t2) AS b2, (w2*w2/12-h2*h2/12)*cos(t2)*sin(t2) AS c2 FROM p),
 d AS (SELECT *, (a1+a2)*(b1+b2)-(c1+c2)*(c1+c2) AS det FROM c),
 e AS (SELECT *, ((a1+a2)*(y1-y2)*(y1-y2)+(b1+b2)*(x1-x2)*(x1-x2))/(det+1e-7)*0.25 + ((c1+c2)*(x2-x1)*(y1-y2))/(det+1e-7)*0.5
 + ln(det/(4*sqrt(greatest(a1*b1-c1*c1,0)*greatest(a2*b2-c2*c2,0))+1e-7)+1e-7)*0.5 AS bd FROM d),
 f AS (SELECT *, 1-sqrt(1-exp(-least(greatest(bd,1e-7),100))+1e-7) AS iou, (4/pow(pi(),2))*pow(atan(w2/h2)-atan(w1/h1),2) AS v FROM e)"""


@query("fun04_probiou", PROB + " SELECT k, round(iou,5) AS iou, round(iou-v*(v/(v-iou+1+1e-7)),5) AS ciou FROM f")
def fun04(spark, sf):
    d = fx.obb(spark, sf).withColumn("o", F.struct("cx", "cy", "w", "h", "theta"))
    p = d.groupBy(F.floor(F.col("det_id") / 2).alias("k")).agg(F.min_by("o", "det_id").alias("a"), F.max_by("o", "det_id").alias("b"))
    a, b = (B.Obb(*[F.col(f"{s}.{c}") for c in B.Obb._fields]) for s in "ab")
    return p.select((F.col("k") * 2).cast("bigint").alias("k"), r(B.probiou(a, b), "iou", 5), r(B.probiou(a, b, ciou=True), "ciou", 5))


@query("fun09_centroid_area_diag", """
SELECT gt_id, round((x1+x2)/2,6) AS cx, round((y1+y2)/2,6) AS cy, round((x2-x1)*(y2-y1),6) AS area, round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)),6) AS diag,
 round((pts[1].x+pts[2].x+pts[3].x+pts[4].x+pts[5].x)/5,6) AS mx, round((pts[1].y+pts[2].y+pts[3].y+pts[4].y+pts[5].y)/5,6) AS my FROM fx_segments""")
def fun09(spark, sf):
    b = B.box()
    c = B.xyxy_to_xywh(b)
    mean = L.mean_point(F.col("pts"))
    return fx.segments(spark, sf).select("gt_id", r(c[0], "cx"), r(c[1], "cy"), r(B.area(b), "area"),
                                         r(F.sqrt(c[2] * c[2] + c[3] * c[3]), "diag"), r(mean["x"], "mx"), r(mean["y"], "my"))


_EDGES = list(zip(fx.CONCAVE, fx.CONCAVE[1:] + fx.CONCAVE[:1]))
_CROSS = "+".join(f"(CASE WHEN ({ay}>cy)<>({by}>cy) AND cx<({bx}-({ax}))*(cy-({ay}))/({by}-({ay}))+({ax}) THEN 1 ELSE 0 END)"
                  for (ax, ay), (bx, by) in _EDGES if ay != by)
_ON = " OR ".join(f"((cx-({ax}))*({by}-({ay}))-(cy-({ay}))*({bx}-({ax}))=0 AND cx BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND cy BETWEEN {min(ay, by)} AND {max(ay, by)})"
                  for (ax, ay), (bx, by) in _EDGES)


@query("fun10_point_in_polygon", f"""
SELECT event_id, cx>160 AND cx<480 AND cy>120 AND cy<360 AS in_rect, cx>=160 AND cx<=480 AND cy>=120 AND cy<=360 AS in_rect_edge,
 ({_CROSS})%2=1 AND NOT ({_ON}) AS in_concave, ({_CROSS})%2=1 AND NOT ({_ON}) AS in_column FROM fx_tracks""")
def fun10(spark, sf):
    x, y = F.col("cx"), F.col("cy")
    pts = F.array(*[F.struct(F.lit(px).alias("x"), F.lit(py).alias("y")) for px, py in fx.CONCAVE])
    return fx.tracks(spark, sf).select(
        "event_id", G.point_in_polygon(x, y, fx.RECT).alias("in_rect"), G.point_in_polygon(x, y, fx.RECT, True).alias("in_rect_edge"),
        G.point_in_polygon(x, y, fx.CONCAVE).alias("in_concave"), G.point_in_points(x, y, pts).alias("in_column"))


@query("fun11_segments_intersect", """
WITH p AS (SELECT event_id, cx, cy, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM fx_tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT event_id, least(px,cx)<=320 AND greatest(px,cx)>=320 AS crossed FROM p WHERE px IS NOT NULL""")
def fun11(spark, sf):
    from visiontables.operators import tracks as T
    steps = T.prev_position(fx.tracks(spark, sf)).where("px IS NOT NULL")
    hit = G.segments_intersect((F.col("px"), F.col("py")), (F.col("cx"), F.col("cy")), *fx.LINE)
    return steps.select("event_id", hit.alias("crossed"))


@query("fun12_convex_hull", """
WITH s AS (SELECT gt_id, list_distinct(pts) AS p FROM fx_segments), a AS (SELECT gt_id, p, unnest(p) AS a FROM s), ab AS (SELECT gt_id, p, a, unnest(p) AS b FROM a),
c AS (SELECT *, list_transform(p, lambda c: {'side': (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x), 'beyond': (c.x-a.x)*(c.x-b.x)+(c.y-a.y)*(c.y-b.y)}) AS t FROM ab WHERE a<>b),
e AS (SELECT gt_id, a, b FROM c WHERE len(list_filter(t, lambda v: v.side<0 OR (v.side=0 AND v.beyond>0)))=0)
SELECT gt_id, CAST(greatest(count(e.a),1) AS INT) AS n_hull, round(coalesce(abs(sum(e.a.x*e.b.y-e.b.x*e.a.y))/2,0),6) AS area FROM s LEFT JOIN e USING (gt_id) GROUP BY 1""")
def fun12(spark, sf):
    hull = G.convex_hull(F.col("pts"))
    return fx.segments(spark, sf).select("gt_id", F.size(hull).alias("n_hull"), r(G.polygon_area(hull), "area"))


@query("fun26_tile_windows", """
WITH n AS (SELECT image_id, w, h, CASE WHEN w<=256 THEN 1 ELSE CAST(ceil((w-256)/192.0+1) AS BIGINT) END AS xn, CASE WHEN h<=256 THEN 1 ELSE CAST(ceil((h-256)/192.0+1) AS BIGINT) END AS yn FROM fx_images),
t AS (SELECT image_id, w, h, xn, yn, unnest(range(0,xn)) AS i FROM n), u AS (SELECT *, unnest(range(0,yn)) AS j FROM t),
s AS (SELECT image_id, w, h, CASE WHEN xn>1 AND i*192+256>w THEN w-256 ELSE i*192 END AS x1, CASE WHEN yn>1 AND j*192+256>h THEN h-256 ELSE j*192 END AS y1 FROM u),
q AS (SELECT image_id, x1, y1, x1+256 AS x2, y1+256 AS y2, (least(x1+256,w)-x1)*(least(y1+256,h)-y1)/65536.0 AS rate FROM s),
m AS (SELECT *, max(rate) OVER (PARTITION BY image_id) AS best FROM q)
SELECT image_id, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM m
WHERE CASE WHEN best>0.6 THEN rate>0.6 ELSE abs(rate-best)<0.01 END""")
def fun26(spark, sf):
    return fx.images(spark, sf).select("image_id", F.explode(G.tile_windows(F.col("w"), F.col("h"))).alias("t")).select(
        "image_id", *[F.col(f"t.{c}").cast("bigint").alias(c) for c in XYXY])


@query("fun27_layered_crops", """
WITH l AS (SELECT image_id, w, h, unnest([1,2]) AS layer FROM fx_images), n AS (SELECT *, CAST(pow(2,layer) AS BIGINT) AS n FROM l),
o AS (SELECT *, CAST(floor(least(w,h)*0.25*(2.0/n)) AS BIGINT) AS lap FROM n),
c AS (SELECT *, CAST(ceil((lap*(n-1)+w)/CAST(n AS DOUBLE)) AS BIGINT) AS cw, CAST(ceil((lap*(n-1)+h)/CAST(n AS DOUBLE)) AS BIGINT) AS ch FROM o),
i AS (SELECT *, unnest(range(0,n)) AS i FROM c), j AS (SELECT *, unnest(range(0,n)) AS j FROM i)
SELECT image_id, CAST(layer AS INT) AS layer, CAST((cw-lap)*i AS BIGINT) AS x1, CAST((ch-lap)*j AS BIGINT) AS y1, CAST(least((cw-lap)*i+cw,w) AS BIGINT) AS x2, CAST(least((ch-lap)*j+ch,h) AS BIGINT) AS y2 FROM j
UNION ALL SELECT image_id, 0, 0, 0, w, h FROM fx_images""")
def fun27(spark, sf):
    return fx.images(spark, sf).select("image_id", F.explode(G.layered_crops(F.col("w"), F.col("h"), 2, 0.25)).alias("c")).select("image_id", "c.*")


@query("fun28_point_grid", """
SELECT image_id, CAST(layer AS INT) AS layer, round((i+0.5)/n*w,6) AS px, round((j+0.5)/n*h,6) AS py
FROM (SELECT *, unnest(range(0,n)) AS j FROM (SELECT *, unnest(range(0,n)) AS i FROM (
 SELECT image_id, w, h, 0 AS layer, 8 AS n FROM fx_images UNION ALL SELECT image_id, w, h, 1, 4 FROM fx_images)))""")
def fun28(spark, sf):
    im = fx.images(spark, sf)
    grids = F.array(*[F.struct(F.lit(layer).alias("layer"), G.point_grid(int(8 / 2 ** layer)).alias("g")) for layer in (0, 1)])
    return (im.select("image_id", "w", "h", F.explode(grids).alias("l")).select("image_id", "w", "h", "l.layer", F.explode("l.g").alias("p"))
            .select("image_id", "layer", r(F.col("p.x") * F.col("w"), "px"), r(F.col("p.y") * F.col("h"), "py")))


@query("fun29_resample_segment")
def fun29(spark, sf):
    return fx.segments(spark, sf).select("gt_id", F.posexplode(G.resample_segment(F.col("pts"), 16)).alias("i", "p")).select(
        "gt_id", "i", r(F.col("p.x"), "x"), r(F.col("p.y"), "y"))


@query("fun35_crop_square", """
WITH b AS (SELECT det_id, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM fx_detections),
m AS (SELECT det_id, greatest(0,x1-CAST(trunc((x2-x1)*10/100.0) AS BIGINT)) AS x1, greatest(0,y1-CAST(trunc((y2-y1)*10/100.0) AS BIGINT)) AS y1,
 least(640,x2+CAST(trunc((x2-x1)*10/100.0) AS BIGINT)) AS x2, least(480,y2+CAST(trunc((y2-y1)*10/100.0) AS BIGINT)) AS y2 FROM b),
c AS (SELECT det_id, CAST(floor((x1+x2)/2.0) AS BIGINT) AS cx, CAST(floor((y1+y2)/2.0) AS BIGINT) AS cy, CAST(floor(greatest(x2-x1,y2-y1)/2.0) AS BIGINT) AS half FROM m)
SELECT det_id, greatest(0,cx-half) AS x1, greatest(0,cy-half) AS y1, least(640,cx+half) AS x2, least(480,cy+half) AS y2 FROM c""")
def fun35(spark, sf):
    return fx.detections(spark, sf).select("det_id", *B.crop_square(B.box(), 640, 480, 10).named(*XYXY))


@query("fun37_crop_box", """
WITH c AS (SELECT det_id, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, (x2-x1)*1.02::DOUBLE+10 AS w, (y2-y1)*1.02::DOUBLE+10 AS h,
 greatest(x2-x1,y2-y1)*1.02::DOUBLE+10 AS s FROM fx_detections)
SELECT det_id, CAST(greatest(0,least(640,trunc(cx-w/2))) AS BIGINT) AS x1, CAST(greatest(0,least(480,trunc(cy-h/2))) AS BIGINT) AS y1,
 CAST(greatest(0,least(640,trunc(cx+w/2))) AS BIGINT) AS x2, CAST(greatest(0,least(480,trunc(cy+h/2))) AS BIGINT) AS y2,
 CAST(greatest(0,least(640,trunc(cx-s/2))) AS BIGINT) AS sx1, CAST(greatest(0,least(480,trunc(cy+s/2))) AS BIGINT) AS sy2 FROM c""")
def fun37(spark, sf):
    c, s = B.crop_box(B.box(), 640, 480), B.crop_box(B.box(), 640, 480, square=True)
    return fx.detections(spark, sf).select("det_id", *c.named(*XYXY), s.x1.alias("sx1"), s.y2.alias("sy2"))


@query("joi23_full_frame_boxes", """
WITH g AS (SELECT det_id, x1-(640-(x2-x1))/2*f AS x1, y1-(480-(y2-y1))/2*f AS y1, x2+(640-(x2-x1))/2*f AS x2, y2+(480-(y2-y1))/2*f AS y2
 FROM (SELECT *, CAST(det_id%2 AS DOUBLE) AS f FROM fx_detections)),
s AS (SELECT det_id, CASE WHEN x1<20 THEN 0 ELSE x1 END AS x1, CASE WHEN y1<20 THEN 0 ELSE y1 END AS y1, CASE WHEN x2>620 THEN 640 ELSE x2 END AS x2,
 CASE WHEN y2>460 THEN 480 ELSE y2 END AS y2 FROM g),
i AS (SELECT *, (least(x2,640)-greatest(x1,0))*(least(y2,480)-greatest(y1,0)) AS inter FROM s),
f AS (SELECT *, inter/(307200+(x2-x1)*(y2-y1)-inter+1e-7)>0.9 AS whole FROM i)
SELECT det_id, CASE WHEN whole THEN 0 ELSE round(x1,6) END AS x1, CASE WHEN whole THEN 0 ELSE round(y1,6) END AS y1,
 CASE WHEN whole THEN 640 ELSE round(x2,6) END AS x2, CASE WHEN whole THEN 480 ELSE round(y2,6) END AS y2 FROM f""")
def joi23(spark, sf):
    f = (F.col("det_id") % 2).cast("double")
    b = B.box()
    gx, gy = (640 - (b.x2 - b.x1)) / 2 * f, (480 - (b.y2 - b.y1)) / 2 * f
    grown = fx.detections(spark, sf).select("det_id", (b.x1 - gx).alias("x1"), (b.y1 - gy).alias("y1"), (b.x2 + gx).alias("x2"), (b.y2 + gy).alias("y2"))
    return grown.select("det_id", *rounded(B.full_frame(b, 640, 480), *XYXY))
