"""Label checks, conversions, splits, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiontables.operators import annotations as A
from visiontables.operators import convert as CV
from visiontables.plans import fixtures as fx
from visiontables.plans.boxes_queries import XYXY, r
from visiontables.plans.matching_queries import TILES_640
from visiontables.registry import query

LABEL = ("xc", "yc", "bw", "bh")
NAMES = ["person", "car", "bus", "dog", "traffic light"]
NAME_SQL = f"{NAMES}[cls+1]"


def name_of(cls):
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), cls + 1)


def rounded_labels(df, *keep):
    return df.select(*keep, "cls", *[r(F.col(c), c, 9) for c in LABEL])


def sized(spark, sf):
    return fx.ground_truth(spark, sf).withColumn("img_w", F.lit(640.0)).withColumn("img_h", F.lit(480.0))


def ltwh(spark, sf):
    return sized(spark, sf).selectExpr("*", "x1 AS left", "y1 AS top", "x2-x1 AS width", "y2-y1 AS height")


CENTER = "round(((x1+x2)/2)/640,9) AS xc, round(((y1+y2)/2)/480,9) AS yc, round((x2-x1)/640,9) AS bw, round((y2-y1)/480,9) AS bh"


@query("cnv01_coco_labels", f"""
WITH u AS (SELECT range AS src, row_number() OVER (ORDER BY range)-1 AS dst FROM range(1,91) WHERE range NOT IN (12,26,29,30,45,66,68,69,71,83,91)),
g AS (SELECT *, gt_id%80+1 AS cat FROM fx_ground_truth)
SELECT image_id, gt_id AS ann_id, CAST(dst AS INT) AS cls, {CENTER} FROM g LEFT JOIN u ON u.src=cat""")
def cnv01(spark, sf):
    # every object is annotated twice, once more as a crowd and once without width
    ann = ltwh(spark, sf).selectExpr(
        "image_id", "gt_id AS ann_id", "gt_id%80+1 AS category_id", "false AS iscrowd", "left", "top", "width", "height", "img_w", "img_h")
    twice = ann.unionByName(ann.withColumn("ann_id", F.col("ann_id") + 1000000000)).unionByName(
        ann.withColumn("iscrowd", F.lit(True)).withColumn("ann_id", F.col("ann_id") - 1000000000)).unionByName(ann.withColumn("width", F.lit(0.0)))
    return rounded_labels(CV.from_coco(twice), "image_id", "ann_id")


@query("cnv02_dota_labels", f"""SELECT image_id, gt_id AS line, cls, round(x1/640,9) AS x1, round(y1/480,9) AS y1, round(x2/640,9) AS x2, round(y1/480,9) AS y2, round(x2/640,9) AS x3, round(y2/480,9) AS y3, round(x1/640,9) AS x4, round(y2/480,9) AS y4 FROM fx_ground_truth""")
def cnv02(spark, sf):
    d = sized(spark, sf).select("image_id", F.col("gt_id").alias("line"), name_of(F.col("cls")).alias("class_name"), "img_w", "img_h", "x1", "y1", "x2",
                                F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"), F.col("x1").alias("x4"), F.col("y2").alias("y4"))
    out = CV.from_dota(d, {n: i for i, n in enumerate(NAMES)})
    return out.select("image_id", "line", "cls", *[r(F.col(f"{a}{i}"), f"{a}{i}", 9) for i in range(1, 5) for a in "xy"])


@query("cnv03_sku_labels", f"SELECT image_id, gt_id, 0 AS cls, {CENTER} FROM fx_ground_truth")
def cnv03(spark, sf):
    return rounded_labels(CV.from_sku(sized(spark, sf), "gt_id"), "image_id", "gt_id")


@query("cnv04_visdrone_labels", f"SELECT image_id, gt_id, cls, {CENTER} FROM fx_ground_truth WHERE gt_id%5<>0")
def cnv04(spark, sf):
    d = ltwh(spark, sf).selectExpr("*", "gt_id%5 AS score", "cls+1 AS category")
    return rounded_labels(CV.from_visdrone(d, "gt_id"), "image_id", "gt_id")


XV = ", ".join(f"({t},{i})" for i, t in enumerate(CV.XVIEW_TYPES))


@query("cnv05_xview_labels", f"""WITH m(t,c) AS (VALUES {XV}), b AS (SELECT gt_id, image_id, gt_id%100 AS t, least(x1,500) AS x1, least(y1,400) AS y1, least(x2,500) AS x2, least(y2,400) AS y2 FROM fx_ground_truth)
SELECT image_id, gt_id, CAST(c AS INT) AS cls, round(((x1+x2)/2)/500,9) AS xc, round(((y1+y2)/2)/400,9) AS yc, round((x2-x1)/500,9) AS bw, round((y2-y1)/400,9) AS bh FROM b JOIN m USING (t)""")
def cnv05(spark, sf):
    d = fx.ground_truth(spark, sf).selectExpr("image_id", "gt_id", "gt_id%100 AS type_id", "concat_ws(',', CAST(x1 AS INT), CAST(y1 AS INT), CAST(x2 AS INT), CAST(y2 AS INT)) AS bounds_imcoords",
                                              "500D AS img_w", "400D AS img_h")
    return rounded_labels(CV.from_xview(d, "gt_id"), "image_id", "gt_id")


@query("cnv06_voc_labels", "SELECT image_id, gt_id, cls, round(((x1+x2)/2-1)/640,9) AS xc, round(((y1+y2)/2-1)/480,9) AS yc, round((x2-x1)/640,9) AS bw, round((y2-y1)/480,9) AS bh FROM fx_ground_truth WHERE gt_id%6<>1 AND cls<4")
def cnv06(spark, sf):
    d = sized(spark, sf).select("image_id", "gt_id", "img_w", "img_h", name_of(F.col("cls")).alias("name"), F.expr("CASE WHEN gt_id%6=1 THEN 1 ELSE 0 END").alias("difficult"),
                                F.col("x1").alias("xmin"), F.col("y1").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax"))
    return rounded_labels(CV.from_voc(d, NAMES[:4], "gt_id"), "image_id", "gt_id")


@query("cnv07_argoverse_labels", "SELECT image_id, gt_id, cls, round(((x1+x2)/2)/1920,9) AS xc, round(((y1+y2)/2)/1200,9) AS yc, round((x2-x1)/1920,9) AS bw, round((y2-y1)/1200,9) AS bh FROM fx_ground_truth")
def cnv07(spark, sf):
    return rounded_labels(CV.from_argoverse(ltwh(spark, sf).withColumn("category_id", F.col("cls")), "gt_id"), "image_id", "gt_id")


@query("cnv08_sign_labels", "SELECT image_id, gt_id, cls, round(least(1,((x1+x2)/2)/400),9) AS xc, round(least(1,((y1+y2)/2)/300),9) AS yc, round((x2-x1)/400,9) AS bw, round((y2-y1)/300,9) AS bh FROM fx_ground_truth WHERE cls<3")
def cnv08(spark, sf):
    d = fx.ground_truth(spark, sf).select("image_id", "gt_id", F.lit(400.0).alias("img_w"), F.lit(300.0).alias("img_h"), name_of(F.col("cls")).alias("category"),
                                          F.col("x1").alias("xmin"), F.col("y1").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax"))
    return rounded_labels(CV.from_signs(d, NAMES[:3], "gt_id"), "image_id", "gt_id")


@query("cnv09_objects365_labels", "WITH b AS (SELECT image_id, gt_id, cls, least(x1,600) AS x1, least(y1,450) AS y1, least(x2,600) AS x2, least(y2,450) AS y2 FROM fx_ground_truth) SELECT image_id, gt_id, cls, round(((x1+x2)/2)/600,9) AS xc, round(((y1+y2)/2)/450,9) AS yc, round((x2-x1)/600,9) AS bw, round((y2-y1)/450,9) AS bh FROM b")
def cnv09(spark, sf):
    d = ltwh(spark, sf).withColumn("category_id", F.col("cls")).withColumn("img_w", F.lit(600.0)).withColumn("img_h", F.lit(450.0))
    return rounded_labels(CV.from_objects365(d, "gt_id"), "image_id", "gt_id")


@query("cnv10_tile_labels", "WITH " + TILES_640 + """ SELECT gt_id, cls, CAST(image_id AS VARCHAR)||'__256__'||CAST(tx AS VARCHAR)||'___'||CAST(ty AS VARCHAR) AS tile_name,
 round((x1-tx)/256,6) AS x1, round((y1-ty)/256,6) AS y1, round((x2-tx)/256,6) AS x2, round((y2-ty)/256,6) AS y2 FROM i WHERE iof>=0.7""")
def cnv10(spark, sf):
    d = fx.ground_truth(spark, sf).withColumn("w", F.lit(640).cast("bigint")).withColumn("h", F.lit(480).cast("bigint"))
    return CV.tile_labels(d, "gt_id").select("gt_id", "cls", "tile_name", *[r(F.col(c), c) for c in XYXY])


BROKEN = "SELECT gt_id, image_id, CASE WHEN image_id%50=3 THEN 8 ELSE w END AS w, h, cls, CASE WHEN gt_id%101=0 THEN 1.5 ELSE xc END AS xc, yc, CASE WHEN gt_id%103=0 THEN -0.2 ELSE bw END AS bw, bh, CASE WHEN gt_id%107=0 THEN 6 ELSE 5 END AS n_columns FROM fx_labels"
REASON = "CASE WHEN w<=9 OR h<=9 THEN 'image_too_small' WHEN n_columns<>5 THEN 'column_count' WHEN greatest(xc,yc,bw,bh)>1.01 THEN 'out_of_bounds' WHEN least(cls,xc,yc,bw,bh)<-0.01 THEN 'negative' WHEN cls>=4 THEN 'class_exceeds_count' END"


def checked(spark, sf):
    d = fx.labels(spark, sf).selectExpr("gt_id", "image_id", "CASE WHEN image_id%50=3 THEN 8 ELSE w END AS w", "h", "cls", "CASE WHEN gt_id%101=0 THEN 1.5D ELSE xc END AS xc", "yc",
                                        "CASE WHEN gt_id%103=0 THEN -0.2D ELSE bw END AS bw", "bh", "CASE WHEN gt_id%107=0 THEN 6 ELSE 5 END AS n_columns")
    return A.verify_labels(d, 4)


@query("flt11_verify_labels", f"WITH b AS ({BROKEN}) SELECT gt_id, {REASON} AS reason FROM b")
def flt11(spark, sf):
    return checked(spark, sf).select("gt_id", "reason")


@query("joi16_label_status", f"""WITH b AS ({BROKEN}), p AS (SELECT image_id, count(*) AS n, count({REASON}) AS bad FROM (SELECT * REPLACE (CASE WHEN image_id%13=5 THEN image_id-1 ELSE image_id END AS image_id) FROM b) GROUP BY 1)
SELECT i.image_id, CASE WHEN i.image_id%11=0 THEN 'missing' WHEN coalesce(n,0)=0 THEN 'empty' WHEN bad>0 THEN 'corrupt' ELSE 'found' END AS status, coalesce(n,0) AS n FROM fx_images i LEFT JOIN p USING (image_id)""")
def joi16(spark, sf):
    im = fx.images(spark, sf).select("image_id", (F.col("image_id") % 11 != 0).alias("has_file"))
    # the labels of some images were put down under the image before
    return A.label_status(im, checked(spark, sf).withColumn("image_id", F.expr("CASE WHEN image_id%13=5 THEN image_id-1 ELSE image_id END")))


@query("set03_distinct_labels", """
WITH d AS (SELECT image_id, cls, CAST(floor(xc*4) AS BIGINT) AS gx, CAST(floor(yc*3) AS BIGINT) AS gy FROM fx_labels), u AS (SELECT *, count(*) AS n FROM d GROUP BY ALL)
SELECT image_id, count(*) AS kept, CAST(sum(n-1) AS BIGINT) AS removed FROM u GROUP BY 1""")
def set03(spark, sf):
    d = fx.labels(spark, sf).select("image_id", "cls", F.floor(F.col("xc") * 4).alias("gx"), F.floor(F.col("yc") * 3).alias("gy"))
    rows, removed = A.distinct_labels(d, ["cls", "gx", "gy"])
    return rows.groupBy("image_id").agg(F.count("*").alias("kept")).join(removed, "image_id")


@query("set04_distinct_boxes", "SELECT image_id, cls, x1, y1, x2, y2, min(gt_id) AS gt_id FROM (SELECT image_id, cls, round(x1/50) AS x1, round(y1/50) AS y1, round(x2/50) AS x2, round(y2/50) AS y2, gt_id FROM fx_ground_truth) WHERE x2>x1 AND y2>y1 GROUP BY ALL")
def set04(spark, sf):
    d = fx.ground_truth(spark, sf).select("image_id", "cls", "gt_id", *[F.round(F.col(c) / 50).alias(c) for c in XYXY]).where("x2 > x1 AND y2 > y1")
    return CV._first_equal(d.select("image_id", "cls", "gt_id", *[F.col(a).alias(b) for a, b in zip(XYXY, LABEL)]), "gt_id").select(
        "image_id", "cls", "gt_id", *[F.col(b).alias(a) for a, b in zip(XYXY, LABEL)])


@query("set07_concat_instances", "SELECT gt_id, cls, bw, CAST(NULL AS DOUBLE) AS conf FROM (SELECT gt_id, cls, round(bw,9) AS bw FROM fx_labels) UNION ALL SELECT det_id, cls, NULL, round(conf,6) FROM fx_detections")
def set07(spark, sf):
    a = fx.labels(spark, sf).select("gt_id", "cls", r(F.col("bw"), "bw", 9))
    return A.concat_instances(a, fx.detections(spark, sf).select(F.col("det_id").alias("gt_id"), "cls", r(F.col("conf"), "conf")))


PATHS = "SELECT image_id, '/d/'||['train','val','test'][CAST(image_id%3 AS INT)+1]||'/images/c'||CAST(image_id%7 AS VARCHAR)||'/'||CAST(image_id AS VARCHAR)||CASE WHEN image_id%13=0 THEN '.txt' ELSE '.jpg' END AS path FROM fx_images"


def paths(spark, sf):
    return fx.images(spark, sf).selectExpr("image_id", "n_objects", "concat('/d/', array('train','val','test')[CAST(image_id%3 AS INT)], '/images/c', image_id%7, '/', image_id, CASE WHEN image_id%13=0 THEN '.txt' ELSE '.jpg' END) AS path")


U_SQL = "('0x'||substring(md5(path),1,8))::BIGINT/4294967296"


@query("set08_autosplit", f"WITH p AS ({PATHS}), u AS (SELECT image_id, {U_SQL} AS u FROM p WHERE image_id%2=0) SELECT image_id, CASE WHEN u<0.8 THEN 'train' WHEN u<0.95 THEN 'val' ELSE 'test' END AS split FROM u")
def set08(spark, sf):
    p = paths(spark, sf)
    labelled = p.where("image_id%2=0").select(A.image_to_label_path(F.col("path")).alias("path"))
    return A.autosplit(p, (0.8, 0.15, 0.05), labelled).select("image_id", "split")


@query("set09_stratified_split", f"WITH p AS ({PATHS}), k AS (SELECT image_id, image_id%7 AS c, row_number() OVER (PARTITION BY image_id%7 ORDER BY md5(path), path) AS k, count(*) OVER (PARTITION BY image_id%7) AS n FROM p) SELECT image_id, CASE WHEN k<=floor(n*0.8) THEN 'train' ELSE 'val' END AS split FROM k")
def set09(spark, sf):
    return A.stratified_split(paths(spark, sf).withColumn("c", F.col("image_id") % 7), "c").select("image_id", "split")


@query("set10_negative_texts", """
WITH h AS (SELECT image_id, list(DISTINCT cls) AS have FROM fx_labels GROUP BY 1), r AS (SELECT image_id, have, unnest(range(12)) AS c FROM h),
k AS (SELECT image_id, c, len(have) AS nh, row_number() OVER (PARTITION BY image_id ORDER BY md5(CAST(image_id AS VARCHAR)||':'||CAST(c AS VARCHAR))) AS k FROM r WHERE NOT list_contains(have, c))
SELECT image_id, CAST(c AS INT) AS c FROM k WHERE k<=least(4,8-nh)""")
def set10(spark, sf):
    have = fx.labels(spark, sf).groupBy("image_id").agg(F.collect_set("cls").alias("have"))
    return A.negative_texts(have, "have", 12, 4, max_samples=8).select("image_id", F.explode("negatives").alias("c"))


@query("src15_list_media", f"WITH p AS ({PATHS}) SELECT image_id, path FROM p WHERE path LIKE '%.jpg'")
def src15(spark, sf):
    return paths(spark, sf).where(A.is_image(F.col("path"))).select("image_id", "path")


@query("src16_image_to_label_path", f"WITH p AS ({PATHS}) SELECT image_id, regexp_replace(replace(path,'/images/','/labels/'),'\\.[a-z]+$','.txt') AS label_path FROM p")
def src16(spark, sf):
    return paths(spark, sf).select("image_id", A.image_to_label_path(F.col("path")).alias("label_path"))


@query("src17_manifest_hash", f"""WITH p AS (SELECT image_id%5 AS part, path, CASE WHEN image_id%17=0 THEN 0 ELSE image_id*3 END AS size FROM ({PATHS})),
b AS (SELECT part, substring(sha256(path),1,2) AS blk, sum(size) AS s, sha256(array_to_string(list(sha256(path) ORDER BY sha256(path)),'')) AS h FROM p GROUP BY 1,2)
SELECT part, sha256(CAST(CAST(sum(s) AS BIGINT) AS VARCHAR)||array_to_string(list(h ORDER BY blk),'')) AS manifest FROM b GROUP BY 1""")
def src17(spark, sf):
    p = paths(spark, sf).selectExpr("image_id%5 AS part", "path", "CASE WHEN image_id%17=0 THEN NULL ELSE image_id*3 END AS size")
    return A.manifest_hash(p, ["part"])


@query("src21_class_folders", f"WITH p AS ({PATHS}), c AS (SELECT image_id, regexp_extract(path,'/([^/]+)/[^/]+$',1) AS cls_name FROM p) SELECT image_id, cls_name, CAST(dense_rank() OVER (ORDER BY cls_name)-1 AS INT) AS cls FROM c")
def src21(spark, sf):
    from visiontables.sources.readers import class_folders
    return class_folders(paths(spark, sf)).select("image_id", "cls_name", "cls")


@query("agg18_label_stats", """
WITH l AS (SELECT cls, CASE WHEN image_id%9=5 THEN image_id-1 ELSE image_id END AS image_id FROM fx_labels)
SELECT cls, count(*) AS instances, count(DISTINCT image_id) AS images, CAST(NULL AS BIGINT) AS unlabelled FROM l GROUP BY 1
UNION ALL SELECT NULL, (SELECT count(*) FROM l), count(*), count(*) FILTER (image_id NOT IN (SELECT image_id FROM l)) FROM fx_images""")
def agg18(spark, sf):
    moved = fx.labels(spark, sf).withColumn("image_id", F.expr("CASE WHEN image_id%9=5 THEN image_id-1 ELSE image_id END"))
    return A.label_stats(fx.images(spark, sf), moved).select("cls", "instances", "images", "unlabelled")


@query("agg19_class_frequency", """
WITH n AS (SELECT ['person/human','car / vehicle','bus/vehicle','dog','human/traffic light'] AS n), t AS (SELECT trim(unnest(string_split(n[cls+1],'/'))) AS text FROM fx_labels CROSS JOIN n), f AS (SELECT text, count(*) AS n FROM t GROUP BY 1)
SELECT text, n, n>=least((SELECT max(n) FROM f),3000) AS is_frequent FROM f""")
def agg19(spark, sf):
    names = F.element_at(F.array(*[F.lit(n) for n in ("person/human", "car / vehicle", "bus/vehicle", "dog", "human/traffic light")]), F.col("cls") + 1)
    f = A.class_frequency(fx.labels(spark, sf), names)
    often = A.frequent(f, 3000).select("text", F.lit(True).alias("is_frequent"))
    return f.join(often, "text", "left").withColumn("is_frequent", F.coalesce("is_frequent", F.lit(False)))


@query("agg20_dataset_inventory", f"""WITH p AS (SELECT *, image_id%7 AS f FROM ({PATHS}) WHERE path LIKE '%.jpg'), s AS (SELECT CASE image_id%3 WHEN 2 THEN 'test' ELSE 'train' END AS split, count(*) AS images, count(DISTINCT f) AS folders FROM p GROUP BY 1)
SELECT 'train' AS split, split AS source, images, folders, folders<>(SELECT folders FROM s WHERE split='train') AS mismatch FROM s WHERE split='train' UNION ALL SELECT unnest(['val','test']), split, images, folders, folders<>(SELECT folders FROM s WHERE split='train') FROM s WHERE split='test'""")
def agg20(spark, sf):
    # a set without a validation split: its files lie with the training files
    p = paths(spark, sf).withColumn("path", F.regexp_replace("path", "^/d/val/", "/d/train/")).select(F.regexp_extract("path", "^/d/([^/]+)/", 1).alias("split"), F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("folder"), "path")
    return A.dataset_inventory(p)


@query("agg21_instance_count_check", "SELECT cls, count(*) AS n, CAST(CASE cls WHEN 0 THEN 7 WHEN 1 THEN 2572 WHEN 2 THEN 2572 END AS BIGINT) AS expected, coalesce(count(*)=CASE cls WHEN 0 THEN 7 WHEN 1 THEN 2572 WHEN 2 THEN 2572 END,false) AS matches FROM fx_labels GROUP BY 1")
def agg21(spark, sf):
    return A.instance_count_check(fx.labels(spark, sf), {0: 7, 1: 2572, 2: 2572})


@query("agg27_box_histograms", """
WITH e AS (SELECT min(x1) AS lx, max(x1) AS hx, min(y1) AS ly, max(y1) AS hy FROM fx_ground_truth)
SELECT CAST(least(floor((x1-lx)/(hx-lx)*50),49) AS INT) AS i, CAST(least(floor((y1-ly)/(hy-ly)*50),49) AS INT) AS j, count(*) AS n FROM fx_ground_truth CROSS JOIN e GROUP BY 1,2""")
def agg27(spark, sf):
    return A.histogram_2d(fx.ground_truth(spark, sf), "x1", "y1", 50)


@query("agg27_class_histogram", "SELECT cls, count(*) AS n FROM fx_labels GROUP BY 1")
def agg27_cls(spark, sf):
    return fx.labels(spark, sf).groupBy("cls").agg(F.count("*").alias("n"))


@query("agg28_hist2d_density", """
WITH e AS (SELECT min(x1) AS lx, max(x1) AS hx, min(y1) AS ly, max(y1) AS hy FROM fx_ground_truth),
h AS (SELECT least(floor((x1-lx)/(hx-lx)*20),19) AS i, least(floor((y1-ly)/(hy-ly)*20),19) AS j, count(*) AS n FROM fx_ground_truth CROSS JOIN e GROUP BY 1,2),
v AS (SELECT gt_id, least(ceil((x1-lx)/(hx-lx)*20)-1,19) AS i, least(ceil((y1-ly)/(hy-ly)*20)-1,19) AS j FROM fx_ground_truth CROSS JOIN e)
SELECT gt_id, coalesce(n,0) AS n FROM v LEFT JOIN h ON h.i=CASE WHEN v.i<0 THEN 19 ELSE v.i END AND h.j=CASE WHEN v.j<0 THEN 19 ELSE v.j END""")
def agg28(spark, sf):
    return A.density(fx.ground_truth(spark, sf), "gt_id", "x1", "y1")


@query("agg29_category_texts", """
WITH a AS (SELECT doc_id AS image_id, unnest([0,1,2]) AS pos, text FROM documents), p AS (SELECT image_id, pos, trim(lower(substring(text,CAST(1+pos*(length(text)//4) AS INT),6)||' '||substring(text,CAST(length(text)-length(text)//(3+pos) AS INT),4))) AS text FROM a),
f AS (SELECT image_id, text, min(pos) AS fp FROM p WHERE text<>'' GROUP BY 1,2), n AS (SELECT image_id, text, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY fp)-1 AS INT) AS cls FROM f)
SELECT p.image_id, CAST(p.pos AS INT) AS pos, p.text, n.cls FROM p JOIN n USING (image_id, text)""")
def agg29(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr("doc_id AS image_id", "text", "explode(array(0,1,2)) AS pos").selectExpr(
        "image_id", "pos", "text AS caption", "array(named_struct('a', CAST(pos*(length(text) div 4) AS INT), 'b', CAST(pos*(length(text) div 4)+6 AS INT)),"
        " named_struct('a', CAST(length(text)-length(text) div (3+pos)-1 AS INT), 'b', CAST(length(text)-length(text) div (3+pos)+3 AS INT))) AS tokens")
    return A.category_texts(d)


@query("fun30_merge_segments")
def fun30(spark, sf):
    two = F.array(F.flatten(F.transform("pts", lambda p: F.array(p["x"], p["y"]))), F.flatten(F.transform("pts", lambda p: F.array(p["x"] + 200, p["y"] + 30))))
    d = fx.segments(spark, sf).select("gt_id", CV.merge_segments(two).alias("outline"))
    return d.select("gt_id", F.size("outline").alias("n"), r(F.array_max("outline"), "top"))


@query("snk03_coco_predictions", """
SELECT det_id, CASE WHEN image_id%10=0 THEN 'img_'||CAST(image_id AS VARCHAR) ELSE CAST(image_id AS VARCHAR) END AS stem, CASE WHEN image_id%10=0 THEN NULL ELSE image_id END AS image_id,
 CASE WHEN image_id%10=0 THEN 'img_'||CAST(image_id AS VARCHAR) ELSE CAST(image_id AS VARCHAR) END||'.jpg' AS file_name, cls+1 AS category_id, round(x1,3) AS "left", round(y1,3) AS top, round(x2-x1,3) AS width, round(y2-y1,3) AS height, round(conf,5) AS score FROM fx_detections""")
def snk03(spark, sf):
    d = fx.detections(spark, sf).withColumn("file_name", F.expr("concat(CASE WHEN image_id%10=0 THEN 'img_' ELSE '' END, image_id, '.jpg')"))
    return A.coco_predictions(d, F.col("cls") + 1)


@query("snk07_frame_summary", f"""SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY conf DESC)-1 AS INT) AS i, {NAME_SQL} AS name, cls AS class, round(conf,7) AS confidence, round(x1/640,7) AS x1, round(y2/480,7) AS y2 FROM fx_detections""")
def snk07(spark, sf):
    s = A.frame_summary(fx.detections(spark, sf), name_of(F.col("cls")), digits=7, size=(F.lit(640.0), F.lit(480.0)))
    return s.select("image_id", F.posexplode("results").alias("i", "s")).select("image_id", "i", "s.name", "s.class", "s.confidence", "s.box.x1", "s.box.y2")


@query("snk08_verbose", f"""WITH p AS (SELECT image_id, cls, CAST(count(*) AS VARCHAR)||' '||{NAME_SQL}||CASE WHEN count(*)>1 THEN 's' ELSE '' END||', ' AS w FROM fx_detections GROUP BY 1,2)
SELECT i.image_id, coalesce(t, '(no detections), ') AS verbose FROM fx_images i LEFT JOIN (SELECT image_id, array_to_string(list(w ORDER BY cls),'') AS t FROM p GROUP BY 1) USING (image_id)""")
def snk08(spark, sf):
    return A.verbose(fx.images(spark, sf), fx.detections(spark, sf), name_of(F.col("cls")))


@query("top05_top_k_classes", """
WITH e AS (SELECT vec_id, i-1 AS cls, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings CROSS JOIN range(1,65) q(i)), s AS (SELECT vec_id, cls, exp(v)/sum(exp(v)) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, cls) AS k FROM e)
SELECT vec_id, CAST(k-1 AS INT) AS rank, CAST(cls AS INT) AS cls, round(p,6) AS p FROM s WHERE k<=5""")
def top05(spark, sf):
    from visiontables.operators.labels import top_classes
    return top_classes(fx.table(spark, sf, "embeddings"), "embedding", ["vec_id"]).select("vec_id", "rank", "cls", r(F.col("p"), "p"))
