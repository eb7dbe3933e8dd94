"""Readers with explicit schemas; malformed values become NULL and nothing is inferred from the data."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visiontables.functions import text as T
from visiontables.operators.annotations import is_image
from visiontables.operators.ordered import rank_rows, sorted_rank
from visiontables.sources.quoted import read_by_header

# Columns of the metrics and plan tables, and of a retail label file (fixed values).
RUN_COLUMNS = ["run_id", "timestamp_utc", "frame", "track_id", "technique", "reference_angle", "score", "score_threshold", "is_correct",
               "cosine_similarity", "dtw_distance", "angle_error", "mean_pose_distance", "use_mirror", "feedback_1", "feedback_2", "source"]
RUN_NUMBERS = ["score", "score_threshold", "cosine_similarity", "dtw_distance", "angle_error", "mean_pose_distance"]
PLAN_COLUMNS = ["technique", "angle", "reference_key", "status", "source_url", "source_url_1", "source_url_2", "source_url_3", "source_url_4",
                "segment_start_s", "segment_end_s", "quality", "notes", "target_technique_key", "record_reference_key", "command_ready", "command"]
SKU_SCHEMA = "image string, x1 double, y1 double, x2 double, y2 double, class string, img_w double, img_h double"


def _file() -> Column:
    return F.col("_metadata.file_path")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def image_of(path: Column) -> Column:
    """Image of a file: the value of its folder ``image_id=<id>`` as the writers name it, otherwise the file's stem."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/image_id=([^/]+)/", 1), F.lit("")), file_stem(path))


def _documents(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """JSON documents: one a file, or one a line, which Spark splits over tasks."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_run_metrics(spark: SparkSession, root: str) -> DataFrame:
    """All ``metrics.csv`` below ``root``, files or folders of part files: typed values, group and user from the folder names."""
    own = r"/metrics\.csv(/[^/]*)?$"
    raw = read_by_header(spark, root, RUN_COLUMNS, "*.csv", own).drop("csv_line", "file_line")
    d = raw.withColumn("run_folder", F.regexp_extract("path", "/([^/]+)" + own, 1)).withColumn("group_name", F.regexp_extract("path", "/([^/]+)/[^/]+" + own, 1))
    d = d.withColumn("user", F.split("run_folder", "_")[0])
    return d.withColumns({**{c: T.to_float(F.col(c)) for c in RUN_NUMBERS}, "frame": F.col("frame").try_cast("bigint"), "is_correct": T.truthy(F.col("is_correct"), ("1", "true", "yes"))})


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """Plan rows with their row number in the file (the header is 1) and the line they begin on; a byte-order mark is ignored."""
    rows = read_by_header(spark, path, PLAN_COLUMNS)
    return rows.select("csv_line", "file_line", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in PLAN_COLUMNS])


def read_label_text(spark: SparkSession, folder: str, named: bool = False) -> DataFrame:
    """One row per label line: image, class and the numbers after it; box, quad, polygon and keypoint lines alike.

    The image is the file's, or with ``named`` what stands before the line's last tab.
    """
    image, line = (F.regexp_extract("value", r"^(.*)\t", 1), F.substring_index("value", "\t", -1)) if named else (image_of(_file()), F.col("value"))
    d = spark.read.option("recursiveFileLookup", True).text(folder).select(image.alias("image"), F.trim(line).alias("v")).where("v <> ''")
    nums = F.transform(F.split("v", r"\s+"), lambda s: s.try_cast("double"))
    return d.withColumn("_n", nums).select("image", F.get("_n", F.lit(0)).cast("int").alias("cls"), F.slice("_n", F.lit(2), F.greatest(F.size("_n") - 1, F.lit(0))).alias("numbers"), F.size("_n").alias("n_columns"))


def label_boxes(labels: DataFrame) -> DataFrame:
    """Centre-size boxes of label lines; polygon lines (more than six columns) by their extremes."""
    n = F.col("numbers")
    xs, ys = F.filter(n, lambda _, i: i % 2 == 0), F.filter(n, lambda _, i: i % 2 == 1)
    poly = F.col("n_columns") > 6
    lo = lambda a: F.array_min(a)
    hi = lambda a: F.array_max(a)
    box = [F.when(poly, (lo(xs) + hi(xs)) / 2).otherwise(F.get(n, F.lit(0))), F.when(poly, (lo(ys) + hi(ys)) / 2).otherwise(F.get(n, F.lit(1))),
           F.when(poly, hi(xs) - lo(xs)).otherwise(F.get(n, F.lit(2))), F.when(poly, hi(ys) - lo(ys)).otherwise(F.get(n, F.lit(3)))]
    return labels.select("image", "cls", *[c.alias(a) for c, a in zip(box, ("xc", "yc", "bw", "bh"))], F.when(poly, 5).otherwise(F.col("n_columns")).alias("n_columns"))


COCO_SCHEMA = """images array<struct<id:bigint,height:double,width:double,file_name:string,coco_url:string,caption:string>>,
annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,iscrowd:int,segmentation:array<array<double>>,
keypoints:array<double>,tokens_positive:array<array<int>>>>"""


def read_coco(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Annotations joined with their image, left-top boxes; ``lines`` where each line is a document."""
    doc = _documents(spark, path, COCO_SCHEMA, lines)
    img = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.width").alias("img_w"), F.col("i.height").alias("img_h"), "i.file_name", "i.caption")
    ann = doc.select(F.explode("annotations").alias("a")).select(
        F.col("a.id").alias("ann_id"), "a.image_id", "a.category_id", (F.coalesce("a.iscrowd", F.lit(0)) != 0).alias("iscrowd"), "a.segmentation", "a.keypoints", "a.tokens_positive",
        *[F.get("a.bbox", F.lit(i)).alias(n) for i, n in enumerate(("left", "top", "width", "height"))])
    return ann.join(img, "image_id")


VOC_SCHEMA = """filename string, size struct<width:double,height:double>,
object array<struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"""


def read_voc(spark: SparkSession, folder: str) -> DataFrame:
    """Objects of annotation documents, one or more a file; the image is the one a document names, otherwise its file's stem."""
    d = spark.read.format("xml").option("rowTag", "annotation").schema(VOC_SCHEMA).load(folder)
    d = d.select("*", F.coalesce(F.nullif(file_stem(F.col("filename")), F.lit("")), file_stem(_file())).alias("image_id"))
    o = d.select("image_id", F.col("size.width").alias("img_w"), F.col("size.height").alias("img_h"), F.posexplode("object").alias("pos", "o"))
    return o.select("image_id", "pos", "img_w", "img_h", "o.name", "o.difficult", "o.bndbox.*")


def read_sku(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SKU_SCHEMA).csv(path).withColumnRenamed("image", "image_id")


def read_visdrone(spark: SparkSession, folder: str, named: bool = False) -> DataFrame:
    """Boxes of annotation lines; the image is the file's, or with ``named`` the line's first cell."""
    schema = "left double, top double, width double, height double, score int, category int, truncation int, occlusion int"
    if named:
        return spark.read.schema(f"image_id string, {schema}").option("recursiveFileLookup", True).csv(folder)
    return spark.read.schema(schema).option("recursiveFileLookup", True).csv(folder).select(image_of(_file()).alias("image_id"), "*")


def read_xview(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    schema = "features array<struct<properties:struct<bounds_imcoords:string,image_id:string,type_id:int>>>"
    d = _documents(spark, path, schema, lines)
    return d.select(F.explode("features").alias("f")).select("f.properties.*").where("bounds_imcoords <> ''")


def read_signs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Traffic-sign file whose images are a map keyed by id."""
    schema = "imgs map<string,struct<path:string,objects:array<struct<category:string,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>>>"
    d = _documents(spark, path, schema, lines).select(F.explode("imgs").alias("image_id", "v"))
    split = F.when(F.contains(F.col("v.path"), F.lit("train")), "train").when(F.contains(F.col("v.path"), F.lit("test")), "test").otherwise("val")
    return d.select("image_id", "v.path", split.alias("split"), F.explode("v.objects").alias("o")).select("image_id", "path", "split", "o.category", "o.bbox.*")


def read_argoverse(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Annotations whose image and sequence folder are given by position in their document."""
    schema = "images array<struct<name:string,sid:int>>, seq_dirs array<string>, annotations array<struct<image_id:int,category_id:int,bbox:array<double>>>"
    def placed(a: Column, i: Column) -> Column:
        image = F.get("images", a["image_id"])
        stem = file_stem(image["name"])
        return F.struct(i.alias("ann_id"), a["image_id"].alias("image_pos"), a["category_id"].alias("category_id"), a["bbox"].alias("bbox"), image["name"].alias("name"),
                        F.concat_ws("/", F.get("seq_dirs", image["sid"]), stem).alias("image_id"))

    d = _documents(spark, path, schema, lines).select(F.explode(F.transform("annotations", placed)).alias("a")).select("a.*").where("name IS NOT NULL")
    return d.select("*", *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("left", "top", "width", "height"))]).drop("bbox")


def read_objects365(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """As ``read_coco`` with the class number given by the position of its category, alike in all documents."""
    doc = _documents(spark, path, "categories array<struct<id:int,name:string>>", lines)
    cats = doc.select(F.posexplode("categories").alias("cls", "c")).select("cls", F.col("c.id").alias("category_id")).distinct()
    return read_coco(spark, path, lines).join(cats, "category_id").withColumn("category_id", F.col("cls")).drop("cls")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(technique, threshold) from a flat or nested JSON object; values that are no numbers are skipped."""
    raw = spark.read.text(path, wholetext=True)
    nested = F.get_json_object("value", "$.thresholds")
    pairs = F.from_json(F.coalesce(nested, F.col("value")), "map<string,string>")
    return raw.select(F.explode(pairs).alias("k", "v")).select(T.normalize_key(F.col("k")).alias("technique"), F.col("v").try_cast("double").alias("threshold")).where("threshold IS NOT NULL")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("points array<array<double>>").option("multiLine", True).json(path)
    pts = F.transform("points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    ranked = rank_rows(d.select(pts.alias("pts"), F.monotonically_increasing_id().alias("_id")), [], [F.col("_id")], F.floor(F.col("_id") / 65536), "_k")
    return ranked.select((F.col("_k") - 1).alias("region_id"), F.concat(F.lit("region_"), (F.col("_k") - 1).cast("string")).alias("name"), "pts")


def read_pose_library(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of saved pose arrays: technique, angle, frame, joints; arrays of another shape are left out.

    An ingest job: binary files are decoded inside tasks, one file at a time; store the result as Parquet.
    """
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root).select("path", "content")

    def decode(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                except ValueError:
                    continue
                a = a[None] if a.ndim == 2 else a.reshape(-1, *a.shape[-3:])[0] if a.ndim > 3 else a
                if a.ndim != 3 or a.shape[-1] < 2:
                    continue
                parts = path.rsplit(root.split(":")[-1], 1)[-1].strip("/").rsplit(".", 1)[0].split("/")
                technique, angle = (parts[0], "default") if len(parts) == 1 else (parts[-2], parts[-1])
                for i, frame in enumerate(a.astype(float)):
                    joints = [{"x": None if np.isnan(p[0]) else p[0], "y": None if np.isnan(p[1]) else p[1], "c": p[2] if len(p) > 2 else 1.0} for p in frame]
                    out.append((technique, angle, i, joints))
            yield pd.DataFrame(out, columns=["technique", "angle", "frame", "kpts"])

    raw = files.mapInPandas(decode, "technique string, angle string, frame bigint, kpts array<struct<x:double,y:double,c:double>>")
    return raw.withColumn("technique", T.normalize_key(F.col("technique"))).withColumn("angle", T.normalize_key(F.col("angle")))


def list_media(spark: SparkSession, folder: str, fraction: float = 1.0) -> DataFrame:
    """Image files below a folder by path; with ``fraction`` the first share of them in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime").where(is_image(F.col("path")))
    if fraction >= 1.0:
        return files
    ranked = sorted_rank(files, [F.col("path")], "_k")
    return ranked.where(F.col("_k") <= files.agg(F.round(F.count("*") * fraction)).scalar()).drop("_k")


def read_trials(spark: SparkSession, path: str, params: list[str]) -> DataFrame:
    """Tuning rows with their number in file order."""
    schema = ", ".join(f"`{c}` double" for c in ["fitness", *params])
    d = spark.read.schema(schema).option("header", True).csv(path).withColumn("_id", F.monotonically_increasing_id())
    return rank_rows(d, [], [F.col("_id")], F.floor(F.col("_id") / 65536), "iteration").drop("_id")


def read_training_results(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """All ``results*.csv`` as rows (run, epoch, key, kind, value); metric and loss columns are told apart by name."""
    schema = ", ".join(f"`{c}` double" for c in columns)
    d = spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", True).option("recursiveFileLookup", True).option("pathGlobFilter", "results*.csv").csv(folder)
    d = d.select(file_stem(_file()).alias("run"), "*").withColumnRenamed(columns[0], "epoch")
    keys = [c for c in columns[1:] if "metric" in c or "loss" in c]
    long = d.select("run", "epoch", *[F.col(f"`{k}`") for k in keys]).unpivot(["run", "epoch"], [F.col(f"`{k}`") for k in keys], "key", "value")
    return long.withColumn("kind", F.when(F.contains(F.col("key"), F.lit("loss")), "loss").otherwise("metric"))


def read_eval_log(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """Per-class and total rows of a validation log: images, targets, precision, recall, two mean precisions."""
    w = F.filter(F.split(F.trim("value"), r"\s+"), lambda s: s != "")
    d = spark.read.text(path).select(w.alias("w")).where((F.size("w") >= 7) & F.get("w", F.lit(0)).isin([*classes, "all"]))
    num = lambda i: F.get("w", F.lit(i)).try_cast("double")
    cols = ["images", "targets", "precision", "recall", "map50", "map"]
    out = d.select(F.get("w", F.lit(0)).alias("class"), *[num(i + 1).alias(c) for i, c in enumerate(cols)])
    return out.where(" AND ".join(f"{c} IS NOT NULL" for c in cols))


def class_folders(files: DataFrame) -> DataFrame:
    """Class name from the folder of each file and its number by sorted name."""
    d = files.withColumn("cls_name", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    names = d.select("cls_name").distinct().withColumn("cls", (F.dense_rank().over(Window.orderBy("cls_name")) - 1).cast("int"))
    return d.join(names, "cls_name")
