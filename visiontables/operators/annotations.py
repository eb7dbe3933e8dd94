"""Label checks, statistics, splits and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.operators.ordered import rank_rows

# File endings read as images (fixed values).
IMAGE_SUFFIXES = ["avif", "bmp", "dng", "heic", "heif", "jp2", "jpeg", "jpeg2000", "jpg", "mpo", "png", "tif", "tiff", "webp"]


def image_to_label_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^(.*)/images/(.*)\.[^.]*$", "$1/labels/$2.txt")


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).isin(IMAGE_SUFFIXES)


def manifest_hash(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """sha256 over the total size and the paths in sorted order; missing files (NULL size) count 0.

    Paths are hashed one by one and folded per block, so that no list of all paths is built in one place.
    """
    block = F.substring(F.sha2(F.col("path"), 256), 1, 2)
    per = files.withColumn("_blk", block).groupBy(*keys, "_blk").agg(
        F.sum(F.coalesce("size", F.lit(0))).alias("_s"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("path", 256))), ""), 256).alias("_h"))
    return per.groupBy(*keys).agg(F.sha2(F.concat(F.sum("_s").cast("string"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_blk", "_h"))), lambda s: s["_h"]), "")), 256).alias("manifest"))


def verify_labels(labels: DataFrame, nc: int, single_cls: bool = False) -> DataFrame:
    """Each label row with the first rule it breaks in ``reason`` (NULL when clean)."""
    cols = [F.col(c) for c in ("xc", "yc", "bw", "bh")]
    big, low = F.greatest(*cols), F.least(F.col("cls").cast("double"), *cols)
    top = F.lit(0) if single_cls else F.col("cls")
    reason = (F.when((F.col("w") <= 9) | (F.col("h") <= 9), "image_too_small").when(F.col("n_columns") != 5, "column_count")
              .when(big > 1.01, "out_of_bounds").when(low < -0.01, "negative").when(top >= nc, "class_exceeds_count"))
    return labels.withColumn("reason", reason)


def label_status(images: DataFrame, checked: DataFrame) -> DataFrame:
    """found / missing / empty / corrupt per image. ``images``: image_id, has_file; one bad row makes a file corrupt."""
    per = checked.groupBy("image_id").agg(F.count("*").alias("n"), F.count("reason").alias("bad"))
    status = (F.when(~F.col("has_file"), "missing").when(F.coalesce("n", F.lit(0)) == 0, "empty").when(F.col("bad") > 0, "corrupt").otherwise("found"))
    return images.join(per, "image_id", "left").select("image_id", status.alias("status"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def distinct_labels(labels: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct rows per image and how many doubles each image had."""
    per = labels.groupBy("image_id", *cols).agg(F.count("*").alias("_n"))
    return per.drop("_n"), per.groupBy("image_id").agg(F.sum(F.col("_n") - 1).alias("removed"))


def label_stats(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Per class and in total (cls NULL): instances, images with the class, images without any label."""
    per = labels.groupBy("image_id", "cls").agg(F.count("*").alias("n"))
    by_class = per.groupBy("cls").agg(F.sum("n").alias("instances"), F.count("*").alias("images"), F.lit(None).cast("bigint").alias("unlabelled"))
    have = per.groupBy("image_id").agg(F.sum("n").alias("n"))
    total = images.join(have, "image_id", "left").agg(F.sum("n").alias("instances"), F.count("*").alias("images"), F.count_if(F.col("n").isNull()).alias("unlabelled"))
    return by_class.unionByName(total.withColumn("cls", F.lit(None).cast("int")))


def class_frequency(labels: DataFrame, names: Column) -> DataFrame:
    """Instances per text; a class name may hold several texts split by ``/``. ``names`` maps the class to its name."""
    per = labels.groupBy("cls").agg(F.count("*").alias("n")).withColumn("_t", F.explode(F.split(names, "/")))
    return per.groupBy(F.trim("_t").alias("text")).agg(F.sum("n").alias("n"))


def frequent(freq: DataFrame, cap: int = 100) -> DataFrame:
    """Texts at least as frequent as the cap, or as the most frequent one where that is below the cap."""
    return freq.where(F.col("n") >= freq.agg(F.least(F.max("n"), F.lit(cap))).scalar())


def dataset_inventory(files: DataFrame) -> DataFrame:
    """Images and class folders per split, with the split that stands in where one is absent.

    ``files``: split, folder, path. val falls back to validation, valid, then test; test to val.
    """
    per = files.where(is_image(F.col("path"))).groupBy("split").agg(F.count("*").alias("images"), F.count_distinct("folder").alias("folders"))
    wide = per.groupBy().agg(*[F.max(F.when(F.col("split") == s, F.struct("split", "images", "folders"))).alias(s) for s in ("train", "val", "validation", "valid", "test")])
    val = F.coalesce("val", "validation", "valid")
    rows = F.array(*[F.struct(F.lit(n).alias("split"), c.alias("s")) for n, c in (("train", F.col("train")), ("val", F.coalesce(val, "test")), ("test", F.coalesce(F.col("test"), val)))])
    out = wide.select(F.col("train.folders").alias("nc"), F.explode(rows).alias("r"))
    return out.select("r.split", F.col("r.s.split").alias("source"), F.col("r.s.images").alias("images"), F.col("r.s.folders").alias("folders"),
                      (F.col("r.s.folders") != F.col("nc")).alias("mismatch"))


def instance_count_check(labels: DataFrame, expected: dict[int, int]) -> DataFrame:
    """Classes whose number of instances is not the expected one."""
    want = F.try_element_at(F.create_map(*[F.lit(v) for kv in expected.items() for v in kv]), F.col("cls"))
    n = labels.groupBy("cls").agg(F.count("*").alias("n")).withColumn("expected", want.cast("bigint"))
    return n.withColumn("matches", F.coalesce(F.col("n") == F.col("expected"), F.lit(False)))


def _ends(df: DataFrame, x: str, y: str) -> DataFrame:
    """The rows with the extremes of two columns in struct _e."""
    ends = df.agg(F.struct(*[f(c).alias(f"{n}{i}") for i, c in enumerate((x, y)) for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    return df.withColumn("_e", ends)


def _share(c: str, i: int) -> Column:
    return (F.col(c) - F.col(f"_e.lo{i}")) / (F.col(f"_e.hi{i}") - F.col(f"_e.lo{i}"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Counts over bins x bins even cells between the extremes; the last cell is closed on both sides."""
    cell = lambda c, i: F.least(F.floor(_share(c, i) * bins), F.lit(bins - 1)).cast("int")
    return _ends(df, x, y).groupBy(cell(x, 0).alias("i"), cell(y, 1).alias("j")).agg(F.count("*").alias("n"))


def density(df: DataFrame, key: str, x: str, y: str, bins: int = 20) -> DataFrame:
    """Each row with the count of its cell, cells read closed on the right (the least value reads the last cell)."""
    cell = lambda c, i: F.pmod(F.least(F.ceil(_share(c, i) * bins) - 1, F.lit(bins - 1)), F.lit(bins)).cast("int")
    rows = _ends(df, x, y).select(key, cell(x, 0).alias("i"), cell(y, 1).alias("j"))
    return rows.join(histogram_2d(df, x, y, bins), ["i", "j"], "left").select(key, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def category_texts(anns: DataFrame) -> DataFrame:
    """Phrase of each annotation from the caption spans (start, stop pairs), numbered per image by first appearance.

    ``anns``: image_id, pos, caption, tokens array<struct<a,b>>.
    """
    phrase = F.trim(F.lower(F.array_join(F.transform("tokens", lambda t: F.substr(F.col("caption"), t["a"] + 1, t["b"] - t["a"])), " ")))
    d = anns.select("image_id", "pos", phrase.alias("text")).where("text <> ''")
    first = d.groupBy("image_id", "text").agg(F.min("pos").alias("_p"))
    number = first.withColumn("cls", (F.dense_rank().over(Window.partitionBy("image_id").orderBy("_p")) - 1).cast("int"))
    return d.join(number.drop("_p"), ["image_id", "text"])


# --- splits ------------------------------------------------------------------------------------------------------

def unit_hash(text: Column) -> Column:
    """Stable number in [0, 1) from a text, the same on any engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2 ** 32)


def autosplit(files: DataFrame, weights=(0.9, 0.1, 0.0), labelled: DataFrame | None = None, seed: str = "") -> DataFrame:
    """train / val / test by a hash of the path; with ``labelled`` only files whose label path is in it."""
    rows = files
    if labelled is not None:
        rows = rows.withColumn("_l", image_to_label_path(F.col("path"))).join(labelled.select(F.col("path").alias("_l")), "_l", "left_semi").drop("_l")
    u = unit_hash(F.concat(F.lit(seed), F.col("path"))) * float(sum(weights))
    return rows.withColumn("split", F.when(u < weights[0], "train").when(u < weights[0] + weights[1], "val").otherwise("test"))


def stratified_split(files: DataFrame, cls: str, ratio: float = 0.8) -> DataFrame:
    """The first int(n * ratio) files of each class in hash order go to train, the rest to val."""
    h = F.md5("path")
    ranked = rank_rows(files.withColumn("_h", h), [cls], [F.col("_h"), F.col("path")], F.substring(h, 1, 3), "_k")
    n = files.groupBy(cls).agg(F.count("*").alias("_n"))
    return ranked.join(n, cls).withColumn("split", F.when(F.col("_k") <= F.floor(F.col("_n") * ratio), "train").otherwise("val")).drop("_h", "_k", "_n")


def negative_texts(images: DataFrame, present: str, num_classes: int, n: int, max_samples: int | None = None) -> DataFrame:
    """Class numbers not in the image, n of them in hash order, without passing ``max_samples`` in all if that is given."""
    have = F.array_distinct(F.col(present))
    rest = F.array_except(F.sequence(F.lit(0), F.lit(num_classes - 1)), have)
    shuffled = F.array_sort(F.transform(rest, lambda c: F.struct(F.md5(F.concat_ws(":", F.col("image_id").cast("string"), c.cast("string"))).alias("h"), c.alias("c"))))
    take = F.greatest(F.lit(0), F.least(F.lit(n), F.lit(num_classes if max_samples is None else min(num_classes, max_samples)) - F.size(have)))
    return images.withColumn("negatives", F.transform(F.slice(shuffled, F.lit(1), take), lambda s: s["c"]))


# --- exports -----------------------------------------------------------------------------------------------------

def coco_predictions(dets: DataFrame, class_map: Column, file_name: str = "file_name") -> DataFrame:
    """Rows of the prediction exchange form: left-top box with 3 decimals, score with 5."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    lt = B.xyxy_to_ltwh(B.box())
    return dets.select("det_id", stem.alias("stem"), stem.try_cast("bigint").alias("image_id"), file_name, class_map.alias("category_id"),
                       *[F.round(c, 3).alias(n) for c, n in zip(lt, ("left", "top", "width", "height"))], F.round("conf", 5).alias("score"))


def frame_summary(dets: DataFrame, names: Column, digits: int = 5, size: tuple | None = None) -> DataFrame:
    """One row per frame with its detections as an array of structs, most confident first; a frame's list is bounded
    by the detections a frame may hold."""
    w, h = size or (F.lit(1.0), F.lit(1.0))
    b = B.box()
    item = F.struct((-F.col("conf")).alias("_o"), names.alias("name"), F.col("cls").alias("class"), F.round("conf", digits).alias("confidence"), F.struct(
        *[F.round(c / s, digits).alias(n) for c, s, n in zip(b, (w, h, w, h), ("x1", "y1", "x2", "y2"))]).alias("box"))
    per = dets.groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias("_l"))
    return per.select("image_id", F.transform("_l", lambda s: s.dropFields("_o")).alias("results"))


def verbose(images: DataFrame, dets: DataFrame, names: Column) -> DataFrame:
    """"2 persons, 1 car, " per frame by class number; "(no detections), " for empty frames."""
    per = dets.groupBy("image_id", "cls").agg(F.count("*").alias("n"))
    word = F.concat(F.col("n").cast("string"), F.lit(" "), names, F.when(F.col("n") > 1, "s").otherwise(""), F.lit(", "))
    text = per.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("cls", word.alias("w")))).alias("_l"))
    line = F.array_join(F.transform("_l", lambda s: s["w"]), "")
    return images.select("image_id").join(text, "image_id", "left").select("image_id", F.coalesce(line, F.lit("(no detections), ")).alias("verbose"))


def concat_instances(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
