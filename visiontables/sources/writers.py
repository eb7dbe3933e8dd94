"""Writers; every one leaves directories of part files, written by tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visiontables.functions import boxes as B


def append_run_metrics(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append scored rows, one folder per run."""
    w = df.write.mode("append").partitionBy("run_id")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def number_text(c: Column, digits: int = 6) -> Column:
    """Shortest text of a number with up to ``digits`` significant digits."""
    value = c.cast("double")
    size = F.when(value == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(value)))).cast("int")
    rounded = F.round(value * F.pow(F.lit(10.0), digits - 1 - size)) / F.pow(F.lit(10.0), digits - 1 - size)
    text = F.format_string("%.12f", rounded)
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def label_lines(labels: DataFrame, numbers: Column | None = None, conf: str | None = None) -> DataFrame:
    """Label rows as text: class, then the box or the given numbers, then the confidence if asked for."""
    nums = numbers if numbers is not None else F.array("xc", "yc", "bw", "bh")
    parts = F.concat(F.array(F.col("cls").cast("string")), F.transform(nums, lambda v: number_text(v)), *([F.array(number_text(F.col(conf)))] if conf else []))
    return labels.select("image_id", F.array_join(parts, " ").alias("value"))


def write_label_text(labels: DataFrame, path: str, numbers: Column | None = None, conf: str | None = None, named: bool = False) -> None:
    """One folder of text per image, ``image_id=<id>``; rows of an image meet first, a crowded image may be several part files.

    A set of very many images takes longer to make its folders than all else: ``named`` lines begin with the image and a tab instead,
    and any number of images share a file.
    """
    if named:
        lines = label_lines(labels, numbers, conf)
        lines.select(F.concat(F.col("image_id").cast("string"), F.lit("\t"), "value").alias("value")).write.mode("overwrite").text(path)
        return
    label_lines(labels, numbers, conf).hint("rebalance", "image_id").write.mode("overwrite").partitionBy("image_id").text(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """Prediction exchange rows as JSON lines; the id is a number where the file stem is one."""
    box = F.array("left", "top", "width", "height").alias("bbox")
    rows.select(F.coalesce(F.col("image_id").cast("string"), F.col("stem")).alias("image_id"), "file_name", "category_id", box, "score").write.mode("overwrite").json(path)


def oriented_lines(dets: DataFrame, names: Column) -> DataFrame:
    """Exchange lines of oriented boxes: image, score, eight coordinates; the class name says the file."""
    pts = [v for xy in B.obb_corners(B.obb()) for v in xy]
    nums = [F.round(F.col("conf"), 3), *[F.round(v, 3) for v in pts]]
    line = F.concat_ws(" ", F.col("image").cast("string"), *[n.cast("string") for n in nums])
    return dets.select(F.replace(names, F.lit(" "), F.lit("-")).alias("classname"), line.alias("value"))


def write_oriented(dets: DataFrame, path: str, names: Column) -> None:
    oriented_lines(dets, names).write.mode("overwrite").partitionBy("classname").text(path)


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Any summary as csv, json or parquet; nested columns become JSON text in csv."""
    if fmt == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType)
        df = df.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    df.write.mode("overwrite").format(fmt).save(path)


def write_split_lists(files: DataFrame, path: str, prefix: str = "./") -> None:
    """One folder of path lists per split."""
    files.select("split", F.concat(F.lit(prefix), F.col("path")).alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_tables(tables: dict[str, DataFrame], root: str, partition: Sequence[str] = ()) -> None:
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition) if partition else w).parquet(f"{root}/{name}")
