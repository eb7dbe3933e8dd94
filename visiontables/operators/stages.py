"""Cut a long plan by writing an intermediate table to the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the context's checkpoint folder.

    Where neither is set, a local master gets a temporary folder; on a cluster, whose workers would each write to their own
    disk, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all workers share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once, read many: later branches scan only the columns they need, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._stage_path = path
    return written


def discard(stage: DataFrame) -> None:
    """Delete what ``materialize`` wrote; nothing lazy may still read it."""
    spark = stage.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stage._stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
