"""Curves follow from a few bytes a detection; what is written of them holds no arrays."""

from pyspark.sql import functions as F

from visiontables.operators import evaluate as E


def test_only_sorted_hits_are_written(spark):
    table = spark.range(2000).selectExpr("id AS det_id", "CAST(id % 3 AS INT) AS cls", "(id * 7 % 1000) / 1000D AS conf", "array(CAST(id % 2 AS INT), CAST(id % 5 = 0 AS INT)) AS tp")
    totals = spark.createDataFrame([(k, 400) for k in range(3)], "cls int, n_l long")
    pr = E.precision_recall(table, totals, 2)
    written = spark.read.parquet(*pr.inputFiles())
    assert sorted(written.columns) == ["_hits", "_id", "cls", "conf", "det_id"]
    env = E.precision_envelope(pr, 2)
    last = env.groupBy("cls").agg(F.max_by("tpc", "rank").alias("t"), F.sum(F.col("tp")[0]).alias("a"), F.sum(F.col("tp")[1]).alias("b")).collect()
    assert all(list(r.t) == [r.a, r.b] for r in last) and sum(r.a for r in last) == 1000 and sum(r.b for r in last) == 400
