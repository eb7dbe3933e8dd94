"""Copies made by explode are not in Spark's size estimates; joins of them must not be broadcast through the driver."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["joi22_free_areas", "fun06_mask_iou"])
def test_copies_are_not_broadcast(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_runs_of_matched_masks_are_not_broadcast(spark):
    from visiontables.operators import match as M
    from visiontables.operators import tracks as T
    runs = lambda s: spark.range(50).selectExpr("id AS image_id", f"id AS {s}_id", "id * 10 AS start", "id * 10 + 5 AS stop")
    ious = T.mask_iou(runs("a"), runs("b"), ["image_id"], threshold=0.5).selectExpr("a_id AS det_id", "b_id AS gt_id", "iou")
    dets = spark.range(50).selectExpr("id AS det_id", "0.5D AS conf")
    assert "BroadcastExchange" not in M.mask_candidates(ious, dets)._jdf.queryExecution().executedPlan().toString()
