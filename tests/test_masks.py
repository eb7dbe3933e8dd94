import numpy as np
import pytest
from pyspark.sql import functions as F

from visiontables.operators import tracks as TR


@pytest.mark.parametrize("threshold, size", [(None, 1024), (None, 40), (0.3, 40), (0.3, 1024)])
def test_mask_iou_equals_pixels(spark, threshold, size):
    rnd = np.random.default_rng(6)
    masks = {s: [np.repeat(rnd.random(60) < p, 8) for p in rnd.uniform(0.02, 0.95, 12)] for s in "ab"}
    masks["a"][0][:] = True  # one run over the whole image
    masks["b"][0] = masks["a"][3].copy()

    def runs(side):
        rows = [(0, i, m.astype(int).tolist()) for i, m in enumerate(masks[side])]
        d = spark.createDataFrame(rows, f"image_id int, {side}_id int, mask array<int>")
        d = d.withColumn("counts", TR.run_length_encode(F.col("mask")))
        return TR.mask_runs(d, ["image_id", f"{side}_id"], "counts")

    got = {(r.a_id, r.b_id): r.iou for r in TR.mask_iou(runs("a"), runs("b"), ["image_id"], threshold, size).collect()}
    want = {(i, j): (x & y).sum() / (x | y).sum() for i, x in enumerate(masks["a"]) for j, y in enumerate(masks["b"]) if (x & y).any()}
    assert got == pytest.approx({k: v for k, v in want.items() if threshold is None or v >= threshold}, abs=1e-6)
