import numpy as np
import pytest

from visiontables.operators import runs as RU


def test_boxplot_of_a_hot_key(spark):
    rnd = np.random.default_rng(5)
    groups = {"hot": [*rnd.normal(50, 9, 900).tolist(), *[50.0] * 700, 500.0], "two": [1.0, 2.0], "one": [7.0], "tie": [3.0] * 9, "gap": [None, 4.0, 8.0, None, 5.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None)]
    out = {r.k: r for r in RU.score_boxplot(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert set(out) == {*groups, "none"}
    for k, vs in groups.items():
        v = np.array([x for x in vs if x is not None])
        q = np.quantile(v, [0.25, 0.5, 0.75])
        low, high = q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])
        assert (out[k].q1, out[k].median, out[k].q3) == pytest.approx(tuple(q))
        assert (out[k].n, out[k].whisker_low, out[k].whisker_high, out[k].outliers) == (len(vs), v[v >= low].min(), v[v <= high].max(), int(((v < low) | (v > high)).sum()))
    assert (out["none"].n, out["none"].q1, out["none"].outliers) == (1, None, 0)
