import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from visiontables.llm import cover_tree, hard_negatives
from visiontables.llm.queries import op12_hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, is_anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    """Every anchor against every row."""
    good = [(i, lab, [math.floor(scale * float(np.float32(x))) for x in v]) for i, lab, v in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (aid, alab, av) in enumerate(good):
        if not is_anchor(aid):
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), last(i), k, lab) for k, (i, lab, v) in enumerate(good) if k != a)
        for ps, _, p, _ in [s for s in scored if s[3] == alab][:positives]:
            inside = [s for s in scored if s[3] != alab and low * -ps <= 100 * -s[0] <= high * -ps][:negatives]
            out += [(aid, good[p][0], r + 1, good[s[2]][0], -ps, -s[0]) for r, s in enumerate(inside)]
    return sorted(out, key=str)


def _clustered(rng, n, d, centres):
    middle = rng.normal(size=(centres, d))
    v = middle[rng.integers(0, centres, n)] * rng.choice([0.3, 1.0, 1.2], size=(n, 1)) + rng.normal(size=(n, d)) * rng.choice([0.0, 0.05, 0.4], size=(n, 1))
    return [(int(i), int(rng.integers(0, 4)), [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize(("n", "d", "centres", "sizes"), [(400, 8, 6, dict(sample=50, cell=40, most_rows=60, block=7)), (300, 16, 300, dict(sample=300, cell=30)), (250, 3, 2, {})])
def test_same_as_brute_force(spark, n, d, centres, sizes):
    rows = _clustered(np.random.default_rng(n), n, d, centres)
    rows += [(n + k, r[1], r[2]) for k, r in enumerate(rows[:40])]  # equal vectors
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **sizes).collect()
    want = plain(rows, lambda i: i % 10 == 0)
    assert want and sorted(map(tuple, got), key=str) == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.6]), (2, 2, [0.7, 0.2]), (None, 2, [0.7, 0.2]), (3, 2, [0.7, 0.2]), (4, None, [1.0, 1.0]), (5, 1, None), (6, 1, [1.0, None]), (7, 2, [inf, 1.0]),
            (8, 2, [nan, 1.0]), (9, 2, [0.6]), (10, 1, []), (11, 3, [0.0, 0.0]), (0, 1, [1.0, 0.5]), (20, 1, [-1.0, -0.5]), (30, 7, [1.0, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("row", F.lit("mine")).withColumn("cell", F.lit(None))
    for sizes in ({}, dict(sample=2, cell=2, most_rows=3, block=2)):
        got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **sizes)
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows, lambda i: i is not None and i % 10 == 0)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).columns == got.columns
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_large_numbers(spark):
    rows = [(k, k % 3, [float(2 ** 18 + 7 * k), float(-(2 ** 17) * (k % 5))]) for k in range(60)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, lambda i: i == 0)
    with pytest.raises(ValueError, match="do not fit"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, 1, [1e9])], SCHEMA), F.lit(True))


def test_trees_skip_what_lies_outside():
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * (np.repeat(rng.normal(size=(20, 12)), 200, axis=0) + 0.02 * rng.normal(size=(4000, 12))))
    norm = float(np.linalg.norm(vectors, axis=1).max()) * (1 + 1e-9)
    order, levels = cover_tree.build(cover_tree.augmented(vectors, norm))
    assert sorted(order) == list(range(4000))
    for level in levels:
        for c, r, b, e in zip(level.centre, level.radius, level.begin, level.end, strict=True):
            points = cover_tree.augmented(vectors[order[b:e]], norm)
            assert c in order[b:e] and np.arccos(np.clip(points @ cover_tree.augmented(vectors[[c]], norm)[0], -1, 1)).max() <= r + 1e-6
    query = vectors[:1]
    leaf = levels[-1]
    low = float((vectors @ query[0]).max()) * 0.95
    _, most = cover_tree.interval(query, np.linalg.norm(query, axis=1), vectors[leaf.centre], leaf.radius, norm)
    assert (most >= low).mean() < 0.2


def test_query_on_the_given_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, op12_hard_negatives(spark, "/root/testdata/sf0.001").collect()), key=str) == plain(rows, lambda i: i % 50 == 0)
