import numpy as np
import pytest
from pyspark.sql import functions as F

from visiontables.operators import nearest as NE

ITEM = "item_id bigint, embedding array<double>"
QUERY = "query_id bigint, embedding array<double>"


def frame(spark, vectors, schema):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], schema)


def plain(queries, items, k, min_sim):
    out = set()
    for q, v in enumerate(queries):
        sims = items @ v
        best = sorted(range(len(items)), key=lambda i: (-round(sims[i], 9), i))[:k]
        out |= {(q, i, rank) for rank, i in enumerate(best, 1) if sims[i] >= min_sim}
    return out


def clusters(rnd, centres, n):
    v = centres[rnd.integers(0, len(centres), n)] + rnd.normal(size=(n, centres.shape[1])) * 0.05
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("unit", [True, False])
def test_equal_to_all_pairs(spark, unit):
    rnd = np.random.default_rng(2)
    v, q = rnd.normal(size=(300, 8)), rnd.normal(size=(20, 8))
    if unit:
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[200:260] = v[0]  # a fifth of the items are copies, more than a part holds
    got = NE.knn(frame(spark, q, QUERY), frame(spark, v, ITEM), k=7, block=6, chunk=11, pivots=16).collect()
    assert {(r.query_id, r.item_id, r["rank"]) for r in got} == plain(q, v, 7, 0.1)


def test_most_parts_are_ruled_out(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 16))
    v, q = clusters(rnd, centres, 2000), clusters(rnd, centres, 30)
    args = (frame(spark, q, QUERY), frame(spark, v, ITEM), 10, 0.1, 1, 50, 64)
    near, _, far, _ = NE.knn_rounds(*args)
    pairs = [m.select("_b", "_p", "_r", "_s").distinct().count() for m in (near, far)]
    _, cut, _, _ = NE._prepared(*args)
    every = cut.select("_p", "_r", "_s").distinct().count() * near.unionByName(far).select("_b").distinct().count()
    assert sum(pairs) < every / 4
    got = NE.knn(*args[:2], k=10, block=1, chunk=50, pivots=64).collect()
    assert {(r.query_id, r.item_id, r["rank"]) for r in got} == plain(q, v, 10, 0.1)


def test_bounds_hold(spark):
    rnd = np.random.default_rng(4)
    v, q = rnd.normal(size=(400, 5)) * rnd.uniform(0.1, 9, (400, 1)), rnd.normal(size=(50, 5))
    pivots = v[:12]
    ringed, rings = NE.ring_table(NE.place_items(frame(spark, v, ITEM), pivots))
    bounds = NE.ring_bounds(q, pivots, rings)
    at = {(p, r): j for j, (p, r) in enumerate(zip(rings["_p"], rings["_r"]))}
    for row in ringed.collect():
        assert (q @ np.array(row.embedding) <= bounds[:, at[row._p, row._r]]).all()
    assert rings["n"].sum() == 400


def test_odd_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, []), (7, [1.0, 0.0]), (8, [-1.0, 0.0])]
    items = spark.createDataFrame(rows, ITEM)
    queries = items.select(F.col("item_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.item_id, r["rank"]) for r in NE.knn(queries, items, k=5).collect()}
    assert got == {(1, 1, 1), (1, 7, 2), (7, 1, 1), (7, 7, 2), (8, 8, 1)}
    assert NE.knn(queries, items.where("false")).count() == 0
    assert NE.knn(queries.where("false"), items).count() == 0
