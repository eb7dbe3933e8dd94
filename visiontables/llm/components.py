"""Connected components of an edge table, by alternating large and small stars.

Every round hangs each node's larger neighbours (large star), then its smaller ones (small star), on the smallest node it
sees; edges only ever move towards the smallest node of their component, and a component is done when it is a star. The
edges stay a table in the shared folder; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visiontables.operators.stages import discard, materialize

ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star over edges (u > v)."""
    seen = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
    least = seen.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    large = edges.join(least.withColumnRenamed("x", "v"), "v").select("u", F.col("m").alias("v")).distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node it is connected with.

    Loops, repeated edges and edges with a NULL end say nothing. No edges give an empty result. Raises if ``rounds``, which
    grow with the logarithm of the longest path, do not suffice.
    """
    start = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = materialize(start, "edges"), None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select("v", "v").distinct())
        before, last = state, now
        now = materialize(_stars(now), "edges")
        discard(last)
    raise RuntimeError(f"components are not done after {rounds} rounds")
