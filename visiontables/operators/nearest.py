"""Exact nearest items by inner product, with a table of pivots that rules out most of the items."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visiontables.operators.stages import materialize

#: Shares of a pivot's reach by which its items are cut into rings.
RINGS = 8
#: Pivots at most, unless the caller names a number; few items have fewer, so that rings stay worth a task.
PIVOTS = 256
#: A bound may lie this far below a product, relative to the lengths, because of rounding.
SLACK = 1e-9


def _vectors(df: DataFrame, name: str) -> DataFrame:
    """(name, embedding) in doubles; rows without a vector or with a component that is no finite number take no part."""
    vec = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(name, vec.alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def _pivots(items: DataFrame, n: int) -> np.ndarray:
    """The vectors of the ``n`` items that come first by a hash of their id: at most n rows reach the driver."""
    rows = items.orderBy(F.xxhash64("item_id"), "item_id").limit(n).select("embedding").collect()
    return np.unique(np.array([r[0] for r in rows], dtype=float), axis=0) if rows else np.zeros((0, 0))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def place_items(items: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(item_id, embedding, _p, _d, _norm): each item's nearest pivot, its distance from it and its own length."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["embedding"])
                home = _distances(x, pivots).argmin(1)
                yield pdf.assign(_p=home.astype(np.int32), _d=np.linalg.norm(x - pivots[home], axis=1), _norm=np.linalg.norm(x, axis=1))

    return items.mapInPandas(run, "item_id bigint, embedding array<double>, _p int, _d double, _norm double")


def ring_table(placed: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
    """The items with their ring, and the rings: pivot, ring, number of items, least and greatest distance, greatest length.

    There are at most RINGS rings a pivot, so the table has a bounded number of rows however many items there are.
    """
    reach = placed.groupBy("_p").agg(F.max("_d").alias("_reach"))
    ring = F.least(F.coalesce(F.floor(F.try_divide(F.col("_d") * RINGS, F.col("_reach"))), F.lit(0)), F.lit(RINGS - 1)).cast("int")
    ringed = placed.join(reach, "_p").withColumn("_r", ring).drop("_reach")
    table = ringed.groupBy("_p", "_r").agg(F.count("*").alias("n"), F.min("_d").alias("low"), F.max("_d").alias("high"), F.max("_norm").alias("norm"))
    return ringed, table.toPandas().sort_values(["_p", "_r"], ignore_index=True)


def ring_bounds(x: np.ndarray, pivots: np.ndarray, rings: pd.DataFrame) -> np.ndarray:
    """No item of a ring has a greater product with a query than this: one row a query, one column a ring.

    The distance of a query from an item is at least the gap between its distance from the pivot and the ring, and the product
    follows from that distance and the two lengths. Also, the product grows from the pivot's by at most length times distance.
    """
    p, low, high, norm = (rings[c].to_numpy() for c in ("_p", "low", "high", "norm"))
    away, length = _distances(x, pivots)[:, p], np.linalg.norm(x, axis=1)[:, None]
    gap = np.maximum(np.maximum(away - high, low - away), 0)
    # a gap is only as exact as the distances it comes from
    gap = np.maximum(gap - 1e-6 * (length + norm), 0)
    by_distance = (length ** 2 + norm ** 2 - gap ** 2) / 2
    by_pivot = (x @ pivots.T)[:, p] + length * high
    return np.minimum(np.minimum(by_distance, by_pivot), length * norm) + SLACK * (1 + length * norm)


def _meetings(queries: DataFrame, pivots: np.ndarray, rings: pd.DataFrame, k: int, chunk: int, rest: bool) -> DataFrame:
    """Queries with each part of each ring they have to meet: (_b, query_id, embedding, least, _p, _r, _s).

    First the rings nearest to the query that hold k items together. With ``rest``, of the other rings all whose bound
    reaches ``least``, what the query already has for sure.
    """
    p, r, n = (rings[c].to_numpy() for c in ("_p", "_r", "n"))
    parts = np.maximum(1, -(-n // chunk))

    def run(batches):
        for pdf in (batch[low:low + 64] for batch in batches for low in range(0, len(batch), 64)):
            x = np.stack(pdf["embedding"])
            bounds, like = ring_bounds(x, pivots, rings), (x @ pivots.T)[:, p]
            by_like = np.argsort(-like, axis=1, kind="stable")
            before = np.cumsum(n[by_like], axis=1) - n[by_like]
            first = np.zeros(like.shape, bool)
            np.put_along_axis(first, by_like, before < k, axis=1)
            # in the first round, too, a ring that can't reach the floor is left out
            q, ring = np.nonzero((~first if rest else first) & (bounds >= pdf["least"].to_numpy()[:, None]))
            if not len(q):
                continue
            part = np.concatenate([np.arange(m) for m in parts[ring]])
            q, ring = np.repeat(q, parts[ring]), np.repeat(ring, parts[ring])
            yield pd.DataFrame({"_b": pdf["_b"].to_numpy()[q], "query_id": pdf["query_id"].to_numpy()[q], "embedding": list(x[q]),
                                "least": pdf["least"].to_numpy()[q], "_p": p[ring], "_r": r[ring], "_s": part.astype(np.int32)})

    return queries.mapInPandas(run, "_b int, query_id bigint, embedding array<double>, least double, _p int, _r int, _s int")


def _best(met: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, sim) of the k best items of each part that a query meets, as far as they reach its ``least``."""
    part = ["_b", "_p", "_r", "_s"]
    asking = met.select(*[F.col(c).alias(f"_of{c}") for c in part]).distinct()
    same = (F.col("_p") == F.col("_of_p")) & (F.col("_r") == F.col("_of_r")) & (F.col("_s") == F.col("_of_s"))
    wanted = items.join(asking, same).select("_of_b", "_of_p", "_of_r", "_of_s", "item_id", "embedding")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "sim": []})
        sims, ids = np.stack(left["embedding"]) @ np.stack(right["embedding"]).T, right["item_id"].to_numpy()
        least = left["least"].to_numpy() - SLACK
        if sims.shape[1] > k:
            least = np.maximum(least, -np.partition(-sims, k - 1, axis=1)[:, k - 1])
        q, i = np.nonzero(sims >= least[:, None])
        order = np.lexsort((ids[i], -sims[q, i], q))
        q, i = q[order], i[order]
        # many may tie with the k-th: of those the least ids stay
        taken = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, i = q[taken], i[taken]
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[q], "item_id": ids[i], "sim": sims[q, i]})

    return met.groupBy(*part).cogroup(wanted.groupBy(*[f"_of{c}" for c in part])).applyInPandas(score, "query_id bigint, item_id bigint, sim double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "item_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _prepared(queries: DataFrame, items: DataFrame, k: int, min_sim: float, block: int, chunk: int, pivots: int | None):
    """Queries in blocks, items in the parts of their rings (both written once), the pivots and the table of rings."""
    items, queries = _vectors(items, "item_id"), materialize(_vectors(queries, "query_id"), "queries")
    centres = _pivots(items, pivots or min(PIVOTS, 1 + int(items.count() ** 0.5 / 4)))
    blocks = int(queries.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block))).first()[0])
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_b"), "query_id", "embedding", F.lit(float(min_sim)).alias("least"))
    if not len(centres):
        return asked, None, centres, None
    ringed, rings = ring_table(materialize(place_items(items, centres), "placed"))
    parts = ringed.groupBy("_p", "_r").agg(F.ceil(F.count("*") / chunk).alias("_n"))
    cut = ringed.join(parts, ["_p", "_r"]).withColumn("_s", F.pmod(F.xxhash64("item_id"), F.col("_n")).cast("int"))
    return asked, cut.select("_p", "_r", "_s", "item_id", "embedding"), centres, rings


def knn_rounds(queries: DataFrame, items: DataFrame, k: int, min_sim: float, block: int, chunk: int, pivots: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """The meetings of the first round and what it finds (written once), those of the second and what it finds; None without items."""
    asked, cut, centres, rings = _prepared(queries, items, k, min_sim, block, chunk, pivots)
    if cut is None:
        return None
    near = _meetings(asked, centres, rings, k, chunk, rest=False)
    found = materialize(_ranked(_best(near, cut, k), k).drop("rank"), "nearest")
    sure = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("sim")).alias("_sure"))
    known = asked.join(sure, "query_id", "left").withColumn("least", F.greatest("least", F.col("_sure") - SLACK)).select(*asked.columns)
    far = _meetings(known, centres, rings, k, chunk, rest=True)
    return near, found, far, _best(far, cut, k)


def knn(queries: DataFrame, items: DataFrame, k: int = 30, min_sim: float = 0.1, block: int = 512, chunk: int = 20000, pivots: int | None = None) -> DataFrame:
    """Exact top-k items by inner product: (query_id, item_id, sim, rank); ties by item_id.

    Every item goes to the nearest of ``pivots`` items (by default a quarter of the root of their number, up to PIVOTS) and there to a ring of its distance; a ring with more than ``chunk``
    items is dealt into parts. A query first meets the nearest rings that hold k items; their k-th best product is what the
    others have to reach, and by the triangle inequality most rings can't. Queries and items meet in blocks and parts, in
    one product of matrices, and an item is sent only to blocks that ask for its part. Vectors of any length and
    direction are fine; the closer the items lie to their pivots, the more is ruled out.

    At most ``pivots`` vectors and the table of their rings reach the driver. ``query_id`` must be unique. Rows whose vector is
    NULL, empty or not finite take no part; a query without an item that reaches ``min_sim`` has no rows.
    """
    rounds = knn_rounds(queries, items, k, min_sim, block, chunk, pivots)
    if rounds is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, item_id bigint, sim double, rank int")
    _, found, _, more = rounds
    return _ranked(found.unionByName(more).where(F.col("sim") >= min_sim), k)
