"""Hard negatives by exact inner-product search in a forest of cover trees.

Rows are placed in cells around centres chosen farthest-first in a bounded sample; a cell's rows become cover trees of bounded
size, one row of a table each. A query is sent to the trees of those cells alone whose covering radius lets an inner product
fall into one of its windows. A window's lower end is first raised to the k-th score found in the sample, whose rows are rows
of the table like any others. Every tree returns its first k rows of each window and the best of those are the answer; the
sample and the cells decide what is skipped, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.llm import cover_tree as tree
from visiontables.operators.stages import materialize

#: Rows of the table that centres and first bounds come from, at most; the first ones by hash.
SAMPLE = 2048
#: Rows that a cell has on average, until there are MOST_CELLS cells.
CELL = 2048
MOST_CELLS = 256
#: Rows of one tree, and queries that meet it together, about.
TREE = 8192
BLOCK = 8192
#: Orders a NULL id behind all others.
NO_ID = (1 << 63) - 1
#: Any inner product lies within.
LIMIT = 1 << 56


def _matrix(vectors: pa.Array, width: int, kind: np.dtype) -> np.ndarray:
    """Arrays of whole numbers as rows; shorter ones end with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width), kind)
    out[np.arange(width)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy()
    return out


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * component), component as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(label: Column, vector: Column) -> Column:
    """Neither is NULL and every component is a finite number."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))


class Forest:
    """Cover trees over a table (row, id, label, vec) of whole-numbered vectors, and what decides which of them a query meets."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, cell: int = CELL, most_rows: int = TREE):
        square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
        n, self.width, norm, largest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.max(F.sqrt(square)), F.max(F.array_max(F.transform("vec", F.abs)))).first()
        self.norm = max(norm or 0.0, 1.0) * (1 + 1e-9)
        reach = (largest or 0) ** 2 * max(self.width, 1)
        if reach >= LIMIT:
            raise ValueError(f"inner products of up to {reach} do not fit")
        # sums of products below 2 ** 53 are exact as doubles, and those multiply as matrices fast
        self.kind = np.dtype(float) if reach < 1 << 53 else np.dtype(np.int64)
        picked = rows.orderBy(F.xxhash64("row"), "row").limit(sample).select("row", "label", "vec").toArrow()
        self.sample = (picked.column(0).to_numpy(), picked.column(1).to_numpy(), _matrix(picked.column(2).combine_chunks(), self.width, self.kind))
        points = tree.augmented(self.sample[2], self.norm)
        self.centres = self.sample[2][tree.farthest_first(points, 0, int(np.clip(n // cell, 1, MOST_CELLS)), 0.0)[0]] if n else self.sample[2]
        width, kind, norm, centres = self.width, self.kind, self.norm, self.centres
        rim = tree.augmented(centres, norm)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cosine = tree.augmented(_matrix(batch.column("vec"), width, kind), norm) @ rim.T
                at = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(at)), at], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(angle)], names=["row", "id", "label", "vec", "cell", "angle"])

        placed = materialize(rows.select("row", "id", "label", "vec").mapInArrow(place, "row bigint, id bigint, label bigint, vec array<bigint>, cell int, angle double"), "placed")
        found = placed.groupBy("cell").agg(F.count("*"), F.max("angle")).collect() if n else []  # at most MOST_CELLS rows
        self.parts, self.radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for at, size, angle in found:
            self.parts[at], self.radius[at] = -(-size // most_rows), angle
        parts = F.element_at(F.array(*[F.lit(max(int(p), 1)) for p in self.parts] or [F.lit(1)]), F.col("cell") + 1)

        def grow(key: tuple, part: pa.Table) -> pa.Table:
            part = part.combine_chunks()
            column = lambda name: part.column(name).to_numpy()
            made = tree.pack(column("id"), column("label"), column("row"), _matrix(part.column("vec").combine_chunks(), width, kind), norm)
            return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([made], pa.binary())})

        dealt = placed.select("row", F.coalesce("id", F.lit(NO_ID)).alias("id"), "label", "vec", "cell", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"))
        self.trees = materialize(dealt.groupBy("cell", "part").applyInArrow(grow, "cell int, part int, tree binary"), "trees")

    def search(self, queries: DataFrame, k: int, same: bool, block: int = BLOCK) -> DataFrame:
        """(query, window, rank, id, row, score): the first k rows of each window of each query.

        ``queries`` has query, row (which is no answer to it), label, vec and windows, an array of (low, high), all of one
        length. Only rows of the query's label are answers, or with ``same`` false only rows of another.
        """
        blocks = max(1, -(-queries.count() // block))
        width, kind, norm, centres, radius, parts = self.width, self.kind, self.norm, self.centres, self.radius, self.parts
        sample_rows, sample_labels, sample = self.sample
        ends = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

        def bounds(windows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            flat = windows.flatten()
            return tuple(flat.field(c).to_numpy().reshape(len(windows), -1).copy() for c in ("low", "high"))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    batch = whole.slice(start, 512)
                    vectors = _matrix(batch.column("vec"), width, kind)
                    rows, labels = batch.column("row").to_numpy(), batch.column("label").to_numpy()
                    low, high = bounds(batch.column("windows"))
                    score = vectors @ sample.T
                    fits = ((labels[:, None] == sample_labels[None, :]) == same) & (rows[:, None] != sample_rows[None, :])
                    for w in range(low.shape[1]):
                        inside = np.sort(np.where(fits & (score >= low[:, w, None]) & (score <= high[:, w, None]), score, low[:, w, None]), axis=1)
                        low[:, w] = inside[:, -k] if inside.shape[1] >= k else low[:, w]
                    floats = vectors.astype(float)
                    least, most = tree.interval(floats, np.sqrt(np.einsum("ij,ij->i", floats, floats)), centres.astype(float), radius, norm)
                    who, cell = np.nonzero(tree.reached(least, most, low, high) & (parts > 0))
                    who, cell = np.repeat(who, parts[cell]), np.repeat(cell, parts[cell])
                    part = np.arange(len(cell)) - np.maximum.accumulate(np.where(np.diff(who * len(parts) + cell, prepend=-1) != 0, np.arange(len(cell)), 0))
                    at = pa.array(who)
                    windows = pa.ListArray.from_arrays(pa.array(np.arange(0, low.size + 1, low.shape[1]), pa.int32()), pa.StructArray.from_arrays([pa.array(low.ravel()), pa.array(high.ravel())], names=["low", "high"]))
                    sent = [batch.column(c).take(at) for c in ("query", "row", "label", "vec")]
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), *sent, windows.cast(ends).take(at)], names=["cell", "part", "query", "row", "label", "vec", "windows"])

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            found = np.zeros((0, 5), np.int64)
            asked = np.zeros(0, np.int64)
            if left.num_rows and right.num_rows:
                left = left.combine_chunks()
                asked = left.column("query").to_numpy()
                low, high = bounds(left.column("windows").combine_chunks())
                found = tree.visit(right.column("tree")[0].as_py(), _matrix(left.column("vec").combine_chunks(), width, kind), left.column("row").to_numpy(), left.column("label").to_numpy(), low, high, same, k, norm)
            return pa.table([asked[found[:, 0]], found[:, 1].astype(np.int32), *(found[:, c] for c in (3, 4, 2))], names=["query", "window", "id", "row", "score"])

        sent = queries.select("query", "row", "label", "vec", "windows").mapInArrow(send, "cell int, part int, query bigint, row bigint, label bigint, vec array<bigint>, windows array<struct<low:bigint,high:bigint>>")
        left = sent.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        right = self.trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys = ["cell", "part", "block"]
        each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, "query bigint, window int, id bigint, row bigint, score bigint")
        rank = F.row_number().over(Window.partitionBy("query", "window").orderBy(F.desc("score"), "id", "row"))
        return each.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
                   sample: int = SAMPLE, cell: int = CELL, most_rows: int = TREE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``vectors`` (vec_id, label, embedding).

    Rows with a NULL label, a NULL vector or a component that is NULL or not finite take no part. Scores are inner products of
    the components' floor(scale * x); of vectors of different length the shorter ends with zeros, and an empty one scores 0.
    Products that may pass 2 ** 56 are an error. An anchor (a row for which ``anchors`` holds) has as positives its first
    ``positives`` other rows of the same label, high scores first, ties by vec_id (NULL last). For each of them come the first
    ``negatives`` rows of other labels that score from ``low`` to ``high`` per cent of it. Repeated rows are rows like others,
    and a repeated anchor is answered once for each. No rows, or no anchors, give no rows; other columns are not read.
    """
    rows = materialize(vectors.where(usable(F.col("label"), F.col("embedding"))).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"),
        whole_numbers(F.col("embedding"), scale).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor")), "vectors")
    forest = Forest(rows, sample, cell, most_rows)
    asked = rows.where("anchor").select(F.col("row").alias("query"), "row", "id", "label", "vec")
    everything = F.array(F.struct(F.lit(-LIMIT).alias("low"), F.lit(LIMIT).alias("high")))
    found = materialize(forest.search(asked.withColumn("windows", everything), positives, True, block), "positives")
    # 100 * negative between low * positive and high * positive, in whole numbers
    edge = lambda share, more: F.expr(f"CAST((score * {share} + {more} - pmod(score * {share} + {more}, 100)) DIV 100 AS BIGINT)")
    windows = found.select("query", "rank", F.struct(edge(low, 99).alias("low"), edge(high, 0).alias("high")).alias("w"))
    # an anchor with fewer positives gets windows that nothing falls into
    nothing = F.struct(F.lit(1).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("high"))
    listed = windows.groupBy("query").agg(F.array(*[F.coalesce(F.max(F.when(F.col("rank") == k + 1, F.col("w"))), nothing) for k in range(positives)]).alias("windows"))
    hard = forest.search(asked.join(listed, "query"), negatives, False, block)
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    pairs = found.select("query", (F.col("rank") - 1).alias("window"), named("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = asked.select("query", F.col("id").alias("anchor_id"))
    return (hard.select("query", "window", "rank", named("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(pairs, ["query", "window"]).join(ids, "query")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
