"""Ranked lexical search with per-term geometric blocking.

Documents are vectors of impacts, one coordinate for each term of the asked items. A sketch of the vector deals similar
documents to the same parts of bounded size, each the work of one task. There every term has its posting list, cut into blocks
of similar documents: pivots are taken from the list and each document goes to the pivot it is most like. A block is summed up
by the largest impact that any of its documents has in each coordinate, so the sum of an item's coordinates is no less than any
score in the block. A block is skipped if that bound is below the score which k documents are already known to reach, and so is
a whole list when its largest impacts and those of smaller lists cannot reach it together; all else is scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.llm.words import PUNCTUATION, mix, runs, scan
from visiontables.operators.stages import discard, materialize

#: Bytes of item texts that are answered together, about; every batch reads the documents once.
BATCH = 4 << 20
#: Documents of a part, about, and of a block.
PART = 1024
BLOCK = 32
#: Bits of the sketch that deals documents to parts, and dimensions of the one that compares them within a part.
BITS = 12
DIMENSIONS = 32
#: Documents whose scores are the first bound, at most; the first ones by hash.
SAMPLE = 2048

VECTOR = "row bigint, doc_id bigint, n bigint, terms array<int>, counts array<bigint>"


@dataclass
class Items:
    """Items as sets of term numbers, and for each term the items that have it and all their terms (its coordinates)."""

    ids: list[int | None]
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    holders: list[list[int]]
    coordinates: list[np.ndarray]

    @classmethod
    def of(cls, ids: list[int | None], texts: pa.Array) -> Items:
        sets = [np.unique(words[bounds[k]:bounds[k + 1]]) for low, high, words, bounds in scan(texts, PUNCTUATION) for k in range(high - low)]
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]))
        terms = [np.searchsorted(vocabulary, s) for s in sets]
        holders: list[list[int]] = [[] for _ in vocabulary]
        for item, own in enumerate(terms):
            for t in own:
                holders[t].append(item)
        return cls(ids, vocabulary, terms, holders, [np.unique(np.concatenate([terms[i] for i in h])) for h in holders])


def count_terms(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Of each row (row, doc_id, text): how many terms its text has, and which of the vocabulary how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in runs(batch.column("text")):
                for low, high, words, bounds in scan(texts, PUNCTUATION):
                    place = np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))
                    known = np.flatnonzero(vocabulary[place] == words) if len(vocabulary) else np.zeros(0, np.int64)
                    owner = np.searchsorted(bounds, known, side="right") - 1
                    pairs, counts = np.unique(owner * max(len(vocabulary), 1) + place[known], return_counts=True)
                    ends = pa.array(np.searchsorted(pairs, np.arange(high - low + 1) * max(len(vocabulary), 1)).astype(np.int32))
                    own = batch.slice(at + low, high - low)
                    yield pa.RecordBatch.from_arrays([own.column("row"), own.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)),
                                                      pa.ListArray.from_arrays(ends, pa.array((pairs % max(len(vocabulary), 1)).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64)))],
                                                     names=["row", "doc_id", "n", "terms", "counts"])
                at += len(texts)

    return docs.select("row", "doc_id", "text").mapInArrow(run, VECTOR)


@dataclass
class Scale:
    """What turns counts into impacts: documents and terms of the whole table, and each term's weight."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    @classmethod
    def of(cls, n_docs: int, n_terms: int, having: np.ndarray) -> Scale:
        return cls(n_docs, n_terms, np.asarray([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in having], np.int64))

    def impacts(self, n: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each posting, given its document's number of terms."""
        m = 100 - 90 + (90 * n * self.n_docs) // max(self.n_terms, 1)
        return self.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


def _dense(batch: pa.RecordBatch | pa.Table, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """The terms that stand in some row, and the impacts of the rows in these coordinates."""
    lists = batch.column("terms")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    counts = batch.column("counts")
    counts = counts.combine_chunks() if isinstance(counts, pa.ChunkedArray) else counts
    terms, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    impacts = scale.impacts(batch.column("n").to_numpy()[owner], terms, counts.flatten().to_numpy())
    used, column = np.unique(terms, return_inverse=True)
    out = np.zeros((len(sizes), len(used)), np.int64)
    out[owner, column] = impacts
    return used, out


def _directions(n: int, width: int) -> np.ndarray:
    return np.random.default_rng(7).normal(size=(n, width))


def blocks_of(likeness: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """An order of a list's documents, given their sketches, that brings each block together, and where the blocks begin."""
    n = len(likeness)
    if n <= size:
        return np.arange(n), np.zeros(1, np.int64)
    pivots = likeness[np.arange(-(-n // size)) * size]
    near = (likeness @ pivots.T).argmax(axis=1)
    order = np.argsort(near, kind="stable")
    return order, np.flatnonzero(np.diff(near[order], prepend=-1))


class Part:
    """The posting lists of some documents: blocks with the largest impact in each coordinate."""

    def __init__(self, used: np.ndarray, impacts: np.ndarray, items: Items, size: int = BLOCK):
        self.used, self.impacts, self.items, self.size = used, impacts, items, size
        self.most = impacts.max(axis=0, initial=0)
        sketch = impacts @ _directions(len(items.vocabulary), DIMENSIONS)[used]
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-300)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def list_of(self, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents, block begins, coordinates, summaries) of the term in this column, made when first asked for."""
        if column not in self.lists:
            having = np.flatnonzero(self.impacts[:, column])
            order, begins = blocks_of(self.sketch[having], self.size)
            coordinates = np.flatnonzero(np.isin(self.used, self.items.coordinates[self.used[column]], assume_unique=True))
            docs = having[order]
            self.lists[column] = docs, begins, coordinates, np.maximum.reduceat(self.impacts[np.ix_(docs, coordinates)], begins, axis=0)
        return self.lists[column]

    def candidates(self, item: int, bound: int) -> np.ndarray:
        """The documents in blocks whose bound reaches ``bound``, which is above 0."""
        columns = np.flatnonzero(np.isin(self.used, self.items.terms[item], assume_unique=True))
        columns = columns[np.argsort(self.most[columns], kind="stable")]
        reach = np.cumsum(self.most[columns])
        found = [np.zeros(0, np.int64)]
        for column in columns[reach >= bound]:
            docs, begins, coordinates, summaries = self.list_of(column)
            if len(docs):
                high = summaries[:, np.searchsorted(coordinates, columns)].sum(axis=1)
                sizes = np.diff(np.append(begins, len(docs)))
                found.append(docs[np.repeat(high >= bound, sizes)])
        return np.unique(np.concatenate(found))

    def best(self, item: int, bound: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k documents with a score of ``bound`` or more, in the order of the part where scores tie, and the scores."""
        bound = max(bound, 1)
        docs = self.candidates(item, bound)
        scores = self.impacts[np.ix_(docs, np.flatnonzero(np.isin(self.used, self.items.terms[item], assume_unique=True)))].sum(axis=1)
        docs, scores = docs[scores >= bound], scores[scores >= bound]
        first = np.argsort(-scores, kind="stable")[:k]
        return docs[first], scores[first]


def first_bounds(used: np.ndarray, impacts: np.ndarray, items: Items, k: int) -> np.ndarray:
    """The k-th best score among some documents for each item; 0 where fewer score."""
    out = np.zeros(len(items.ids), np.int64)
    for item, own in enumerate(items.terms):
        scores = impacts[:, np.isin(used, own, assume_unique=True)].sum(axis=1)
        if len(scores) >= k:
            out[item] = np.partition(scores, len(scores) - k)[len(scores) - k]
    return out


def _shares(sizes: dict[int, int], most: int) -> tuple[list[int], list[int]]:
    """For each sketch its first part and how many it has: small neighbours share a part, large ones are cut."""
    first, parts, at, held = [0] * (1 << BITS), [1] * (1 << BITS), 0, 0
    for code in sorted(sizes):
        if held and held + sizes[code] > most:
            at, held = at + 1, 0
        first[code], parts[code] = at, -(-sizes[code] // most)
        held += sizes[code]
        if parts[code] > 1:
            at, held = at + parts[code], 0
    return first, parts


def _ranked(docs: DataFrame, items: Items, k: int, part: int, size: int, sample: int) -> DataFrame:
    vectors = materialize(count_terms(docs, items.vocabulary), "vectors")
    n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    having = np.zeros(len(items.vocabulary), np.int64)
    for term, df in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the batch
        having[term] = df
    scale = Scale.of(n_docs, n_terms, having)
    some = vectors.where(F.size("terms") > 0)
    picked = some.orderBy(F.xxhash64("row"), "row").limit(sample).toArrow()
    bounds = first_bounds(*_dense(picked, scale), items, k)
    directions = _directions(len(items.vocabulary), BITS)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for whole in batches:
            for low in range(0, whole.num_rows, part):
                batch = whole.slice(low, part)
                used, impacts = _dense(batch, scale)
                yield batch, ((impacts @ directions[used]) > 0) @ (1 << np.arange(BITS))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.bincount(codes, minlength=1 << BITS) for _, codes in sketches(batches)), np.zeros(1 << BITS, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0].astype(np.int64))], names=["code", "n"])

    sizes = dict(some.mapInArrow(counted, "code int, n bigint").groupBy("code").agg(F.sum("n")).collect())  # at most 2 ** BITS rows
    first, parts = map(np.asarray, _shares(sizes, part))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, codes in sketches(batches):
            at = first[codes] + (mix(batch.column("row").to_numpy().astype(np.uint64)) % parts[codes].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], names=["part", *batch.schema.names])

    def answer(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("doc_id", "ascending"), ("row", "ascending")])  # NULL last
        index = Part(*_dense(rows, scale), items, size)
        found = [index.best(item, int(bounds[item]), k) for item in range(len(items.ids))]
        docs = np.concatenate([np.zeros(0, np.int64), *(d for d, _ in found)])
        item = np.repeat(np.arange(len(found), dtype=np.int32), [len(d) for d, _ in found])
        at = pa.array(docs)
        return pa.table({"item": pa.array(item, pa.int32()), "item_id": pa.array(items.ids, pa.int64()).take(pa.array(item)), "doc_id": rows.column("doc_id").take(at), "row": rows.column("row").take(at), "score": np.concatenate([np.zeros(0, np.int64), *(s for _, s in found)])})

    dealt = some.mapInArrow(deal, f"part int, {VECTOR}")
    each = dealt.groupBy("part").applyInArrow(answer, "item int, item_id bigint, doc_id bigint, row bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    top = materialize(each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "top")
    discard(vectors)
    return top.select("item_id", "rank", "doc_id", "score")


def search_terms(docs: DataFrame, items: DataFrame, k: int = 10, part: int = PART, size: int = BLOCK, sample: int = SAMPLE, batch: int = BATCH) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` (item_id, text) its k documents of highest score above 0.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A score is the sum over the item's different
    terms of weight * (10**9 tf div (1000 tf + 8 m)), all whole numbers: the weight is floor(1000 ln((2N+2) / (2df+1))), m is
    10 + 90 n N div L. Equal scores go by doc_id, NULL last; repeated documents are documents like others, and a repeated item
    is answered once for each row. NULL and empty texts have no terms. Items without terms and terms that no document has give
    nothing; no rows give no rows. Texts are read whole; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    asked = materialize(items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")), "items")
    batches = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // batch))
    own: Column = F.pmod(F.xxhash64("row"), F.lit(batches))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for b in range(batches):
        few = asked.where(own == b).orderBy("row").select("item_id", "text").toArrow()  # about ``batch`` bytes
        if few.num_rows:
            out = out.unionAll(_ranked(rows, Items.of(few.column(0).to_pylist(), few.column(1).combine_chunks()), k, part, size, sample))
    return out
