"""Toxicity by class-conditional Kneser-Ney models of byte n-grams.

A text is read as lower-case bytes whose marks and white space are one separator. Two interpolated models of the byte after
four others, one of toxic and one of ordinary documents, discount their own counts of five and of four bytes and fall back
on one shared model of the byte after two, which is counted over all documents. All labelled documents of folds 1 to 3 are
counted and the counts stay tables: texts are packed, each pack asks for its distinct n-grams, their ratios come from joins
by n-gram and go back to the pack. A document's score is fitted on its mean log-likelihood ratio per byte and on the
largest mean over a stretch of bytes: a slur in a long text hardly moves the first but always the second.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiontables.llm.logistic import Logistic, fit
from visiontables.llm.words import SEGMENT, buffers
from visiontables.operators.stages import discard, materialize, shared_folder

ORDER = 5
DISCOUNT = 0.75
STRETCH = 32
FOLDS = 5
#: Labelled documents of fold 4 that the three weights of the score are fitted on, at most; the first ones by hash.
MOST_LABELLED = 40_000
#: Labels that are sent to every executor rather than met by a shuffle of the texts, at most.
SENT_LABELS = 500_000
#: Bytes of text in a pack; a longer document is a pack of its own.
PACK = 16 << 20

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
for _low, _high in ((0, 47), (58, 64), (91, 96), (123, 127)):
    _FOLD[_low:_high + 1] = 32
_8 = np.uint64(8)


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def grams(data: np.ndarray, n: int = ORDER) -> np.ndarray:
    """The n bytes up to each byte of a text, as numbers; before its first byte stand separators."""
    folded = np.concatenate((np.full(n - 1, 32, np.uint64), _FOLD[data]))
    out = np.zeros(len(data), np.uint64)
    for k in range(n):
        out = (out << _8) | folded[k:k + len(data)]
    return out


@dataclass(frozen=True)
class Ratios:
    """Log-likelihood ratios, toxic over ordinary: of known n-grams, and of a known context before an unknown byte."""

    grams: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    lower: Ratios | None

    def of(self, keys: np.ndarray, n: int) -> np.ndarray:
        """The ratio of each n-gram."""
        known, at = _found(self.grams[0], keys)
        rest = self.lower.of(keys & _mask(n - 1), n - 1) if self.lower else np.zeros(len(keys))
        seen, where = _found(self.contexts[0], keys >> _8)
        out = rest + np.where(seen, np.append(self.contexts[1], 0.0)[where], 0.0)
        return np.where(known, np.append(self.grams[1], 0.0)[at], out)


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    return np.append(table, np.uint64(0))[at] == keys if len(table) else np.zeros(len(keys), bool), np.minimum(at, len(table))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=counts, minlength=len(found))


class _Level:
    """Discounted counts of one order: how a probability of the order below becomes one of this order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.contexts, at = np.unique(keys >> _8, return_inverse=True)
        self.total, self.kinds = np.bincount(at, weights=counts, minlength=len(self.contexts)), np.bincount(at, minlength=len(self.contexts))
        self.backoff = DISCOUNT * self.kinds / np.maximum(self.total, 1e-9)

    def probability(self, keys: np.ndarray, below: np.ndarray) -> np.ndarray:
        known, at = _found(self.keys, keys)
        seen, where = _found(self.contexts, keys >> _8)
        count = np.where(known, np.append(self.counts, 0.0)[at], 0.0)
        own = np.maximum(count - DISCOUNT, 0) / np.append(np.maximum(self.total, 1e-9), 1.0)[where] + np.append(self.backoff, 1.0)[where] * below
        return np.where(seen, own, below)

    def log_backoff(self, contexts: np.ndarray) -> np.ndarray:
        seen, where = _found(self.contexts, contexts)
        return np.where(seen, np.log(np.append(self.backoff, 1.0))[where], 0.0)


def ratios(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, shared: list[tuple[np.ndarray, np.ndarray]], n: int = ORDER) -> Ratios:
    """The model from counts of n-grams in both classes and shared counts of 1, 2, ... bytes (of kinds of what precedes)."""
    classes = []
    for counts in (toxic, ordinary):
        own, some = keys[counts > 0], counts[counts > 0]
        classes.append([(own, some), _summed(own & _mask(n - 1), np.ones(len(own)))])
    made = None
    for depth in (1, 0):
        known = np.union1d(classes[0][depth][0], classes[1][depth][0])
        logs, backs = [], []
        levels = [_Level(*classes[c][depth]) for c in (0, 1)]
        contexts = np.union1d(levels[0].contexts, levels[1].contexts)
        for c in (0, 1):
            below = np.full(len(known), 1 / 256)
            for k, table in enumerate(shared, 1):
                below = _Level(*table).probability(known & _mask(k), below)
            if depth == 0:
                below = _Level(*classes[c][1]).probability(known & _mask(n - 1), below)
            logs.append(np.log(levels[c].probability(known, below)))
            backs.append(levels[c].log_backoff(contexts))
        made = Ratios((known, logs[0] - logs[1]), (contexts, backs[0] - backs[1]), made)
    return made


def features(data: np.ndarray, model: Ratios | Known, n: int = ORDER, stretch: int = STRETCH) -> tuple[float, float, float]:
    """Mean ratio per byte, largest mean over ``stretch`` bytes, and the logarithm of the length; a segment at a time."""
    total, best, tail = 0.0, -np.inf, np.zeros(0)
    for low in range(0, len(data), SEGMENT):
        own = grams(data[max(0, low - n + 1):low + SEGMENT], n)[min(low, n - 1):]
        each = model.of(own, n)
        total += float(each.sum())
        run = np.concatenate((tail, each))
        sums = np.concatenate(([0.0], np.cumsum(run)))
        width = min(stretch, len(run))
        best = max(best, float((sums[width:] - sums[:-width]).max()) / width)
        tail = run[len(run) - min(len(run), stretch - 1):]
    return (total / len(data), best, float(np.log(len(data)))) if len(data) else (0.0, 0.0, 0.0)


def _counted(texts: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """(gram, [label,] n): how often each n-gram stands in the texts, added up in the tasks first."""
    names = ["gram", *([by] if by else []), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            labels = batch.column(1).to_numpy(zero_copy_only=False) if by else np.zeros(batch.num_rows, np.int64)
            for label in np.unique(labels):
                found: list[np.ndarray] = []
                held: list[tuple[np.ndarray, np.ndarray]] = []
                waiting = 0
                for k in np.flatnonzero(labels == label):
                    for low in range(offsets[k], offsets[k + 1], SEGMENT):
                        own = grams(data[max(offsets[k], low - n + 1):min(low + SEGMENT, offsets[k + 1])], n)[min(low - offsets[k], n - 1):]
                        found.append(own)
                        waiting += len(own)
                        if waiting > SEGMENT:
                            held.append(np.unique(np.concatenate(found), return_counts=True))
                            found, waiting = [], 0
                if found:
                    held.append(np.unique(np.concatenate(found), return_counts=True))
                if held:
                    keys, counts = _summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    columns = [pa.array(keys.view(np.int64)), *([pa.array(np.full(len(keys), label), pa.int32())] if by else []), pa.array(counts.astype(np.int64))]
                    for low in range(0, len(keys), 100_000):
                        yield pa.RecordBatch.from_arrays([c.slice(low, 100_000) for c in columns], names=names)

    schema = "gram bigint, " + (f"{by} int, " if by else "") + "n bigint"
    return texts.mapInArrow(run, schema).groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def _arrays(df: DataFrame) -> list[np.ndarray]:
    table = df.toArrow()
    return [c.to_numpy() for c in table.columns]


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


@dataclass(frozen=True)
class Known:
    """The ratios of the n-grams of a pack; all others have the ratio 0."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, keys: np.ndarray, n: int) -> np.ndarray:
        known, at = _found(self.keys, keys)
        return np.where(known, np.append(self.values, 0.0)[at], 0.0)


def _packs(rows: DataFrame) -> DataFrame:
    """(pack, payload): about PACK bytes of consecutive texts, folded, with their doc_ids; a pack's number is drawn as it is written."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
            out.write_table(pa.Table.from_batches(parts).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["pack", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PACK - size, side="right")) - 1)
                low, high = int(offsets[at]), int(offsets[end])
                folded = pa.Array.from_buffers(pa.large_binary(), end - at, [None, pa.py_buffer((offsets[at:end + 1] - low).astype(np.int64)), pa.py_buffer(_FOLD[data[low:high]].astype(np.uint8))])
                held.append(pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), folded], names=["doc_id", "text"]))
                size += high - low
                at = end
                if size >= PACK or at < batch.num_rows:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return bucketed(rows.mapInArrow(run, "pack bigint, payload binary"), "pack")


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Written to the shared folder once, dealt into files by ``key``: what joins it by that key moves to its rows, which stay."""
    spark = df.sparkSession
    name = f"b{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(name)
    written = spark.table(name)
    written._stage_path, written._stage_table = path, name
    return written


def _texts(payload: bytes) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """doc_ids and texts of a pack."""
    for batch in pa.ipc.open_stream(payload):
        offsets = np.frombuffer(batch.column(1).buffers()[1], np.int64)[batch.column(1).offset:][:batch.num_rows + 1]
        data = np.frombuffer(batch.column(1).buffers()[2] or b"", np.uint8)
        yield batch.column(0), [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _asked(packs: DataFrame, n: int) -> DataFrame:
    """(pack, gram): the distinct n-grams of each pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, payload in zip(batch.column(0), batch.column(1), strict=True):
                held, found, waiting = [np.zeros(0, np.uint64)], [], 0
                for _, texts in _texts(payload.as_py()):
                    for text in texts:
                        for low in range(0, len(text), SEGMENT):
                            found.append(grams(text[max(0, low - n + 1):low + SEGMENT], n)[min(low, n - 1):])
                            waiting += len(found[-1])
                            if waiting > SEGMENT:
                                held.append(np.unique(np.concatenate(found)))
                                found, waiting = [], 0
                keys = np.unique(np.concatenate([*held, *found])).view(np.int64)
                for low in range(0, len(keys), 100_000):
                    own = keys[low:low + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), pack.as_py())), pa.array(own)], names=["pack", "gram"])

    return materialize(packs.mapInArrow(run, "pack bigint, gram bigint"), "asked")


def _low(gram: Column, k: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (8 * k)) - 1))


def _share(count: Column, total: Column, kinds: Column, below: Column) -> Column:
    """A discounted probability of one order; where the context is unknown, that of the order below."""
    return F.when(total > 0, (F.greatest(F.coalesce(count, F.lit(0)) - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * below) / total).otherwise(below)


def _shared(below: DataFrame, n: int) -> DataFrame:
    """(_low, _p): the shared probability of the last n - 2 bytes, from the distinct (n - 1)-grams of all documents."""
    counts = []
    for k in range(n - 2, 0, -1):
        below = below.groupBy(_low(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("_n"))
        counts.insert(0, below)
    made = None
    for k, table in enumerate(counts, 1):
        sums = table.groupBy(F.shiftright("gram", 8).alias("_context")).agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
        met = table.join(sums, F.shiftright("gram", 8) == F.col("_context"))
        met = met.join(made, _low(F.col("gram"), k - 1) == F.col("_low")) if made is not None else met.withColumn("_p", F.lit(1 / 256))
        made = met.select(F.col("gram").alias("_low"), _share(F.col("_n"), F.col("_t"), F.col("_k"), F.col("_p")).alias("_p"))
    return made


def gram_ratios(asked: DataFrame, classes: DataFrame, below: DataFrame, n: int = ORDER) -> DataFrame:
    """(gram, ratio) of the n-grams in ``asked`` whose ratio is not 0: what ``ratios`` makes, by joins.

    ``classes`` has gram, toxic and ordinary, how often each n-gram stands in either class; ``below`` has the distinct
    (n - 1)-grams of all documents.
    """
    names = ("toxic", "ordinary")
    kinds = classes.groupBy(_low(F.col("gram"), n - 1).alias("gram")).agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in names])
    gram = F.col("gram")
    got = asked.join(_shared(below, n), _low(gram, n - 2) == F.col("_low"), "left").select("gram", *[F.coalesce("_p", F.lit(1 / 256)).alias(f"_p_{c}") for c in names])
    for k, table in ((n - 1, kinds), (n, classes)):
        sums = table.groupBy(F.shiftright("gram", 8).alias("_context")).agg(*[F.sum(c).alias(f"_t_{c}") for c in names], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"_k_{c}") for c in names])
        own = table.select(F.col("gram").alias("_own"), *[F.col(c).alias(f"_n_{c}") for c in names])
        key = _low(gram, k)
        got = (got.join(sums, F.shiftright(key, 8) == F.col("_context"), "left").join(own, key == F.col("_own"), "left")
               .select("gram", *[_share(F.col(f"_n_{c}"), F.col(f"_t_{c}"), F.col(f"_k_{c}"), F.col(f"_p_{c}")).alias(f"_p_{c}") for c in names]))
    return got.select("gram", (F.log("_p_toxic") - F.log("_p_ordinary")).alias("ratio")).where("ratio <> 0")


def class_counts(docs: DataFrame, labels: DataFrame, n: int = ORDER) -> DataFrame:
    """(gram, toxic, ordinary): how often each n-gram stands in all labelled documents of folds 1 to 3."""
    taught = labels.where(fold_of(F.col("doc_id")).isin(1, 2, 3))
    known = F.broadcast(taught) if labels.count() <= SENT_LABELS else taught
    counted = _counted(docs.select("doc_id", "text").join(known, "doc_id").select("text", "toxic"), n, "toxic")
    return counted.groupBy("gram").agg(*[F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((1, "toxic"), (0, "ordinary"))])


def _features(rows: DataFrame, classes: DataFrame, n: int = ORDER) -> DataFrame:
    """doc_id and a, b, c: the features of each row's text."""
    packs = _packs(rows.select("doc_id", "text"))
    asked = _asked(packs, n)
    found = materialize(gram_ratios(asked.select("gram").distinct(), classes, asked.select(_low(F.col("gram"), n - 1).alias("gram")).distinct(), n), "ratios")
    told = asked.join(found, "gram").select("pack", "gram", "ratio")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        model = Known(keys[order], right.column("ratio").to_numpy()[order])
        ids, own = [], []
        for payload in left.column("payload"):
            for doc_ids, texts in _texts(payload.as_py()):
                ids.append(doc_ids)
                own += [features(text, model, n) for text in texts]
        table = np.asarray(own, dtype=float).reshape(-1, 3)
        return pa.table([pa.chunked_array(ids), *(pa.array(table[:, k]) for k in range(3))], names=["doc_id", "a", "b", "c"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, a double, b double, c double"
    made = materialize(packs.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(run, schema), "features")
    rows.sparkSession.sql(f"DROP TABLE {packs._stage_table}")
    for stage in (packs, asked, found):
        discard(stage)
    return made


def score_toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, mean_ratio, top_ratio, one row per row of ``docs``.

    held_out is crc32(doc_id as text) mod 5 = 0 (false for a NULL doc_id). Only ``text`` enters a score. The class models
    count all labelled documents of folds 1 to 3; the weights of the score are fitted on at most ``most_labelled`` different
    rows of fold 4. NULL and empty texts get the score of ratio 0. Documents labelled more than once are toxic if one label
    says so. Without labels of both classes every score is the same, below 0.5. Repeated rows score alike; no rows give no rows.
    """
    marks = materialize(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (fold_of(F.col("doc_id")) != 0))
                        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labelled")
    classes = materialize(class_counts(docs, marks), "classes")
    if all(classes.agg(F.max(F.col("toxic") > 0), F.max(F.col("ordinary") > 0)).first()):
        scored = _features(docs, classes)
        held = scored.join(marks.where(fold_of(F.col("doc_id")) == 4), "doc_id").select("doc_id", "toxic", "a", "b", "c").distinct()
        label, a, b, c = _arrays(held.orderBy(F.xxhash64("doc_id"), "doc_id", "a", "b", "c").limit(most_labelled).select("toxic", "a", "b", "c"))
        model = fit(np.column_stack((a, b, c)).reshape(-1, 3), label.astype(float))
    else:
        scored = docs.select("doc_id", *[F.lit(0.0).alias(c) for c in "abc"])
        model = fit(np.zeros((1, 3)), np.zeros(1))
    logit = F.lit(model.bias)
    for weight, column in zip(model.weights, ("a", "b", "c"), strict=True):
        logit = logit + F.lit(weight) * F.col(column)
    return (scored.withColumn("score", 1 / (1 + F.exp(-logit)))
            .select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("a").alias("mean_ratio"), F.col("b").alias("top_ratio")))
