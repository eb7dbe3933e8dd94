"""Hierarchical residual packing: fill sequences best-fit inside each partition, send on only what stayed underfull.

A task tokenizes its documents and packs its own pieces best-fit, longest first. Sequences that are nearly full are done.
The others go on as items of their own: they are dealt to fewer tasks, packed best-fit again, and so on until one task is
left or nothing shrinks any more. An item carries its list of pieces, at most as many as a sequence has tokens. No text
is shuffled, only piece descriptions, and from round to round fewer of them.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visiontables.llm.words import buffers, scan_placed
from visiontables.operators.stages import materialize

CAPACITY = 2048
#: A sequence with at most so many free places is done before the last round.
SLACK = 8
#: Items packed together by one task; bounds its memory.
ITEMS_PER_TASK = 200_000
#: How many tasks of one round feed one task of the next.
FAN_IN = 8
ROUNDS = 12
TOKENIZER = "word_bpe_49k.json"
#: Words whose tokens a worker keeps; past that it starts anew.
CACHED_WORDS = 4_000_000

#: A word of one run of letters and at most one of marks: the tokenizer makes of it one or two pieces, each with an end mark.
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?*%&$#|]*)").fullmatch

_PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
_ITEMS = f"item bigint, size int, pieces array<{_PIECE}>"


class Encoder:
    """Token ids of texts.

    The tokenizer finds its added tokens as they are written, lower-cases the rest and splits at white space, and no rule of
    it looks across white space, so a text's ids are its words' ids in turn. Each different word of a batch is looked up among those encoded before; only new ones
    go through the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        raw = buffers(texts)[0].tobytes()
        for low, high, words, bounds, begins, ends in scan_placed(texts, lower=False):
            found, first, which = np.unique(words, return_index=True, return_inverse=True)
            slots = np.searchsorted(self.known, found)
            new = np.flatnonzero(np.append(self.known, np.uint64(0))[slots] != found) if len(self.known) else np.arange(len(found))
            if len(new):
                self._learn(found[new], [raw[b:e].decode() for b, e in zip(begins[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
                slots = np.searchsorted(self.known, found)
            at, size = self.at[slots][which], self.size[slots][which].astype(np.int64)
            stops = np.concatenate(([0], np.cumsum(size)))
            ids = self.ids[np.arange(stops[-1]) + np.repeat(at - stops[:-1], size)].astype("<u4")
            cuts = stops[bounds]
            for k in range(high - low):
                yield ids[cuts[k]:cuts[k + 1]].tobytes()
            if len(self.known) > CACHED_WORDS:
                self._forget()

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode new words. Plain ones go through many at a time; the end marks of their pieces tell them apart."""
        parts = [_PLAIN(w) for w in words]
        plain = [k for k, m in enumerate(parts) if m]
        other = [k for k, m in enumerate(parts) if not m]
        lines = [" ".join([words[k] for k in plain[j:j + 256]]) for j in range(0, len(plain), 256)]
        flat = [np.asarray(made.ids, dtype=np.uint32) for made in self.whole.encode_batch_fast(lines, add_special_tokens=False)]
        rest = [np.asarray(made.ids, dtype=np.uint32) for made in self.whole.encode_batch_fast([words[k] for k in other], add_special_tokens=False)]
        ids = np.concatenate([*flat, np.zeros(0, np.uint32)])
        stops = (np.flatnonzero(self.ends[ids]) + 1)[np.cumsum([2 if parts[k][2] else 1 for k in plain], dtype=np.int64) - 1]
        size = np.concatenate((np.diff(stops, prepend=0), [len(r) for r in rest])).astype(np.int32)
        at = len(self.ids) + np.concatenate(([0], np.cumsum(size, dtype=np.int64)[:-1]))
        order = np.asarray(plain + other)
        turn = np.argsort(order)
        place = np.searchsorted(self.known, hashes)
        self.known, self.at, self.size = np.insert(self.known, place, hashes), np.insert(self.at, place, at[turn]), np.insert(self.size, place, size[turn])
        self.ids = np.concatenate([self.ids, ids, *rest])


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder for a file of the public tokenizers, or for a path."""
    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = Encoder(name if os.path.isabs(name) else public_tokenizers.path(name))
    return _encoders[name]


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items (size, number) longest first, each into the fullest bin that has room for it.

    Open bins are grouped by free room, so finding the best one is a search in at most ``capacity`` numbers.
    """
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for size, number in sorted(items, key=lambda x: (-x[0], x[1])):
        k = bisect_left(rooms, size)
        if k == len(rooms):
            bins.append([])
            at, room = len(bins) - 1, capacity
        else:
            room = rooms[k]
            at = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
        bins[at].append(number)
        if left := room - size:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(at)
    return bins


def _packed(items: list[tuple[int, list[dict]]], capacity: int) -> Iterator[tuple[int, list[dict]]]:
    for numbers in best_fit([(size, n) for n, (size, _) in enumerate(items)], capacity):
        pieces, offset = [], 0
        for n in numbers:
            size, own = items[n]
            pieces += [{**p, "offset": p["offset"] + offset} for p in own]
            offset += size
        yield offset, pieces


def _batch(rows: list[tuple[int, list[dict]]]) -> pa.RecordBatch:
    piece = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array([zlib.crc32(repr(sorted((str(p["doc_id"]), p["piece"]) for p in r[1])).encode()) for r in rows], pa.int64()),
                                       pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(piece))], names=["item", "size", "pieces"])


def _sent(rows: Iterator[tuple[int, list[dict]]]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, list[dict]]] = []
    for row in rows:
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def pieces_of(ids: bytes, doc_id: int | None, capacity: int) -> Iterator[dict]:
    """A document's pieces: its ids cut every ``capacity`` tokens."""
    n = len(ids) // 4
    for piece, start in enumerate(range(0, n, capacity)):
        length = min(capacity, n - start)
        yield {"doc_id": doc_id, "piece": piece, "start": start, "length": length, "ids_crc32": zlib.crc32(ids[4 * start:4 * (start + length)]), "offset": 0}


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, slack: int = SLACK, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, n_pieces (of its sequence).

    A NULL or empty text is the end token 0 alone. Repeated rows and NULL ids are documents like any others. Texts of any
    length are cut into full sequences of their own and a rest. Ties between equally long pieces go by their order in the
    partition. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[tuple[int, list[dict]]]:
            encode, waiting = encoder(tokenizer), []
            for batch in batches:
                for low in range(0, batch.num_rows, 500):
                    part = batch.slice(low, 500)
                    for doc_id, ids in zip(part.column(0).to_pylist(), encode.texts(part.column(1)), strict=True):
                        for p in pieces_of(ids + b"\0\0\0\0", doc_id, capacity):
                            if p["length"] == capacity:
                                yield capacity, [p]
                            else:
                                waiting.append((p["length"], [p]))
                    if len(waiting) >= items_per_task:
                        yield from _packed(waiting, capacity)
                        waiting = []
            yield from _packed(waiting, capacity)

        return _sent(run())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[tuple[int, list[dict]]]:
            waiting: list[tuple[int, list[dict]]] = []
            for batch in batches:
                waiting += zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
                if len(waiting) >= 4 * items_per_task:
                    yield from _packed(waiting, capacity)
                    waiting = []
            yield from _packed(waiting, capacity)

        return _sent(run())

    packed = materialize(rows.mapInArrow(first, _ITEMS), "pack")
    done, tasks, before = [], None, None
    for _ in range(ROUNDS):
        under = packed.where(F.col("size") < capacity - slack)
        n = under.count()
        if n < 2 or n == before:
            break
        last = tasks == 1
        least = -(-n // items_per_task)
        tasks = max(least, 1 if tasks is None and n <= items_per_task else -(-(tasks or FAN_IN * least) // FAN_IN))
        if last and tasks == 1:
            break
        done.append(packed.where(F.col("size") >= capacity - slack))
        before = n
        dealt = under.repartition(tasks, F.xxhash64("item", F.lit(len(done)))).sortWithinPartitions(F.desc("size"), "item", F.col("pieces")[0]["doc_id"], F.col("pieces")[0]["piece"])
        packed = materialize(dealt.mapInArrow(again, _ITEMS), "pack")
    whole = packed
    for part in done:
        whole = whole.unionByName(part)
    numbered = whole.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("n_pieces", F.size("pieces").cast(T.LongType()))
    return numbered.select("sequence_id", "n_pieces", F.explode("pieces").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset", "n_pieces")
