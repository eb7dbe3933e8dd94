"""Quartile bucket digests: fingerprints whose difference tells how alike two texts are.

Every byte triplet (a byte, the second and the fifth after it) is hashed into one of BUCKETS counters. The digest states for
each counter in which quarter of all counters it lies, after one byte for the length and one check byte. Two digests differ
by the quarters between their counters and by their lengths; the difference is bounded by what digests with as many counters
in each quarter, but unrelated, have on average: short texts fill few counters, so few differences are many for them.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visiontables.llm.words import mix

BUCKETS = 1024
#: Distances in bytes of a triplet's bytes.
TRIPLET = (0, 2, 5)
#: A length step is a factor of LENGTH_STEP; each step beyond the first counts so much of the whole, up to LENGTH_MOST.
LENGTH_STEP = 1.1
LENGTH_WEIGHT = 0.01
LENGTH_MOST = 0.1
#: Rows of one range of ids, and the most ranges.
ROWS_PER_RANGE = 5_000
MOST_RANGES = 5_000

_TABLES = [(mix(np.arange(1 + 256 * k, 257 + 256 * k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BUCKETS)).astype(np.uint16) for k in range(3)]
_FOUR = np.asarray([64, 16, 4, 1], dtype=np.uint8)
_APART = np.abs(np.subtract.outer(np.arange(4), np.arange(4)))


def digest(text: bytes) -> bytes:
    """Length byte, check byte and two bits for each counter."""
    data = np.frombuffer(text, dtype=np.uint8)
    n = len(data) - TRIPLET[2]
    if n > 0:
        hashed = _TABLES[0][data[:n]] ^ _TABLES[1][data[TRIPLET[1]:TRIPLET[1] + n]] ^ _TABLES[2][data[TRIPLET[2]:]]
        counts = np.bincount(hashed, minlength=BUCKETS)
        marks = np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        quarters = (counts > marks[0]).astype(np.uint8) + (counts > marks[1]) + (counts > marks[2])
    else:
        quarters = np.zeros(BUCKETS, dtype=np.uint8)
    length = min(255, round(math.log(len(data) + 1) / math.log(LENGTH_STEP)))
    return bytes([length, hashlib.blake2b(text, digest_size=1).digest()[0]]) + (quarters.reshape(-1, 4) @ _FOUR).astype(np.uint8).tobytes()


def _quarters(of: bytes) -> np.ndarray:
    packed = np.frombuffer(of, dtype=np.uint8)[2:]
    return ((packed[:, None] >> np.asarray([6, 4, 2, 0], dtype=np.uint8)) & 3).astype(np.int8).ravel()


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, down to 0 for those as different as unrelated ones or more.

    Texts too short for a triplet are alike only if their digests are equal.
    """
    if a == b:
        return 1.0
    x, y = _quarters(a), _quarters(b)
    most = float(np.bincount(x, minlength=4) @ _APART @ np.bincount(y, minlength=4)) / BUCKETS
    if most == 0:
        return 0.0
    body = int(np.abs(x - y).sum()) + (a[1] != b[1])
    length = min(LENGTH_MOST, max(0, abs(a[0] - b[0]) - 1) * LENGTH_WEIGHT)
    return max(0.0, 1 - (1 - LENGTH_MOST) * min(body / most, 1) - length)


def shown(of: bytes) -> str:
    return base64.urlsafe_b64encode(of).decode().rstrip("=")


def parsed(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


@F.pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """The digest of each text as a string; NULL counts as empty."""
    return text.map(lambda t: shown(digest((t or "").encode())))


@F.pandas_udf(T.DoubleType())
def fingerprint_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two fingerprint columns, NULL where one is."""
    return pd.Series([None if x is None or y is None else likeness(parsed(x), parsed(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def with_next(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(doc_id, text, _range, _after): the rows cut into ranges of descending doc_id, each range followed by the row after it.

    ``_after`` marks the copies that stand behind a range: the head of the next range, and behind the last range the very
    first row. One range is a sort of its own, so no task sees more than that; the text is shuffled once.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("_id"))
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, n // rows_per_range))
    inner = ids.stat.approxQuantile("_id", [k / ranges for k in range(1, ranges)], 1 / (20 * ranges)) if n and ranges > 1 else []
    bounds = np.unique(np.asarray(inner, dtype=np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def range_of(of: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, of.to_numpy(np.int64), side="left"), dtype="int32")

    heads = sorted((r["_range"], r["head"]) for r in ids.groupBy(range_of("_id").alias("_range")).agg(F.max("_id").alias("head")).collect())
    before = np.asarray([heads[k - 1][0] for k in range(len(heads))], dtype=np.int64)
    head_ids = np.asarray([h for _, h in heads], dtype=np.int64)[::-1]

    @F.pandas_udf("int")
    def also_after(of: pd.Series) -> pd.Series:
        own = of.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(head_ids, own), max(len(head_ids) - 1, 0))
        hit = head_ids[at] == own
        return pd.Series(np.where(hit, before[::-1][at], -1), dtype="int32")

    rows = docs.select("doc_id", "text", key.alias("_id")).withColumn("_r", range_of("_id")).withColumn("_a", also_after("_id"))
    place = lambda r, after: F.struct(r.alias("r"), F.lit(after).alias("after"))
    spread = rows.withColumn("_p", F.explode(F.when(F.col("_a") >= 0, F.array(place(F.col("_r"), 0), place(F.col("_a"), 1))).otherwise(F.array(place(F.col("_r"), 0)))))
    return (spread.select("doc_id", "text", F.col("_p.r").alias("_range"), F.col("_p.after").alias("_after"), "_id")
            .repartition("_range").sortWithinPartitions("_range", "_after", F.desc("_id"), "text").drop("_id"))


def fingerprint_edits(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per row of ``docs``.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's in descending doc_id, after the last by the first's. A NULL text is empty; a NULL doc_id comes last; rows
    with one doc_id follow each other in the order of their texts; a lone row is its own next. No rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc: tuple, following: tuple) -> tuple:
            doc_id, text, _, _, own = doc
            half = len(text) // 2
            edited = (text[:len(text) - half] + following[1][:half]).encode()
            other = digest(edited)
            return doc_id, len(text), hashlib.sha256(edited).hexdigest(), shown(own), shown(other), likeness(own, other), likeness(own, following[4])

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        waiting = None
        for batch in batches:
            out = []
            types[0] = batch.column(0).type
            for doc_id, text, where, after in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if after and waiting is None:
                    continue
                text = text or ""
                doc = (doc_id, text, where, after, digest(text.encode()))
                if waiting is not None:
                    out.append(row(waiting, doc))
                waiting = None if after else doc
                if len(out) == 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return with_next(docs, rows_per_range).mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
