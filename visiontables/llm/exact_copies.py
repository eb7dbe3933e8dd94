"""Exact copies by a tree merge of sorted digest runs.

Each partition of the table is a run: its rows' digests, sorted, equal ones folded into one entry that keeps a count and the
identifier that stays. Runs are numbered; in a round those whose numbers differ in the next few bits alone exchange slices of
their digests, a slice for each of them, and every receiver merges what it gets, folding again. After all bits each run holds
one slice of all digests, so no task ever sees more than its slice. A text that fills a third of the table is one entry a run.
The answers then walk back down the tree, level by level, to the rows.

An entry is a SHA-256 digest, a second 64-bit hash of the text and its length in bytes, and entries are equal only if all
three are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiontables.operators.stages import discard, materialize

KEY = ["digest", "check", "bytes"]
#: Binomial steps that one round makes at once: 2 ** STEPS runs exchange slices and merge.
STEPS = 3


def _entries(rows: DataFrame) -> DataFrame:
    """(row, run, doc_id, digest, check, bytes) of each row (doc_id, text, row); a row's run is its partition."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select("row", F.shiftright("row", 33).cast("int").alias("run"), "doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
                       F.xxhash64(text).alias("check"), F.octet_length(text).alias("bytes"))


def _rank(last: bool) -> Column:
    """What stays is the largest of it: NULL ids come last, of equal ids the first row."""
    sign = 1 if last else -1
    return F.struct(F.col("doc_id").isNotNull().alias("known"), (sign * F.col("doc_id")).alias("place"), (-F.col("row")).alias("row"))


def _merge(runs: DataFrame) -> DataFrame:
    """One entry for each run and digest: runs are sorted, merged and folded (a sort aggregate on both sides of the exchange)."""
    return runs.groupBy("run", *KEY).agg(F.sum("n").alias("n"), F.max("best").alias("best"))


def _receiver(low: int, high: int, width: int) -> Column:
    """The run that an entry moves to: bits ``low`` to ``high`` of its run become those of the digest's slice."""
    mask = (1 << high) - (1 << low)
    part = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint"), 32 - width)
    return (F.col("run").bitwiseAND(F.lit(~mask)) + part.bitwiseAND(F.lit(mask))).cast("int")


def _decided(rows: DataFrame, last: bool, steps: int) -> DataFrame:
    """(row, doc_id, digest, n, best) of each row (doc_id, text, row)."""
    entries = materialize(_entries(rows), "digests")
    runs = entries.agg(F.coalesce(F.max("run"), F.lit(0)) + 1).first()[0]
    width = (runs - 1).bit_length()
    level = materialize(_merge(entries.withColumn("n", F.lit(1).cast("bigint")).withColumn("best", _rank(last))), "run")
    tree = []
    for high in range(width, 0, -steps):
        bits = (max(high - steps, 0), high, width)
        tree.append((level, bits))
        level = materialize(_merge(level.withColumn("run", _receiver(*bits))), "run")
    for below, bits in reversed(tree):
        told = below.select(F.col("run").alias("_run"), *KEY).withColumn("run", F.col("_run")).withColumn("run", _receiver(*bits)).join(level, ["run", *KEY])
        answer = materialize(told.select(F.col("_run").alias("run"), *KEY, "n", "best"), "answer")
        discard(level)
        discard(below)
        level = answer
    return entries.join(level, ["run", *KEY]).select("row", "doc_id", "digest", "n", "best")


def exact_copies(docs: DataFrame, keep: str = "last", steps: int = STEPS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row per row of ``docs``; of equal texts one row is kept.

    It is the one with the largest doc_id (``keep="last"``) or the smallest (``"first"``); of rows that share that id, the
    first. NULL texts are empty. A NULL doc_id is kept only if its text has no other; such a group has a NULL keep_id. Texts
    are compared whole, whatever their length. No rows give no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    last = keep == "last"
    place = F.col("best.place")
    return _decided(rows, last, steps).select("doc_id", (place if last else -place).alias("keep_id"), F.col("n").alias("group_size"),
                                              (F.col("best.row") == -F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, keep: str = "last", steps: int = STEPS) -> DataFrame:
    """The rows of ``docs``, with their columns, that ``exact_copies`` keeps."""
    whole = materialize(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "whole")
    rows = whole.select(F.col("doc.doc_id").cast("bigint").alias("doc_id"), F.col("doc.text").alias("text"), "row")
    kept = _decided(rows, keep == "last", steps).where(F.col("best.row") == -F.col("row")).select("row")
    return whole.join(kept, "row", "left_semi").select("doc.*")
