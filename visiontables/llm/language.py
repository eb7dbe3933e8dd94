"""Language identification by compression.

A language's dictionary is raw text of it. A document is cut into chunks, each chunk is compressed with each dictionary, and
the language whose dictionary makes the whole smallest wins: what a text shares with its language costs few bits. A narrow
margin over the next language is reported as a rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.operators.stages import materialize

#: Bytes of a language's dictionary, and documents that it is taken from at most, the first ones by hash.
DICTIONARY = 110_000
SAMPLED = 400
CHUNK = 512
LEVEL = 6
#: Margins (share of the next language's size) below this are rejected.
NARROW = 0.02
FOLDS = 3

_OTHER = re.compile(r"[\W\d_]+").sub


def plain(text: str) -> str:
    """Lower-case letters with single spaces for everything else."""
    return _OTHER(" ", text.lower()).strip()


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def dictionaries(docs: DataFrame, size: int = DICTIONARY, sampled: int = SAMPLED) -> dict[str, bytes]:
    """A dictionary for each non-NULL lang of the documents that may be learned from (fold other than 1).

    ``sampled`` documents of each language, chosen by a hash of doc_id, are read; the driver gets at most ``size`` bytes
    for each language.
    """
    ids = docs.where(F.col("lang").isNotNull() & (fold_of(F.col("doc_id")) != 1)).select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    first = ids.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_n") <= sampled)
    chosen = materialize(first.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "_n"), "sampled")
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    own = Window.partitionBy("_lang").orderBy("_n", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = texts.where(F.length("text") > 0).select("_lang", "_n", "text").withColumn("_before", F.coalesce(F.sum(F.length("text")).over(own), F.lit(0)))
    out: dict[str, list[str]] = {}
    for row in before.where(F.col("_before") < size).select("_lang", "_n", F.expr(f"substring(text, 1, {size} - _before)").alias("text")).orderBy("_lang", "_n", "text").toLocalIterator():
        out.setdefault(row["_lang"], []).append(plain(row["text"]))
    return {lang: " ".join(parts).encode()[:size] for lang, parts in sorted(out.items()) if any(parts)}


def identify_language(docs: DataFrame, size: int = DICTIONARY, sampled: int = SAMPLED, narrow: float = NARROW) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected, one row per row of ``docs``.

    held_out is crc32(doc_id as text) mod 3 = 1 (false for a NULL doc_id). lang_pred is ``und`` with score 0 where the text
    is NULL or has no letter, or nothing could be learned; a tie goes to the first language in alphabetical order. The
    margin is the share of the next language's size that the best one saves; the score rises with it from 0.5 to 1, and
    ``rejected`` says that it is narrow. With one learned language the margin is 1. Repeated rows come out alike.
    """
    learned = dictionaries(docs, size, sampled)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {lang: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
                for lang, data in learned.items()}
        for press in made.values():
            press.compress(b"")
        for batch in batches:
            found, margins = [], []
            for text in batch.column(1):
                data = plain(text.as_py() or "")
                if not made or not any(c.isalpha() for c in data):
                    found.append("und")
                    margins.append(0.0)
                    continue
                raw = data.encode()
                chunks = [raw[k:k + CHUNK] for k in range(0, len(raw), CHUNK)]
                sizes = sorted((sum(len(press.compress(c)) for c in chunks), lang) for lang, press in made.items())
                found.append(sizes[0][1])
                margins.append(1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(margins, pa.float64())], names=["doc_id", "lang_pred", "margin"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    score = F.when(F.col("lang_pred") == "und", 0.0).otherwise(1 / (1 + F.exp(-40 * F.col("margin"))))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, margin double").select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", score.alias("score"), "margin",
        ((F.col("lang_pred") != "und") & (F.col("margin") < narrow)).alias("rejected"))
