"""Quality rules: compression bands over whole documents and fixed chunks.

zstandard shrinks prose by a factor that hardly depends on the subject, but on the length. Text far below its band repeats
itself; text above it is noise. Each document is held against the band of its length as a whole, and chunk by chunk, so a
long document can't hide a repetitive half behind varied text. The last chunk ends with the text and may overlap the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from visiontables.llm.words import SPACE, buffers, runs, scan, sums, windows

#: (documents up to so many bytes, least ratio, largest ratio) of compressed to plain size.
BANDS = ((512, 0.40, 0.95), (1024, 0.37, 0.90), (2048, 0.33, 0.85), (4096, 0.30, 0.80), (16384, 0.27, 0.75), (1 << 62, 0.22, 0.72))
CHUNK = 2048
CHUNK_BAND = (0.28, 0.85)
#: Share of chunks outside CHUNK_BAND from which a document is rejected.
BAD_CHUNKS = 0.4
LEVEL = 3
MIN_WORDS = 50

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
            "ratio double, n_chunks long, n_low_chunks long, n_high_chunks long, reason string")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words that stand in a 3-word window found twice or more in their document."""
    grams, ends = windows(words, bounds, 3)
    marked = np.zeros(len(words) + 1, dtype=bool)
    if len(grams):
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(ends))
        order = np.lexsort((grams, owner))
        same = (grams[order][1:] == grams[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twice = np.zeros(len(grams), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = (np.arange(len(grams)) - ends[owner] + bounds[owner])[twice]
        for k in range(3):
            marked[at + k] = True
    return sums(marked[:-1], bounds)


def _repeated_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _verdict(size: int, ratio: float, n_chunks: int, low: int, high: int) -> str | None:
    _, least, most = next(b for b in BANDS if size <= b[0])
    if ratio < least:
        return "repetitive"
    if ratio > most:
        return "incompressible"
    if n_chunks > 1 and low > BAD_CHUNKS * n_chunks:
        return "repetitive chunks"
    if n_chunks > 1 and high > BAD_CHUNKS * n_chunks:
        return "incompressible chunks"
    return None


def measure(texts: pa.Array) -> pa.RecordBatch:
    """One row of MEASURES for each text; NULL counts as empty. A megabyte of text is worked on at a time."""
    parts = [_measure(part) for part in runs(texts)] or [_measure(texts)]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]


def _measure(texts: pa.Array) -> pa.RecordBatch:
    texts = pc.fill_null(texts, "")
    data, offsets = buffers(texts)
    n_words, repeats = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for low, high, words, bounds in scan(texts, lower=False):
        n_words[low:high] = np.diff(bounds)
        repeats[low:high] = _repeated(words, bounds)
    points = sums((data & 0xC0) != 0x80, offsets) - sums(SPACE[data], offsets)
    symbols = sums(_SYMBOL[data], offsets)
    failed = (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words)
    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    view = memoryview(data)
    lines, ratios, chunks, lows, highs, reasons = [], [], [], [], [], []
    for i, text in enumerate(texts):
        begin, end = int(offsets[i]), int(offsets[i + 1])
        size = end - begin
        lines.append(_repeated_lines(text.as_py()))
        ratio = len(press.compress(view[begin:end])) / size if size else None
        each = [ratio] if size <= CHUNK else [len(press.compress(view[k:k + CHUNK])) / CHUNK for k in (*range(begin, end - CHUNK, CHUNK), end - CHUNK)]
        each = each if size else []
        low, high = sum(r < CHUNK_BAND[0] for r in each), sum(r > CHUNK_BAND[1] for r in each)
        ratios.append(ratio)
        chunks.append(len(each))
        lows.append(low)
        highs.append(high)
        reasons.append("base" if failed[i] else _verdict(size, ratio, len(each), low, high))
    kept = [r is None for r in reasons]
    return pa.RecordBatch.from_arrays(
        [pa.array(n_words), pa.array(points), pa.array(symbols), pa.array(lines, pa.int64()), pa.array(repeats), pa.array(failed),
         pa.array(kept, pa.bool_()), pa.array(ratios, pa.float64()), pa.array(chunks, pa.int64()), pa.array(lows, pa.int64()),
         pa.array(highs, pa.int64()), pa.array(reasons, pa.string())],
        names=[part.split()[0] for part in MEASURES.split(", ")])


def quality_measures(docs: DataFrame) -> DataFrame:
    """doc_id with MEASURES of its whole text, one row per row of ``docs``.

    NULL and empty texts have no words, so they fail the base rule and their ratio is NULL; a NULL doc_id and repeated rows
    come back as they are; other columns, whatever they are called, are not read. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=["doc_id", *out.schema.names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; what counts as good is as in ``quality_measures``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(measure(batch.column(at)).column("kept"))

    return docs.mapInArrow(run, docs.schema)
