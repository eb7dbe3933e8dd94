"""Words of whole texts as 64-bit numbers, a batch of documents at a time.

A text is bytes; which bytes end a word is a table of 256 flags (every separator used here is ASCII, so multi-byte
characters are never cut). A word's number is a polynomial over its bytes, taken from one running sum over the batch, so
the work is a few NumPy passes whatever the lengths are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes scanned together; a longer document is scanned in segments that end at a separator.
SEGMENT = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Flags of the bytes in the given inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


#: Words are what stands between ASCII white space.
SPACE = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are ASCII letters (of either case) and digits and everything beyond ASCII.
PUNCTUATION = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]
_STEP = 0xD1342543DE82EF95
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial's base and of its inverse, modulo 2^64."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, SEGMENT + 1024)
        up, down = np.full(size, _STEP, dtype=np.uint64), np.full(size, pow(_STEP, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        pair = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
        if size > 4 * SEGMENT:
            return pair[0], pair[1]
        _tables[:] = pair
    return _tables[0], _tables[1]


def hash_word(word: str, lower: bool = True) -> int:
    """The number that the scan gives this word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    values = (_LOWER if lower else _VALUE)[data]
    with np.errstate(over="ignore"):
        total = np.sum(values * _powers(len(data))[0][:len(data)], dtype=np.uint64)
        return int(mix(np.asarray([total + np.uint64(len(data))], dtype=np.uint64))[0])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts one after the other, and where each begins (and the last ends). NULL is empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if raw[2] is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def runs(texts: pa.Array, most: int = SEGMENT) -> Iterator[pa.Array]:
    """The texts in slices of at most ``most`` bytes, or of one longer text."""
    _, offsets = buffers(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flags between each two offsets are set."""
    if len(offsets) < 2:
        return np.zeros(0, np.int64)
    total = np.add.reduceat(np.append(flags, False), offsets[:-1], dtype=np.int64)
    return np.where(offsets[1:] > offsets[:-1], total, 0)


def _segment(data: np.ndarray, starts_doc: np.ndarray, seps: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of some bytes, where the words begin and where they end; ``starts_doc`` are positions where a new document begins."""
    inside = ~seps[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = False
    edge[starts_doc] = True
    begins = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64)), begins, ends


def scan(texts: pa.Array, seps: np.ndarray = SPACE, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, word numbers, where each document's words begin and the last's end), in order of the documents."""
    for low, high, words, bounds, *_ in scan_placed(texts, seps, lower):
        yield low, high, words, bounds


def scan_placed(texts: pa.Array, seps: np.ndarray = SPACE, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``scan``, and where each word begins and ends in the bytes of all texts (as ``buffers`` gives them)."""
    data, offsets = buffers(texts)
    values = _LOWER if lower else _VALUE
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT, side="right")) - 1)
        low, high = int(offsets[at]), int(offsets[end])
        if high - low <= SEGMENT:
            own = offsets[at:end + 1] - low
            words, begins, ends = _segment(data[low:high], own, seps, values)
            yield at, end, words, np.searchsorted(begins, own), begins + low, ends + low
        else:  # one long document
            parts, places, cut = [], [], low
            while cut < high:
                stop = min(cut + SEGMENT, high)
                if stop < high:
                    tail = np.flatnonzero(seps[data[cut:stop]])
                    while not len(tail) and stop < high:  # a word longer than a segment
                        new = min(stop + SEGMENT, high)
                        tail = np.flatnonzero(seps[data[stop:new]]) + (stop - cut)
                        stop = new
                    stop = cut + int(tail[-1]) + 1 if len(tail) else high
                words, begins, ends = _segment(data[cut:stop], np.asarray([0, stop - cut]), seps, values)
                parts.append(words)
                places.append((begins + cut, ends + cut))
                cut = stop
            words = np.concatenate(parts)
            yield at, end, words, np.asarray([0, len(words)]), *map(np.concatenate, zip(*places, strict=True))
        at = end


def windows(words: np.ndarray, bounds: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-word windows and where each document's begin. With ``short``, fewer words make one window."""
    counts = np.diff(bounds)
    made = np.maximum(counts - n + 1, 0)
    ends = np.concatenate(([0], np.cumsum(made)))
    grams = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        grams += mix(words[k:k + len(grams)] + np.uint64((k + 1) * _ODD & _MASK))
    grams = mix(grams)
    owner = np.repeat(np.arange(len(counts)), made)
    out = grams[np.arange(ends[-1]) - ends[owner] + bounds[owner]] if len(owner) else np.zeros(0, np.uint64)
    few = np.flatnonzero((counts > 0) & (counts < n)) if short else []
    if not len(few):
        return out, ends
    sizes = made.copy()
    sizes[few] = 1
    new_ends = np.concatenate(([0], np.cumsum(sizes)))
    full = np.zeros(new_ends[-1], dtype=np.uint64)
    full[np.arange(len(out)) - ends[owner] + new_ends[owner]] = out
    for i in few:
        seq = words[bounds[i]:bounds[i + 1]]
        full[new_ends[i]] = mix(np.asarray([np.sum(mix(seq + np.arange(1, len(seq) + 1, dtype=np.uint64) * np.uint64(_ODD)), dtype=np.uint64) + np.uint64(len(seq))]))[0]
    return full, new_ends


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's values sorted and without repeats, and where each document's begin."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[first], owner[first]
    return values, np.searchsorted(owner, np.arange(len(bounds)))
