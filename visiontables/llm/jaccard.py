"""Similarity join of word shingles by count vectors in R-trees.

A document is the set of its n-word shingles. Shingles are hashed into groups; a document's group counts are its point, and
two documents share at most the sum of the smaller count of each group. An R-tree over the points prunes with the same bound
taken over boxes, and what survives is verified on the sets.

A single tree over all documents would not be a distributed job, so the groups also say which points have to meet at all.
Two sets that link differ in at most D shingles. With more than D groups, some group has the very same shingles in both; the
groups' contents are keys, and only documents that a chain of shared keys connects can link. Nothing that links is lost. A
few more groups than D + 1 let empty groups go unused, which documents would share by chance, and shingles that many
documents share are left out of the contents.

Such clusters are split twice. First the trees connect the points whose bound allows a link; that needs no sets, only some
bytes a document. Then the sets of each part that is left are fetched, and the trees' surviving pairs are verified until all
are connected that links connect. Equal sets are one point throughout. A cluster is as large as fits a task. Chance chains
documents into clusters that grow with the table; in a larger one, the points meet within each key that few of them share,
and the other keys alone say which clusters are left. What even then, or of the sets, is too large for a task is first tried
against one of its documents, and the documents not settled by that meet the others tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visiontables.llm.components import components
from visiontables.llm.words import distinct, mix, scan, windows
from visiontables.operators.stages import discard, materialize

#: Coordinates by which a tree prunes; a point has more, a power of two of them, one for SHINGLES_PER_GROUP or fewer.
GROUPS = 32
SHINGLES_PER_GROUP = 8
MOST_GROUPS = 4096
#: Children of a node of the tree.
FANOUT = 16
#: Largest set sizes of the size classes, each half as large again as the one before.
SIZES = [8]
while SIZES[-1] < 1 << 40:
    SIZES.append(SIZES[-1] * 3 // 2)
SIZES = np.asarray(SIZES)
#: Points, and shingles, that meet in one task; bounds its memory.
TASK_POINTS = 20_000
TASK_SHINGLES = 2_000_000
#: Neighbours by size among which a tree's order goes by the other coordinates.
SLAB = 512
#: Documents looked at for common shingles, about, and how many of them share one.
SAMPLED = 10_000
COMMON = 5
#: Documents seen by a task whose keys it does not send twice.
REMEMBERED = 500_000
#: Classes of one key that a task holds to see whether another key has the same ones.
HELD = 1_000_000
#: Points that meet without a tree, at most; and classes of a key that meet by themselves in a cluster too large for a task.
FEW = 64
#: Points tried with all others of their tree before it is joined that may connect fewer than FANOUT of them.
STARS = 16


def keys_of(sets: np.ndarray, bounds: np.ndarray, percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the set) such that any two different sets that link share a key.

    Shingles of ``common`` (sorted) are left out of the contents: that can only lessen the differences between two sets, so
    the count of groups still suffices, and what many documents share by custom makes no keys. Of two sets that link, more
    than ``spare`` groups are equal, so unless both have more empty groups than that they share a filled one. Sets with so
    many empty groups have keys of all their shingles besides.
    """
    n = np.diff(bounds)
    own, reach = np.searchsorted(SIZES, n), np.searchsorted(SIZES, n * 100 // percent)
    out_keys, out_sets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    some = common is not None and len(common)
    if some:
        rare = common[np.minimum(np.searchsorted(common, sets), len(common) - 1)] != sets
        owner = np.repeat(np.arange(len(n)), n)[rare]
        kept = sets[rare], np.searchsorted(owner, np.arange(len(n) + 1))
    for up in range(int((reach - own).max(initial=0)) + 1):
        chosen = np.flatnonzero((n > 0) & (own + up <= reach))
        differ = 2 * SIZES[own[chosen] + up] * (100 - percent) // (100 + percent)
        chosen, differ = chosen[differ > 0], differ[differ > 0]
        if some and len(chosen):
            keys, of, crowded = _contents(*kept, chosen, differ, all_empty=False)
            out_keys.append(keys)
            out_sets.append(of)
            chosen, differ = chosen[crowded], differ[crowded]
        if len(chosen):
            keys, of, _ = _contents(sets, bounds, chosen, differ, all_empty=True)
            out_keys.append(keys)
            out_sets.append(of)
    return np.concatenate(out_keys), np.concatenate(out_sets)


def _contents(sets: np.ndarray, bounds: np.ndarray, chosen: np.ndarray, differ: np.ndarray, all_empty: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set) of the groups of the chosen sets, and which sets have more empty groups than are to spare.

    Those of them have keys for their empty groups too where ``all_empty`` is set.
    """
    spare = 1 + differ // 8
    groups = differ + 1 + spare
    base = np.concatenate(([0], np.cumsum(groups)))
    size = np.diff(bounds)[chosen]
    member = np.repeat(np.arange(len(chosen)), size)
    values = sets[np.arange(len(member)) + np.repeat(bounds[:-1][chosen] - np.concatenate(([0], np.cumsum(size)[:-1])), size)]
    cell = base[member] + (mix(values ^ np.uint64(0x5851F42D4C957F2D)) % groups[member].astype(np.uint64)).astype(np.int64)
    total = int(base[-1])
    content = np.zeros(total, np.uint64)
    np.add.at(content, cell, mix(values + np.uint64(0x14057B7EF767814F)))
    filled = np.bincount(cell, minlength=total)
    owner = np.repeat(np.arange(len(chosen)), groups)
    crowded = np.bincount(owner[filled == 0], minlength=len(chosen)) > spare
    used = (filled > 0) | (crowded[owner] & all_empty)
    number = np.arange(total) - base[owner]
    salt = groups[owner].astype(np.uint64) * np.uint64(2) + np.uint64(all_empty)
    key = mix(content + mix(number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) + filled.astype(np.uint64))
    return key[used], chosen[owner[used]], crowded


def class_of(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each set, the same for equal sets."""
    padded = np.concatenate((mix(sets ^ np.uint64(0x2545F4914F6CDD1D)), np.zeros(1, np.uint64)))
    sums = np.add.reduceat(padded, np.minimum(bounds[:-1], len(sets))) if len(bounds) > 1 else np.zeros(0, np.uint64)
    size = np.diff(bounds)
    return mix(np.where(size > 0, sums, np.uint64(0)) + size.astype(np.uint64))


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, sorted distinct shingles, bounds)."""
    for low, high, words, bounds in scan(texts):
        grams, ends = windows(words, bounds, n, short=True)
        yield low, high, *distinct(grams, ends)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def points_of(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group counts of each set one after the other, and where each set's begin."""
    n = np.diff(bounds)
    groups = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / SHINGLES_PER_GROUP)).astype(np.int64).clip(0), GROUPS, MOST_GROUPS)
    base = np.concatenate(([0], np.cumsum(groups)))
    cell = np.repeat(base[:-1], n) + (mix(sets) & np.repeat(groups - 1, n).astype(np.uint64)).astype(np.int64)
    return np.bincount(cell, minlength=int(base[-1])).astype(np.uint32), base


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, cls, point) of every row; cls is NULL for an empty set."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, sets, bounds in shingle_sets(batch.column(1), n):
                size = np.diff(bounds)
                cls = class_of(sets, bounds).view(np.int64)
                counts, base = points_of(sets, bounds)
                wide = counts.astype("<u2") if counts.max(initial=0) < 1 << 16 else counts.astype("<u4")
                raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((base * wide.itemsize).astype(np.int32)), pa.py_buffer(wide)])
                marked = pa.array(np.full(len(size), wide.itemsize, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(size), pa.array(cls, mask=size == 0), raw, marked], names=["doc_id", "n_shingles", "cls", "point", "width"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, cls bigint, point binary, width int")


def _common(docs: DataFrame, n: int, total: int) -> np.ndarray:
    """Shingles that COMMON or more of about SAMPLED different documents share, chosen by a hash; the result is exact without them too."""
    every = max(1, total // SAMPLED)
    sets = _sets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0), n).dropDuplicates(["cls"])
    counted = sets.select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= COMMON)
    return np.sort(counted.select("s").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _keys(docs: DataFrame, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """(key, cls): the keys of every different set that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, sets, bounds in shingle_sets(batch.column(0), n):
                cls = class_of(sets, bounds)
                new = np.zeros(len(cls), dtype=bool)
                new[np.unique(cls, return_index=True)[1]] = True
                new &= np.asarray([c not in seen for c in cls.tolist()], dtype=bool)
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.update(cls[new].tolist())
                keys, of = keys_of(sets, bounds, percent, common)
                keys, of = keys[new[of]], of[new[of]]
                for k in range(0, max(len(keys), 1), 100_000):
                    yield pa.RecordBatch.from_arrays([_signed(keys[k:k + 100_000]), _signed(cls[of[k:k + 100_000]])], names=["key", "cls"])

    return docs.select("text").mapInArrow(run, "key bigint, cls bigint")


def _groups(keys: DataFrame) -> DataFrame:
    """(name, cls, least, size): the classes of every key that different ones share, the smallest and the number of them.

    Keys with the same classes have one name, as they say the same. One of more than HELD classes keeps a name of its own.
    """

    def rows(name: np.ndarray, cls: np.ndarray, least: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed(name), pa.array(cls), pa.array(least), pa.array(size)], names=["name", "cls", "least", "size"])

    def crowded(key: np.ndarray, cls: np.ndarray, least: np.int64) -> pa.RecordBatch:
        return rows(key, cls, np.full(len(key), least), np.full(len(key), HELD))

    def named(key: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls = key[new], cls[new]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(starts, len(key)))
        name = mix(np.add.reduceat(mix(cls.view(np.uint64) ^ np.uint64(0x6C62272E07BB0142)), starts) + size.astype(np.uint64))
        shared = np.repeat(size > 1, size)
        return rows(np.repeat(name, size)[shared], cls[shared], np.repeat(cls[starts], size)[shared], np.repeat(size, size)[shared])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the rows of the last key, which may go on
        crowd = None  # a key of which rows have gone, and its smallest class
        for batch in batches:
            k, c = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            if crowd is not None:
                more = int(np.searchsorted(k, crowd[0], side="right"))
                yield crowded(k[:more], c[:more], crowd[1])
                k, c = k[more:], c[more:]
            if not len(k):
                continue
            crowd = None
            last = int(np.searchsorted(k, k[-1], side="left"))
            if last or (held and held[0][0][0] != k[0]):
                yield named(*(np.concatenate(x) for x in zip(*held, (k[:last], c[:last]), strict=True)))
                held = []
            held.append((k[last:], c[last:]))
            if sum(len(x) for x, _ in held) > HELD:
                crowd = held[0][0][0], held[0][1][0]
                yield from (crowded(x, y, crowd[1]) for x, y in held)
                held = []
        if held:
            yield named(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return keys.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(run, "name bigint, cls bigint, least bigint, size bigint").distinct()


def tree(points: np.ndarray, sizes: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Order of the points, and the tree's levels from the points up: low corners, high corners and smallest sizes of each node.

    The order goes by ``part`` if there is one, by size, and among SLAB neighbours by halving at the median of the widest
    coordinate, so neighbours are close; node k of a level holds nodes FANOUT * k and so on of the level below. Levels are filled up with nodes that nothing
    can overlap.
    """
    by_size = np.argsort(sizes, kind="stable") if part is None else np.lexsort((sizes, part))
    order, stack = [], [by_size[k:k + SLAB] for k in range(0, len(points), SLAB)][::-1]
    while stack:
        some = stack.pop()
        if len(some) <= FANOUT:
            order.append(some)
            continue
        own = points[some]
        wide = int(np.argmax(own.max(0) - own.min(0)))
        half = -(-len(some) // (2 * FANOUT)) * FANOUT
        split = np.argsort(own[:, wide], kind="stable")
        stack += [some[split[half:]], some[split[:half]]]
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    low = high = points[order]
    small = sizes[order]
    levels = []
    while True:
        fill = -len(low) % FANOUT
        low = np.vstack((low, np.full((fill, low.shape[1]), 1 << 30, low.dtype)))
        high = np.vstack((high, np.full((fill, high.shape[1]), -1, high.dtype)))
        small = np.concatenate((small, np.full(fill, 1 << 40, small.dtype)))
        levels.append((low, high, small))
        if len(low) <= FANOUT:
            return order, levels
        low, high, small = low.reshape(-1, FANOUT, low.shape[1]).min(1), high.reshape(-1, FANOUT, high.shape[1]).max(1), small.reshape(-1, FANOUT).min(1)


def _folded(point: np.ndarray, groups: int) -> np.ndarray:
    """A point's counts in fewer groups."""
    return point.reshape(-1, groups).sum(0, dtype=np.int64)


def _level(points: list[np.ndarray]) -> np.ndarray:
    """Points in the groups that all of them have."""
    groups = min(map(len, points))
    return np.stack([p if len(p) == groups else _folded(p, groups) for p in points]).astype(np.int32)


def _joined(points: list[np.ndarray], sizes: np.ndarray, percent: int, label: np.ndarray, test) -> list[tuple[int, int]]:
    """Pairs (i, j) that ``test`` accepts, enough to connect all that such pairs connect; ``label`` says what is connected.

    The tree is joined with itself. Pairs of nodes whose boxes can't hold the shared shingles that a link needs are left
    out; of the pairs of points that remain, those in different parts are checked on all their groups and then tested. Before
    that, points that many others are like connect these one by one; nodes that lie in one part already are left out too.
    """
    if len(points) <= FEW:
        own, found = _level(points), []
        ok = (100 + percent) * np.minimum(own[:, None, :], own[None, :, :]).sum(2, dtype=np.int64) >= percent * (sizes[:, None] + sizes[None, :])
        _tried(*np.nonzero(np.triu(ok, 1)), label, test, found)
        return found
    coarse = np.stack([_folded(p, GROUPS) for p in points]).astype(np.int32)
    found = _starred(points, coarse, sizes, percent, label, test)
    if (label == label[0]).all():
        return found
    _, part, members = np.unique(label, return_inverse=True, return_counts=True)
    order, levels = tree(coarse, sizes, np.where(members[part] > FANOUT, part, -1))
    spans = _spans(part[order], levels)
    leaves = []
    for k in range(0, len(order), FANOUT):
        leaves.append(_level([points[i] for i in order[k:k + FANOUT]]))
    stack = [(len(levels) - 1, 0, 0)]
    step = np.arange(FANOUT)
    while stack:
        level, a, b = stack.pop()
        _, high, small = levels[level]
        left, right = slice(a * FANOUT, (a + 1) * FANOUT), slice(b * FANOUT, (b + 1) * FANOUT)
        if not level:
            i, j = order[left], order[right]
            differ = label[i][:, None] != label[j][None, :]
            if not differ.any():
                continue
        shared = np.minimum(high[left][:, None, :], high[right][None, :, :]).sum(2, dtype=np.int64)
        needed = percent * (small[left][:, None] + small[right][None, :])
        ok = (100 + percent) * shared >= needed
        if a == b:
            ok &= step[:, None] <= step[None, :] if level else step[:, None] < step[None, :]
        if level:
            first, last = spans[level]
            ok &= (first[left][:, None] != last[right][None, :]) | (last[left][:, None] != first[right][None, :])
            rows, cols = np.nonzero(ok)
            stack += [(level - 1, a * FANOUT + int(r), b * FANOUT + int(c)) for r, c in zip(rows, cols, strict=True)]
            continue
        ok = ok[:len(i), :len(j)] & differ
        if not ok.any():
            continue
        one, other = leaves[a], leaves[b]
        groups = min(one.shape[1], other.shape[1])
        one, other = one.reshape(len(one), -1, groups).sum(1), other.reshape(len(other), -1, groups).sum(1)
        rows, cols = np.nonzero(ok & ((100 + percent) * np.minimum(one[:, None, :], other[None, :, :]).sum(2) >= needed[:len(i), :len(j)]))
        _tried(i[rows], j[cols], label, test, found)
    return found


def _tried(one: np.ndarray, other: np.ndarray, label: np.ndarray, test, found: list[tuple[int, int]]) -> None:
    """Test the pairs whose labels differ; those accepted go to ``found`` and share a label."""
    for x, y in zip(one.tolist(), other.tolist(), strict=True):
        if label[x] != label[y] and test(x, y):
            found.append((x, y))
            label[label == label[y]] = label[x]


def _starred(points: list[np.ndarray], coarse: np.ndarray, sizes: np.ndarray, percent: int, label: np.ndarray, test) -> list[tuple[int, int]]:
    """Pairs that ``test`` accepts of points with all others, in ``label`` too; up to STARS points connect fewer than FANOUT others each."""
    found: list[tuple[int, int]] = []
    few, tried, groups = 0, np.zeros(len(points), dtype=bool), np.asarray([len(p) for p in points])
    while few < STARS:
        _, part, members = np.unique(label, return_inverse=True, return_counts=True)
        alone = np.flatnonzero(~tried & (members[part] == 1))
        if not len(alone):
            break
        x = int(alone[len(alone) // 2])
        tried[x] = True
        near = np.flatnonzero((label != label[x]) & ((100 + percent) * np.minimum(coarse, coarse[x]).sum(1, dtype=np.int64) >= percent * (sizes + sizes[x])))
        before = len(found)
        for n in np.unique(groups[near]):
            same = near[groups[near] == n]
            own = _level([points[x], *[points[y] for y in same]])
            same = same[(100 + percent) * np.minimum(own[1:], own[0]).sum(1, dtype=np.int64) >= percent * (sizes[same] + sizes[x])]
            _tried(np.full(len(same), x), same, label, test, found)
        few += len(found) - before < FANOUT
    return found


def _spans(part: np.ndarray, levels: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and largest part among the points below each node of the levels; of what only fills a level up, none."""
    out = []
    low = high = part
    for nodes, _, _ in levels:
        low = np.concatenate((low, np.full(len(nodes) - len(low), 1 << 60)))
        high = np.concatenate((high, np.full(len(nodes) - len(high), -1)))
        out.append((low, high))
        low, high = low.reshape(-1, FANOUT).min(1), high.reshape(-1, FANOUT).max(1)
    return out


def linked(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Enough verified links (i, j) to connect all sets that links connect; sets with one label count as connected already."""
    sizes = np.asarray([len(s) for s in sets], dtype=np.int64)
    counts, base = points_of(np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes))))

    def verify(x: int, y: int) -> bool:
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both)

    return _joined(np.split(counts, base[1:-1]), sizes, percent, np.arange(len(sets)) if labels is None else labels.copy(), verify)


def may_link(points: list[np.ndarray], sizes: np.ndarray, percent: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Enough pairs (i, j) to connect all points that pairs whose bound allows a link connect."""
    return _joined(points, sizes, percent, np.arange(len(points)) if labels is None else labels.copy(), lambda x, y: True)


def _pairs(tasks: DataFrame, payload: list[str], find) -> DataFrame:
    """(a, b): what ``find(rows of payload, labels)`` connects inside each task; rows are (task columns..., cls, settled, payload...)."""
    names = [c for c in tasks.columns if c not in ("cls", "settled", *payload)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []

        def links(cls: list[int], settled: list[bool], rows: list[tuple]) -> None:
            labels = np.arange(len(cls))
            labels[np.asarray(settled, dtype=bool)] = len(cls)
            found.extend((cls[i], cls[j]) for i, j in find(rows, labels))

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
            found.clear()
            return out

        key, cls, settled, rows = None, [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            own, flags = batch.column("cls").to_pylist(), batch.column("settled").to_pylist()
            columns = [batch.column(c) for c in payload]
            for r, task in enumerate(keys):
                if task != key:
                    if len(cls) > 1:
                        links(cls, settled, rows)
                    if len(found) > 10_000:
                        yield sent()
                    key, cls, settled, rows = task, [], [], []
                if cls and own[r] == cls[-1]:
                    continue
                cls.append(own[r])
                settled.append(flags[r])
                rows.append(tuple(c[r] for c in columns))
        if len(cls) > 1:
            links(cls, settled, rows)
        yield sent()

    return tasks.repartition(*names).sortWithinPartitions(*names, "cls").mapInArrow(run, "a bigint, b bigint")


def _connected(members: DataFrame, payload: list[str], weight: Column, limit: int, find, hub_test) -> DataFrame:
    """(a, b) from ``find`` over ``members`` (root, cls, payload...), only members of one root being tried with each other.

    Roots whose members weigh up to ``limit`` are one task. Members of larger ones are settled if ``hub_test`` accepts them
    with the smallest member; tiles of the others meet each other and the tiles of the settled ones.
    """
    own = members.select("root", "cls", *payload)
    weights = materialize(own.groupBy("root").agg(F.sum(weight).alias("weight"), F.min("cls").alias("hub")).where(F.col("weight") > limit), "large")
    pairs = _pairs(own.join(weights, "root", "left_anti").select("root", "cls", F.lit(False).alias("settled"), *payload), payload, find)
    if weights.isEmpty():
        return pairs
    large = own.join(weights.select("root", "hub"), "root")
    hub = large.where(F.col("cls") == F.col("hub")).select("root", *[F.col(c).alias(f"hub_{c}") for c in payload])
    tried = materialize(large.join(hub, "root").select("root", "cls", "hub", *payload, hub_test.alias("settled")), "tried")
    half = F.lit(2 / limit)
    tiles = materialize(tried.groupBy("root").agg(
        F.ceil(F.sum(F.when(~F.col("settled"), weight).otherwise(0)) * half).cast("int").alias("n_open"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("settled"), weight).otherwise(0)) * half)).cast("int").alias("n_settled")), "tiles")
    at = lambda m: F.pmod(F.xxhash64("cls"), F.greatest(F.lit(1), F.col(m))).cast("int")
    upto = lambda m: F.sequence(F.lit(0), F.col(m) - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    among = F.transform(upto("n_open"), lambda k: cell("open", F.least(k, at("n_open")), F.greatest(k, at("n_open"))))
    with_settled = F.transform(upto("n_settled"), lambda k: cell("settled", at("n_open"), k))
    with_open = F.transform(upto("n_open"), lambda k: cell("settled", k, at("n_settled")))
    spread = (tried.join(tiles, "root").where(F.col("n_open") > 0)
              .withColumn("task", F.explode(F.when(F.col("settled"), with_open).otherwise(F.concat(among, with_settled))))
              .select("root", F.col("task.kind").alias("kind"), F.col("task.i").alias("i"), F.col("task.j").alias("j"), "cls", "settled", *payload))
    stars = tried.where(F.col("settled") & (F.col("cls") != F.col("hub"))).select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    return pairs.unionAll(stars).unionAll(_pairs(spread, payload, find))


def _clusters(groups: DataFrame) -> DataFrame:
    """(node, root): what chains of shared keys connect."""
    return materialize(components(groups.select(F.col("cls").alias("a"), F.col("least").alias("b"))), "met")


def _tasks(groups: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """(root, cls): who has to meet, root being a cluster of up to ``limit`` classes or the name of a key; and the stages that it reads.

    In a larger cluster each key of up to ``few`` classes is a task. The others, whose classes share many keys and are not to
    meet in each of them, make new clusters; of these the larger ones are taken apart by more classes a key.
    """
    out, stages, few = [], [], FEW
    while True:
        met = _clusters(groups)
        large = materialize(met.groupBy("root").count().where(F.col("count") > limit).select("root"), "chained")
        stages += [met, large]
        out.append(met.join(large, "root", "left_anti").select("root", F.col("node").alias("cls")))
        if large.isEmpty():
            break
        chained = groups.join(met.join(large, "root", "left_semi"), F.col("least") == F.col("node"), "left_semi")
        own = chained.where(F.col("size") <= few) if few < limit else chained
        out.append(own.select(F.col("name").alias("root"), "cls"))
        if few >= limit:
            break
        groups = materialize(chained.where(F.col("size") > few), "groups")
        stages.append(groups)
        few *= 4
    return reduce(DataFrame.unionAll, out), stages


def _point(raw: pa.Scalar, width: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_py(), dtype=f"<u{width.as_py()}")


def _bounded(members: DataFrame, percent: int, limit: int) -> DataFrame:
    """Pairs of members (root, cls, n_shingles, point, width) of one root whose bound allows a link."""

    def find(rows: list[tuple], labels: np.ndarray) -> list[tuple[int, int]]:
        return may_link([_point(r[1], r[2]) for r in rows], np.asarray([r[0].as_py() for r in rows], dtype=np.int64), percent, labels)

    @F.arrow_udf(T.BooleanType())
    def allowed(n: pa.Array, point: pa.Array, width: pa.Array, hub_n: pa.Array, hub_point: pa.Array, hub_width: pa.Array) -> pa.Array:
        out = []
        for m, p, w, k, q, v in zip(n, point, width, hub_n, hub_point, hub_width, strict=True):
            one, other = _point(p, w), _point(q, v)
            groups = min(len(one), len(other))
            out.append((100 + percent) * int(np.minimum(_folded(one, groups), _folded(other, groups)).sum()) >= percent * (m.as_py() + k.as_py()))
        return pa.array(out, pa.bool_())

    payload = ["n_shingles", "point", "width"]
    return _connected(members, payload, F.lit(1), limit, find, allowed(*payload, *[f"hub_{c}" for c in payload]))


def _links(members: DataFrame, percent: int, limit: int) -> DataFrame:
    """Verified links (a, b) among ``members`` (root, cls, shingles); only members of one root can link."""

    def find(rows: list[tuple], labels: np.ndarray) -> list[tuple[int, int]]:
        return linked([r[0].values.to_numpy(zero_copy_only=False).view(np.uint64) for r in rows], percent, labels)

    n = F.size("shingles").cast("bigint")
    both = F.size(F.array_intersect("shingles", "hub_shingles")).cast("bigint")
    return _connected(members, ["shingles"], n, limit, find, 100 * both >= percent * (n + F.size("hub_shingles") - both))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(cls, shingles) of every row with a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets, bounds in shingle_sets(batch.column(0), n):
                full = np.flatnonzero(np.diff(bounds))
                lists = pa.ListArray.from_arrays(pa.array(np.append(bounds[:-1][full], len(sets)), pa.int32()), _signed(sets))
                yield pa.RecordBatch.from_arrays([_signed(class_of(sets, bounds)[full]), lists], names=["cls", "shingles"])

    return docs.select("text").mapInArrow(run, "cls bigint, shingles array<bigint>")


def similarity_components(docs: DataFrame, n: int = 5, percent: int = 80, task_shingles: int = TASK_SHINGLES, task_points: int = TASK_POINTS) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of ``docs``; documents of one component are connected by links.

    Two rows link when 100 * intersection >= percent * union of their shingle sets. component_id is the smallest doc_id of
    the component (NULL only if all its rows have a NULL doc_id). NULL, empty and blank texts have no set, link with nothing
    and keep their own doc_id. Repeated rows have equal sets and so one component; rows of one doc_id with different texts
    are judged each by its own text. Other columns are not read. ``percent`` is from 70 to 100.
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent is from 70 to 100")
    rows = materialize(_classes(docs, n), "classes")
    groups = materialize(_groups(_keys(docs, n, percent, _common(docs, n, rows.count()))), "groups")
    tasks, stages = _tasks(groups, task_points)
    points = rows.join(tasks.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
    members = points.join(tasks, "cls").select("root", "cls", "n_shingles", "point", "width")
    clusters = materialize(components(_bounded(members, percent, task_points)), "clusters")
    for stage in (groups, *stages):
        discard(stage)
    reps = rows.join(clusters.select(F.col("node").alias("cls")), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("_rep"))
    wanted = materialize(reps.select("_rep").distinct(), "wanted")
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    members = materialize(_sets(texts, n).join(clusters.select(F.col("node").alias("cls"), "root"), "cls").select("root", "cls", "shingles"), "members")
    joined = components(_links(members, percent, task_shingles))
    named = rows.select("doc_id", "n_shingles", "cls").join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("_c", F.coalesce("root", "cls"))
    least = named.where(F.col("_c").isNotNull()).groupBy("_c").agg(F.min("doc_id").alias("component_id"))
    out = materialize(named.join(least, "_c", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "components")
    for stage in (rows, clusters, wanted, members):
        discard(stage)
    return out


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the first by doc_id, with all columns of ``docs``; rows without a set all stay.

    Columns may have any names besides doc_id and text. Rows that share a doc_id are one document, of which equal texts stay once. A row with a NULL doc_id can't be named as
    another's copy, so it stays.
    """
    marked = materialize(similarity_components(docs, n, percent).where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))), "kept")
    whole = docs.select(F.struct("*").alias("_row"))
    own = F.col("_row.doc_id")
    stay = whole.join(marked.select(F.col("doc_id").alias("_kept")).distinct(), own.eqNullSafe(F.col("_kept")), "left_semi")
    repeated = materialize(marked.where("doc_id is not null").groupBy(F.col("doc_id").alias("_twice")).agg(F.count("*").alias("_n")).where("_n > 1").select("_twice"), "repeated")
    if repeated.isEmpty():
        return stay.select("_row.*")
    again = own == F.col("_twice")
    once = stay.join(repeated, again, "left_semi").select("_row.*").dropDuplicates(["doc_id", "text"])
    return stay.join(repeated, again, "left_anti").select("_row.*").unionAll(once)
