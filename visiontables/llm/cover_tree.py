"""A cover tree over the rows of one part, for inner products.

Rows get one more coordinate so that all have the same norm M; an inner product with a query then depends on the angle between
the two alone. A node has a row as its centre and a covering radius, the largest angle from there to any row below it. An angle
is off by at most the radius, which gives an interval for the inner products of all rows below a node.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np

LEAF = 32
CHILDREN = 16


def augmented(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Unit vectors: the rows with the coordinate that brings each to the norm ``norm``, divided by it."""
    rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", vectors, vectors, dtype=float), 0.0))
    return np.column_stack((vectors, rest)) / norm


def farthest_first(points: np.ndarray, first: int, most: int, enough: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, each the row farthest from those before it, until all rows lie within ``enough`` of one; each row's centre and cosine."""
    centres, of = [first], np.zeros(len(points), np.int64)
    best = points @ points[first]
    while len(centres) < most and (at := int(best.argmin())) not in centres and best[at] < np.cos(enough):
        own = points @ points[at]
        of[own > best] = len(centres)
        best = np.maximum(best, own)
        centres.append(at)
    return np.asarray(centres), of, np.clip(best, -1.0, 1.0)


@dataclass
class Level:
    """Nodes of one depth: centre (a row's place), radius, rows ``begin`` to ``end``, and the place of the parent one level up."""

    centre: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray


def build(points: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """The order of the rows along the tree's leaves, and its levels from the root down."""
    order = np.arange(len(points))
    levels, radius = [], np.arccos(np.clip((points @ points[0]).min(initial=1.0), -1.0, 1.0))
    nodes = [(0, radius, 0, len(points), 0)]  # centre (a row), radius, begin, end, parent
    while nodes:
        leaf = np.asarray([e - b <= LEAF or r < 1e-7 for _, r, b, e, _ in nodes])
        centre, rad, begin, end, parent = (np.asarray(c) for c in zip(*nodes, strict=True))
        levels.append(Level(centre.astype(np.int64), rad.astype(float), begin.astype(np.int64), end.astype(np.int64), parent.astype(np.int64), leaf))
        below = []
        for k in np.flatnonzero(~leaf):
            rows = order[begin[k]:end[k]].copy()
            centres, of, best = farthest_first(points[rows], int(np.flatnonzero(rows == centre[k])[0]), CHILDREN, rad[k] / 2)
            turn = np.argsort(of, kind="stable")
            order[begin[k]:end[k]] = rows[turn]
            stops = np.searchsorted(of[turn], np.arange(len(centres) + 1))
            for c in range(len(centres)):
                inside = best[turn[stops[c]:stops[c + 1]]]
                below.append((rows[centres[c]], float(np.arccos(inside.min())), begin[k] + stops[c], begin[k] + stops[c + 1], k))
        nodes = below
    return order, levels


def pack(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, vectors: np.ndarray, norm: float) -> bytes:
    order, levels = build(augmented(vectors, norm))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    for level in levels:
        level.centre = place[level.centre]
    return pickle.dumps((ids[order], labels[order], rows[order], vectors[order], levels), protocol=5)


def interval(queries: np.ndarray, norms: np.ndarray, centres: np.ndarray, radius: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product that a query (row) can have with a row below a node (column)."""
    product = np.clip((queries @ centres.T) / np.maximum(norms, 1e-300)[:, None] / norm, -1.0, 1.0)
    angle, reach, slack = np.arccos(product), radius[None, :] + 1e-6, 1e-9 * norms[:, None] * norm + 1e-6
    scale = norms[:, None] * norm
    return scale * np.cos(np.minimum(angle + reach, np.pi)) - slack, scale * np.cos(np.maximum(angle - reach, 0.0)) + slack


def reached(least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether an interval meets one of the query's windows (columns of ``low`` and ``high``)."""
    out = np.zeros(least.shape, bool)
    for w in range(low.shape[1]):
        out |= (most >= low[:, w, None]) & (least <= high[:, w, None])
    return out


def best(found: list[np.ndarray], k: int) -> np.ndarray:
    """Of rows (query, window, score, id, row), the first k of each query and window: high scores, then small ids."""
    rows = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
    rows = rows[np.lexsort((rows[:, 4], rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rank = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    return rows[rank < k]


def visit(payload: bytes, queries: np.ndarray, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, norm: float) -> np.ndarray:
    """(query's place, window, score, id, row) of the first k rows of the part in each window, by inner product.

    Descends level by level through the nodes whose interval meets a window, then takes each query's leaves by falling bound,
    twice as many in every step, raising windows to the k-th score found. Scores are those of whole vectors.
    """
    ids, marks, rows, vectors, levels = pickle.loads(payload)
    low, norms = low.copy(), np.sqrt(np.einsum("ij,ij->i", queries, queries, dtype=float))
    floats = queries.astype(float)
    active = np.ones((len(queries), 1), bool)
    leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for depth, level in enumerate(levels):
        open_ = active[:, level.parent] if depth else active
        near = np.flatnonzero(open_.any(axis=0))
        least, most = np.full(open_.shape, np.inf), np.full(open_.shape, -np.inf)
        least[:, near], most[:, near] = interval(floats, norms, vectors[level.centre[near]].astype(float), level.radius[near], norm)
        active = open_ & reached(least, most, low, high)
        at = np.flatnonzero(level.leaf & active.any(axis=0))
        if len(at):
            leaves.append((level.begin[at], level.end[at], np.where(active[:, at], least[:, at], np.inf), np.where(active[:, at], most[:, at], -np.inf)))
    if not leaves:
        return np.zeros((0, 5), np.int64)
    begin, end = np.concatenate([x[0] for x in leaves]), np.concatenate([x[1] for x in leaves])
    least, most = np.concatenate([x[2] for x in leaves], axis=1), np.concatenate([x[3] for x in leaves], axis=1)
    turn = np.argsort(-most, axis=1, kind="stable")
    kept, start, width = np.zeros((0, 5), np.int64), 0, 1
    while start < len(begin):
        columns = turn[:, start:start + width]
        who = np.arange(len(queries))[:, None]
        asked = reached(least[who, columns], most[who, columns], low, high)
        places, leaf = np.nonzero(asked)[0], columns[asked]
        found = [kept]
        order = np.argsort(leaf, kind="stable")
        places, leaf = places[order], leaf[order]
        cuts = np.append(np.flatnonzero(np.diff(leaf, prepend=-1)), len(leaf))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            asking, part = places[a:b], slice(begin[leaf[a]], end[leaf[a]])
            score = queries[asking] @ vectors[part].T
            fits = ((labels[asking, None] == marks[None, part]) == same) & (own[asking, None] != rows[None, part])
            for w in range(low.shape[1]):
                q, r = np.nonzero(fits & (score >= low[asking, w, None]) & (score <= high[asking, w, None]))
                if len(q):
                    found.append(np.column_stack((asking[q], np.full(len(q), w), score[q, r].astype(np.int64), ids[part][r], rows[part][r])))
        kept = best(found, k)
        if len(kept):
            last = np.flatnonzero(np.append((kept[1:, :2] != kept[:-1, :2]).any(axis=1), True))
            full = last[np.diff(np.append(-1, last)) == k]
            low[kept[full, 0], kept[full, 1]] = kept[full, 2]
        start, width = start + width, 2 * width
    return kept
