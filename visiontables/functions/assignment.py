"""Least-cost one-to-one assignment of one bounded cost matrix (shortest augmenting paths on NumPy rows)."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs (row, col) of the cheapest matching in which leaving a pair unmatched costs ``limit``."""
    if cost.size == 0:
        return []
    # rows and columns without a pair below the limit stay unmatched whatever the rest does
    rows, cols = np.flatnonzero((cost < limit).any(1)), np.flatnonzero((cost < limit).any(0))
    if not len(rows):
        return []
    if len(rows) < cost.shape[0] or len(cols) < cost.shape[1]:
        return [(int(rows[i]), int(cols[j])) for i, j in assign(cost[np.ix_(rows, cols)], limit)]
    least = cost.argmin(1)
    if len(np.unique(least)) == len(least):  # every row can have its cheapest column
        return [(i, int(j)) for i, j in enumerate(least)]
    flipped = cost.shape[0] > cost.shape[1]
    c = np.minimum(np.asarray(cost.T if flipped else cost, dtype=float), limit)
    n, m = c.shape
    # priced at its cheapest column, a row may have that column unless an earlier row has it; only the others look for a path
    row_price, col_price = c.min(1), np.zeros(m)
    taken, first = np.unique(c.argmin(1), return_index=True)
    owner = np.full(m, -1)
    owner[taken] = first
    for start in np.setdiff1d(np.arange(n), first):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, base = start, -1, 0.0
        while row != -1:
            reach = base + c[row] - row_price[row] - col_price
            better = ~done & (reach < dist)
            dist[better], via[better] = reach[better], col
            open_dist = np.where(done, np.inf, dist)
            col = int(open_dist.argmin())
            base, done[col] = open_dist[col], True
            row = int(owner[col])
        settled = np.flatnonzero(done)
        for k in settled:
            slack = base - dist[k]
            col_price[k] -= slack
            if owner[k] >= 0:
                row_price[owner[k]] += slack
        row_price[start] += base
        while col != -1:
            before = int(via[col])
            owner[col] = owner[before] if before != -1 else start
            col = before
    pairs = [(int(r), j) for j, r in enumerate(owner) if r >= 0]
    if flipped:
        pairs = [(j, r) for r, j in pairs]
    return sorted(p for p in pairs if cost[p] < limit)
